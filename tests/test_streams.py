"""Rules on a stream: what a batch reads, and samples from the future. Ingest with a quarantine and counts, repeats, live views."""

import glob
import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.rules import Rule
from pulsegrid.plans import streams
from pulsegrid.sources import ingest
from pulsegrid.streaming import flows

T0 = datetime(2026, 7, 1, tzinfo=UTC)
SCHEMA = "name string, type string, value double, ts timestamp, labels map<string,string>, event_id long"
NOW = int((T0 + timedelta(days=9)).timestamp() * 1e6)


@pytest.fixture
def runner(tmp_path):
    return flows.RuleRunner(Rule("r", "R", interval="1h"), lambda e: e.metric("m").instant() > 0.0, str(tmp_path / "table"), str(tmp_path / "results"), int(T0.timestamp() * 1e6), "2h", now=lambda: NOW)


def batch(spark, *hours, value=1.0):
    return spark.createDataFrame([("m", "gauge", value, T0 + timedelta(hours=h), {"h": "a"}, 0) for h in hours], SCHEMA)


def ticks(spark, runner):
    return sorted(r["i"] for r in spark.read.parquet(f"{runner.results}/batch=*").collect())


def test_a_batch_reads_its_own_dates_only(spark, runner):
    for n in range(4):
        runner(batch(spark, 24 * n, 24 * n + 1), n)
    wanted = ticks(spark, runner)
    assert wanted == [0, 1, 2, 3, 24, 25, 26, 27, 48, 49, 50, 51, 72, 73]
    # Files of past days are spoiled: whoever reads them fails.
    for n in range(3):
        for path in glob.glob(f"{runner.table}/date=*/batch={n}/*/*.parquet"):
            open(path, "wb").write(b"spoiled")
    runner(batch(spark, 74, 75), 4)
    runner(batch(spark, 74, 75), 4)  # a batch that runs twice replaces itself
    assert ticks(spark, runner) == [*wanted, 74, 75]


def test_samples_from_the_future_move_nothing(spark, runner, monkeypatch):
    monkeypatch.setattr(flows, "MOST_TICKS", 3)
    runner(batch(spark, 0, 1, 24 * 365 * 50), 0)
    assert ticks(spark, runner) == [0, 1]
    runner(batch(spark, 2, 3, 4, 5, 6, 7), 1)
    assert ticks(spark, runner) == list(range(8))
    runner(batch(spark), 2)
    runner(batch(spark, 8), 3)
    assert ticks(spark, runner) == list(range(9))


def test_a_range_wider_than_the_lookback_is_read_whole(spark, tmp_path):
    """A selector asks for the dates that it looks back to, however far that is."""
    sums = flows.RuleRunner(Rule("r", "R", interval="1h"), lambda e: e.metric("m").range("100h").sum_over_time() > 0.0, str(tmp_path / "t"), str(tmp_path / "r"), int(T0.timestamp() * 1e6), "2h", now=lambda: NOW)
    for n in range(4):
        sums(batch(spark, 24 * n, value=float(10**n)), n)
    found = {r["i"]: r["value"] for r in spark.read.parquet(f"{tmp_path}/r/batch=*").collect()}
    assert found[72] == 1111.0 and found[24] == 11.0 and found[47] == 11.0


def line(*metrics, agent="a"):
    return (json.dumps({"agent_id": agent, "metrics": list(metrics)}),)


def metric(name="m", value=1.0, hours=0, kind="gauge"):
    return {"name": name, "type": kind, "value": value, "timestamp": (T0 + timedelta(hours=hours)).isoformat(), "labels": {}}


@pytest.fixture
def ingested(spark, tmp_path):
    runner = flows.IngestRunner(str(tmp_path), refuse=F.col("ts") > F.lit(T0 + timedelta(days=5)))
    lines = [
        [line(metric(), metric("bad name"), metric(hours=30)), ("{broken",), line(metric(kind="histogram"), metric(hours=24 * 9))],
        [line(metric(hours=n)) for n in range(3)] + [line(metric(), agent="b")],
        [("[]",), ("",)],
    ]
    for n, some in enumerate(lines):
        runner(spark.createDataFrame(some, "value string"), n)
    return runner, lines


def counts(spark, root):
    return [tuple(r) for r in spark.read.parquet(f"{root}/counts").orderBy("batch").select("ingested", "stored", "invalid", "failed", "refused").collect()]


def test_every_sample_is_stored_invalid_or_failed(spark, ingested):
    runner, _ = ingested
    assert counts(spark, runner.root) == [(5, 2, 2, 1, 1), (4, 4, 0, 0, 0), (0, 0, 0, 0, 2)]
    assert all(i == s + v + f for i, s, v, f, _ in counts(spark, runner.root))
    rejected = spark.read.parquet(f"{runner.root}/rejected").select("batch", "error", "failed").collect()
    assert sorted((r["batch"], r["error"], r["failed"]) for r in rejected if not r["failed"]) == [(0, "metric name contains whitespace", False), (0, "unsupported metric type", False)]
    assert [(r["batch"], r["error"]) for r in rejected if r["failed"]] == [(0, None)]
    assert sorted(r["value"] for r in spark.read.parquet(f"{runner.root}/refused").collect()) == ["", "[]", "{broken"]


def test_a_batch_that_runs_twice_replaces_itself(spark, ingested):
    runner, lines = ingested
    kept = lambda: [spark.read.parquet(f"{runner.root}/{name}").count() for name in ("samples", "rejected", "refused", "counts")]
    before = kept(), counts(spark, runner.root)
    runner(spark.createDataFrame(lines[0], "value string"), 0)
    runner(spark.createDataFrame(lines[1], "value string"), 1)
    assert (kept(), counts(spark, runner.root)) == before
    runner(spark.createDataFrame([line(metric(hours=48))], "value string"), 0)  # another run that has fewer dates leaves none of the first behind
    assert kept() == [5, 0, 2, 3] and counts(spark, runner.root)[0] == (1, 1, 0, 0, 0)


def stream_of(spark, folder, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finished(df, folder):
    df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def sample(hours, value, host="a"):
    return ("m", "gauge", value, T0 + timedelta(hours=hours), {"h": host}, 0)


def test_the_first_of_repeats_on_a_stream_stays(spark, tmp_path):
    batches = [[sample(0, 1.0), sample(0, 1.5, "b"), sample(1, 2.0)], [sample(0, 10.0), sample(1, 20.0), sample(2, 3.0)], [sample(40, 4.0), sample(2, 30.0)], [sample(41, 6.0)], [sample(1, 200.0), sample(3, 5.0), sample(40, 40.0)]]
    out = finished(flows.stream_dedup(stream_of(spark, tmp_path, SCHEMA, batches), "10 hours"), tmp_path)
    got = sorted(((r["ts"].astimezone(UTC) - T0).total_seconds() / 3600, r["labels"]["h"], r["value"]) for r in out.collect())
    # What comes beyond the watermark, which a batch leaves to the one after the next, is dropped, repeat or not.
    assert got == [(0, "a", 1.0), (0, "b", 1.5), (1, "a", 2.0), (2, "a", 3.0), (40, "a", 4.0), (41, "a", 6.0)]


def test_stream_percentiles_count_values(spark, tmp_path):
    values = [5.0, 1.0, 1.0, 9.0, 2.0, 2.0, 2.0]
    batches = [[sample(n / 10, v) for n, v in enumerate(values)], [sample(0.95, 7.0), sample(1.5, 100.0)], [sample(30, 1.0)]]
    out = finished(flows.stream_window(stream_of(spark, tmp_path, SCHEMA, batches), "p90", "1h", watermark="1 hour"), tmp_path)
    wanted = sorted([*values, 7.0])[int(7 * 0.9)]
    assert sorted(r["value"] for r in out.collect()) == [wanted, 100.0]
    plan = flows.stream_window(spark.createDataFrame(batches[0], SCHEMA), "p90", "1h")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(value" in plan and plan.count("Aggregate") == 2


def test_a_percentile_walks_over_a_window_s_values_once(spark, tmp_path):
    """Not once more for each value, which made a window of many values quadratic."""
    n = 20_000
    many = [sample(i / n / 2, float((i * 7919) % n)) for i in range(n)]
    stream = stream_of(spark, tmp_path, SCHEMA, [many, [sample(30, 1.0)]])
    plan = flows.stream_window(spark.createDataFrame(many[:1], SCHEMA), "p95", "1h")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("sort_array(") == 1
    out = finished(flows.stream_window(stream, "p95", "1h", watermark="1 hour"), tmp_path)
    assert [r["value"] for r in out.collect()] == [float(int((n - 1) * 0.95))]


def test_live_views_show_their_tenant_s(spark):
    rows = spark.createDataFrame([("cpu", "gauge", 1.0, T0, {"tenant": "tenant-a"}, 0), ("mem", "gauge", 2.0, T0, {"tenant": "tenant-b"}, 0), ("net", "gauge", 3.0, T0, {}, 0)], SCHEMA)
    clients = spark.createDataFrame([("x", "tenant-a"), ("y", "tenant-b"), ("all", ""), ("none", None)], "client string, tenant string")
    got = sorted((r["client"], r["name"]) for r in ingest.live_feeds(rows, clients).collect())
    assert got == [("all", "cpu"), ("all", "mem"), ("all", "net"), ("none", "cpu"), ("none", "mem"), ("none", "net"), ("x", "cpu"), ("y", "mem")]


def taken(stream, folder):
    """For each batch of a stream: its rows' numbers and how many tasks read them."""
    out = []
    see = lambda batch, n: out.append([(r["n"], r["task"]) for r in batch.select("n", F.spark_partition_id().alias("task")).collect()])
    stream.writeStream.foreachBatch(see).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return [(sorted(n for n, _ in rows), len({task for _, task in rows})) for rows in out]


def test_all_cores_read_a_batch(spark, tmp_path):
    batches = taken(streams._stream_of(spark, spark.range(1000).withColumnRenamed("id", "n"), 3), tmp_path)
    assert sorted(n for rows, _ in batches for n in rows) == list(range(1000))
    assert [tasks for _, tasks in batches] == [spark.sparkContext.defaultParallelism] * 3


def test_tables_arrive_one_by_one_read_by_all_cores(spark, tmp_path):
    """Also those with too few rows for a file for each core, or none."""
    bounds = [(0, 400), (400, 401), (401, 401), (401, 900)]
    tables = [spark.range(a, b).withColumnRenamed("id", "n") for a, b in bounds]
    batches = taken(streams._arriving(spark, tables), tmp_path)
    assert [rows for rows, _ in batches] == [list(range(a, b)) for a, b in bounds]
    assert batches[0][1] == batches[3][1] == spark.sparkContext.defaultParallelism
