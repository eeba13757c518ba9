"""Ingest, configuration files, order statistics and streams that equal their batch forms."""

import glob
import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import query as Q
from pulsegrid.operators.vector import Engine, Grid
from pulsegrid.plans import points, streams
from pulsegrid.sources import config, ingest

T0 = datetime(2026, 7, 9, 12, tzinfo=UTC)


def batch(**metric):
    m = {"name": "cpu", "type": "gauge", "value": 1.0, "timestamp": "2026-07-09T12:00:00Z"} | metric
    return {"agent_id": "a", "metrics": [m]}


def test_strict_bodies(spark):
    good = json.dumps(batch(labels={"x": "1"}))
    bodies = [good, good + " {}", json.dumps(batch() | {"more": 1}), json.dumps(batch(odd=1)), "{", '{"agent_id": "a", "metrics": []}' + " " * (1 << 20), json.dumps(batch(type=1)), json.dumps(batch(type=" Counter "))]
    out = ingest.read_batches(spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "n int, value string")).orderBy("n").collect()
    assert [r["error"] for r in out] == [None, "invalid json", "unknown field", "unknown field", "invalid json", "body too large", None, None]
    assert [r["batch"]["metrics"][0]["type"] for r in out[-2:]] == ["counter", "counter"] and out[1]["batch"] is None


def test_conservation(spark):
    rows = [("ok", "gauge", 1.0), ("bad name", "gauge", 1.0), ("nan", "gauge", float("nan"))]
    checked = ingest.validate_sample(spark.createDataFrame(rows, "name string, type string, value double"))
    r = ingest.ingest_accounting(checked).head()
    assert (r["ingested"], r["invalid"], r["failed"], r["stored"]) == (3, 2, 0, 1)


def test_whole_batches_name_the_first_fault(spark):
    bad = {"agent_id": "a", "metrics": [batch()["metrics"][0], batch(name=" ")["metrics"][0], batch(type="histogram")["metrics"][0]]}
    df = ingest.read_batches(spark.createDataFrame([(json.dumps(x),) for x in (bad, batch() | {"agent_id": " "}, {"agent_id": "a", "metrics": []}, batch())], "value string"))
    errors = [r[0] for r in df.select(ingest.validate_batch(F.col("batch"))).collect()]
    assert errors == ["metric[1]: metric name is required", "agent_id is required", "metrics list is empty", None]


def test_tenants_cannot_be_forged(spark):
    df = ingest.read_batches(spark.createDataFrame([(json.dumps(batch(labels={"tenant": "other", "agent_id": "z", "k": "v"})),)], "value string"))
    assert ingest.unpack(df).head()["labels"] == {"agent_id": "a", "k": "v"}
    assert ingest.unpack(df, tenant=F.lit("t1")).head()["labels"] == {"agent_id": "a", "k": "v", "tenant": "t1"}


def points_of(spark, values, step=timedelta(minutes=1)):
    return spark.createDataFrame([("m", "gauge", float(v), T0 + n * step, {"h": "a"}) for n, v in enumerate(values)], "name string, type string, value double, ts timestamp, labels map<string,string>")


def test_aggregators(spark):
    df = points_of(spark, [3, 1, 4, 2])
    got = {a: Q.query_whole(df, a).head()["value"] for a in (*Q.AGGREGATORS, *Q.PERCENTILES)}
    assert got == {"avg": 2.5, "mean": 2.5, "min": 1, "max": 4, "sum": 10, "count": 4, "p50": 2, "p90": 3, "p95": 3, "p99": 3}
    hour = Q.query_window(points_of(spark, [10, 20, 30, 40]), "avg", "1h").collect()
    assert [(r["value"], r["ts"].replace(tzinfo=UTC)) for r in hour] == [(25.0, T0 + timedelta(hours=1))]


def test_order_statistics_with_ties(spark):
    import math
    import random

    rng = random.Random(1)
    for n in (1, 2, 7, 50):
        values = [rng.choice([1, 2, 3, 5]) for _ in range(n)]
        for name, p in Q.PERCENTILES.items():
            assert Q.query_whole(points_of(spark, values), name).head()["value"] == sorted(values)[math.floor((n - 1) * p)]


def test_query_arguments(spark):
    df = points_of(spark, [1, 2])
    with pytest.raises(ValueError):
        Q.query(df, "m", step="1m")
    with pytest.raises(ValueError):
        Q.query(df, "m", agg="p42")
    assert Q.query(df, "m", since=T0, until=T0 + timedelta(minutes=1), limit=1).count() == 1


def test_partitions_are_pruned(spark, tmp_path):
    ingest.write_samples(points_of(spark, range(5), timedelta(days=1)), str(tmp_path / "t"))
    scan = ingest.scan_series(ingest.read_samples(spark, str(tmp_path / "t")), "m", {"h": "a"}, T0 + timedelta(days=1), T0 + timedelta(days=2))
    assert scan.count() == 2
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(name" in plan and "date" in plan.split("PartitionFilters")[1].split("]")[0]


def test_bench_text(spark):
    lines = ["goos: linux", "BenchmarkKey/x-8 \t 1000\t 128.2 ns/op\t 80 B/op", "BenchmarkKey/x-4 100 1 ns/op", "BenchmarkLog hello 1 2", "Benchmarka 10 x y", "BenchmarkHalf 10 1 ns/op bad B/op"]
    out = ingest.read_bench(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = sorted((r["name"], r["unit"], r["value"], r["procs"]) for r in out.collect())
    assert got == [("Half", "ns/op", 1.0, "1"), ("Key/x", "B/op", 80.0, "8"), ("Key/x", "ns/op", 1.0, "4"), ("Key/x", "ns/op", 128.2, "8")]
    assert [r["procs"] for r in ingest.mixed_procs(out).collect()] == [["4", "8"]]


def test_configuration_files(spark, tmp_path):
    def write(value):
        path = tmp_path / "c.json"
        path.write_text(json.dumps(value))
        return f"file://{path}"

    rule = {"id": "r", "name": "R", "expression": "cpu > 90", "for": "1m"}
    loaded = config.load_rules(spark, write({"rules": [rule]}))[0]
    assert (loaded.rule.for_, loaded.rule.interval, loaded.rule.severity, loaded.enabled) == ("1m", "1m", "warning", False)
    for bad in ([rule, rule], [rule | {"id": ""}], [rule | {"odd": 1}], [None], [rule | {"expression": " "}], [rule | {"labels": {"tenant": "x"}}]):
        with pytest.raises(ValueError):
            config.load_rules(spark, write({"rules": bad}))
    routing = {"receivers": [{"name": "log", "type": "log"}], "default_receivers": ["log"], "group_by": ["host"], "inhibit_rules": [{"source_matchers": [{"name": "a", "op": "=", "value": "b"}], "target_matchers": [{"name": "c", "op": "=~", "value": "d.*"}], "equal": ["host"]}]}
    r = config.load_routing(spark, write(routing))
    assert r.grouping.by == ("host",) and r.inhibit[0].equal == ("host",) and r.receivers == ("log",)
    for change in ({"receivers": []}, {"default_receivers": ["no"]}, {"default_receivers": []}, {"receivers": [{"name": "log"}, {"name": "log"}]}, {"inhibit_rules": [{"source_matchers": []}]}):
        with pytest.raises(ValueError):
            config.load_routing(spark, write(routing | change))


def test_streams_equal_batches(spark, sf_dir):
    for stream, same in (("stream_token_bucket", streams.token_bucket),):
        assert sorted(map(tuple, streams.QUERIES[stream](spark, sf_dir).collect())) == sorted(map(tuple, same(spark, sf_dir).collect()))


def test_stream_groups_equal_the_fold(spark, sf_dir):
    from pulsegrid.plans import alerting

    done = streams.stream_group(spark, sf_dir).collect()
    last = max((r["us"] for r in done), default=0)
    batch_rows = [r for r in alerting.group_notifications(spark, sf_dir).collect() if r["us"] <= last]
    assert sorted(map(tuple, done)) == sorted(map(tuple, batch_rows))


def test_token_bucket_against_a_loop(spark, sf_dir):
    rate, burst = streams.RATE, streams.BURST
    rows = streams._requests(spark, sf_dir).collect()
    wanted, state = set(), {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
        tokens, at = state.get(r["key"], (burst, r["ts"]))
        tokens = min(burst, tokens + (r["ts"] - at).total_seconds() * rate)
        if tokens >= 1:
            wanted.add((r["key"], r["seq"]))
            tokens -= 1
        state[r["key"]] = (tokens, r["ts"])
    got = {(r["key"], r["seq"]) for r in streams.token_bucket(spark, sf_dir).filter("allowed").collect()}
    assert got == wanted


@pytest.mark.parametrize("query", ["token_bucket", "group_notifications"])
def test_keys_are_folded_batch_by_batch(spark, sf_dir, query):
    from pulsegrid.plans import alerting

    run = {"token_bucket": streams.token_bucket, "group_notifications": alerting.group_notifications}[query]
    wanted, size = sorted(map(tuple, run(spark, sf_dir).collect())), "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "3")
    try:
        out = run(spark, sf_dir)
        assert sorted(map(tuple, out.collect())) == wanted and wanted
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()  # which takes all rows of a key at once
    finally:
        spark.conf.unset(size)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert points.SINCE < points.UNTIL


POINT = "name string, type string, value double, ts timestamp, labels map<string,string>"


def test_tables_are_written_and_read_under_different_zones(spark, tmp_path):
    """A point half an hour after midnight UTC lies on the day before in New York."""
    at = datetime(2026, 7, 9, 0, 30, tzinfo=UTC)
    rows = spark.createDataFrame([("m", "gauge", 1.0, at, {"h": "a"}), ("m", "gauge", 2.0, at + timedelta(hours=23), {"h": "a"})], POINT)
    before = spark.conf.get("spark.sql.session.timeZone")
    zones = ("UTC", "America/New_York", "Asia/Tokyo")
    try:
        for write in zones:
            spark.conf.set("spark.sql.session.timeZone", write)
            ingest.write_samples(rows, f"{tmp_path}/{write}")
            for read in zones:
                spark.conf.set("spark.sql.session.timeZone", read)
                table = ingest.read_samples(spark, f"{tmp_path}/{write}")
                assert sorted({str(r["date"]) for r in table.select("date").collect()}) == ["2026-07-09"]
                for since, until, n in ((at, at, 1), (at - timedelta(hours=1), at + timedelta(hours=1), 1), (at, at + timedelta(days=1), 2), (at.replace(tzinfo=None), at.replace(tzinfo=None), 1)):
                    assert ingest.scan_series(table, "m", None, since, until).count() == n
                grid = Grid.over(at, at + timedelta(minutes=1))
                assert [r["value"] for r in Engine(table, grid).metric("m").instant().df.collect()] == [1.0, 1.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_files_go_by_directories_and_bytes(spark, tmp_path):
    """Eight tasks with samples of ten days each leave ten files, and a name with very many samples leaves several."""
    rows = spark.range(0, 4000, 1, 8).select(F.lit("m").alias("name"), F.lit("gauge").alias("type"), F.rand(1).alias("value"), F.timestamp_seconds(F.col("id") % 10 * 86_400 + 60).alias("ts"), F.create_map(F.lit("h"), F.col("id").cast("string")).alias("labels"))
    ingest.write_samples(rows, f"{tmp_path}/few")
    assert len(glob.glob(f"{tmp_path}/few/name=m/date=*/*.parquet")) == 10
    hot = spark.range(0, 300_000, 1, 8).select(F.lit("hot").alias("name"), F.lit("gauge").alias("type"), F.rand(1).alias("value"), F.timestamp_seconds(F.col("id") % 1000).alias("ts"), F.create_map(F.lit("h"), F.col("id").cast("string")).alias("labels"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        ingest.write_samples(hot.unionByName(rows), f"{tmp_path}/hot")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert 2 <= len(glob.glob(f"{tmp_path}/hot/name=hot/date=*/*.parquet")) <= 60 and len(glob.glob(f"{tmp_path}/hot/name=m/date=*/*.parquet")) <= 40
    assert ingest.read_samples(spark, f"{tmp_path}/hot").count() == 304_000


def test_statistics_from_kept_sketches(spark):
    """Series by sketches of three overlapping parts, without the table: off by less than 5 per cent."""
    rows = spark.range(60_000).select(F.concat(F.lit("m"), F.col("id") % 2).alias("name"), F.lit("gauge").alias("type"), F.lit(1.0).alias("value"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.create_map(F.lit("h"), (F.col("id") % 20_000).cast("string")).alias("labels"))
    parts = [ingest.stats_sketches(rows.filter(F.hash("ts") % 3 == n)) for n in (-2, -1, 0, 1, 2)]
    kept = parts[0]
    for p in parts[1:]:
        kept = kept.unionByName(p)
    whole = ingest.sketched_stats(kept).head()
    assert whole["points"] == 60_000 and abs(whole["series"] - 20_000) < 1000
    by = {r["name"]: (r["points"], r["series"]) for r in ingest.sketched_stats(kept, "name").collect()}
    assert all(n == 30_000 and abs(s - 10_000) < 500 for n, s in by.values()) and len(by) == 2
