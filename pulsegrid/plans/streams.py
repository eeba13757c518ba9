"""Queries on streams: the tables are read as a stream to its end, and the sink's rows are returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.labels import series_key
from pulsegrid.operators import alerts as A
from pulsegrid.operators import ratelimit
from pulsegrid.plans import alerting
from pulsegrid.plans.points import SAMPLES, _json_batches, rounded, text, us
from pulsegrid.plans.points import ORACLE_SQL as POINTS_SQL
from pulsegrid.plans.vectors import GRID, LOOKBACK
from pulsegrid.sources import events, ingest
from pulsegrid.sources.shared import new_path
from pulsegrid.streaming import flows, states

RATE, BURST = 1 / 7200, 3
#: Batches that a stream in no order of time comes in.
BATCHES = 4
#: The last time with alerts of `stream_alert_ticks`.
QUIET = 30
LAST_DAY = 1_706_400_000_000_000


def _tenant() -> Column:
    return F.concat(F.lit("t"), F.col("user_id") % 2)


def _folder(spark: SparkSession) -> str:
    return new_path(spark, "stream")


def _stream_of(spark: SparkSession, df: DataFrame, batches: int | None = None) -> DataFrame:
    """A table's rows as a stream, through files in the shared folder; where it comes in several batches, a batch has a file for each core.

    A file is read and parsed by one task, so one for a batch would leave all others idle.
    """
    path, each = _folder(spark), spark.sparkContext.defaultParallelism if batches else 1000
    (df.repartition(batches * each) if batches else df).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def _arriving(spark: SparkSession, steps: list[DataFrame]) -> DataFrame:
    """Tables as a stream that takes each as one batch, in their order, from a file for each core."""
    path, each = _folder(spark), spark.sparkContext.defaultParallelism
    schema = steps[0].schema
    for n, df in enumerate(steps, 1):  # one after the other, since files are taken in order of time
        df.repartition(each).write.mode("append").parquet(path)
        # A few rows may leave some files out, and the next table's would be taken in their place: empty ones fill up.
        for _ in range(n * each - len(spark.read.schema(schema).parquet(path).inputFiles())):
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(path)


def _finished(df: DataFrame) -> DataFrame:
    """All rows that a stream puts out until its input ends."""
    path = _folder(df.sparkSession)
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_ingest(spark, sf_dir):
    path = _folder(spark)
    runner = flows.IngestRunner(path, tenant=_tenant())
    flows.stream_ingest(_stream_of(spark, _json_batches(spark, sf_dir)), runner, f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/samples").select("name", "type", rounded(), us().alias("us"), text().alias("labels"))


def stream_accounting(spark, sf_dir):
    """Counts of a stream of batches with faults of lines and of samples, in several batches; samples of the last day are kept out."""
    path = _folder(spark)
    name = F.when(F.col("event_id") % 11 == 2, F.concat("event_type", F.lit(" x"))).otherwise(F.col("event_type"))
    runner = flows.IngestRunner(path, tenant=_tenant(), refuse=F.unix_micros("ts") >= LAST_DAY)
    flows.stream_ingest(_stream_of(spark, _json_batches(spark, sf_dir, name), BATCHES), runner, f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    counts = F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("ingested", "stored", "invalid", "failed", "refused")))
    out = spark.read.parquet(f"{path}/counts").select(F.explode(counts).alias("c")).groupBy("c.what").agg(F.sum("c.n").alias("n"))
    for kept in ("samples", "rejected", "refused"):
        out = out.unionByName(spark.read.parquet(f"{path}/{kept}").agg(F.count("*").alias("n")).withColumn("what", F.lit(f"rows of {kept}")))
    return out


def stream_dedup(spark, sf_dir):
    """Four batches in order of time; each repeats the one before with other values, and the last also some of the first."""
    rows = events.samples(spark, sf_dir).withColumn("labels", F.create_map(F.lit("event"), F.col("event_id").cast("string")))
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    steps = []
    for n in range(4):
        again = rows.filter(week == n - 1).withColumn("value", F.col("value") + 1000)
        late = rows.filter((week == 0) & (F.lit(n) == 3) & (F.col("event_id") % 50 == 0)).withColumn("value", F.col("value") + 2000)
        steps.append(rows.filter(week == n).unionByName(again).unionByName(late))
    return _finished(flows.stream_dedup(_arriving(spark, steps), "10 days")).select("event_id", rounded(), us().alias("us"))


def stream_live(spark, sf_dir):
    """The live views of three clients, one without a tenant, from one stream."""
    clients = spark.createDataFrame([("all", None), ("a", "t0"), ("b", "t1")], "client string, tenant string")
    feeds = ingest.live_feeds(_stream_of(spark, events.samples(spark, sf_dir), BATCHES), clients)
    return _finished(feeds).select("client", "name", "type", rounded(), us("timestamp").alias("us"), text().alias("labels"))


def stream_window(spark, sf_dir):
    rows = _stream_of(spark, events.samples(spark, sf_dir))
    return _finished(flows.stream_window(rows, "avg", "24h", watermark="1 day")).select("series", us().alias("us"), rounded())


def stream_window_p95(spark, sf_dir):
    rows = _stream_of(spark, events.samples(spark, sf_dir))
    return _finished(flows.stream_window(rows, "p95", "24h", watermark="1 day")).select("series", us().alias("us"), rounded())


def stream_rules(spark, sf_dir):
    """The rule evaluated as daily files of samples come in."""
    root = _folder(spark)
    samples = events.samples(spark, sf_dir)
    week_of = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    rows = _arriving(spark, [samples.filter(week_of == week) for week in range(4)])
    runner = flows.RuleRunner(alerting.RULE, lambda e: e.metric("purchase").instant() > 60.0, f"{root}/table", f"{root}/results", GRID.start, LOOKBACK)
    flows.stream_rules(rows, runner, f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.option("basePath", f"{root}/results").parquet(f"{root}/results/batch=*")
    return out.filter(F.col("i") <= GRID.last).select("i", "key", "fingerprint", rounded())


def stream_alert_states(spark, sf_dir):
    """Alert events of the active alerts, in order of time; the last time's are still open."""
    active = alerting._results(spark, sf_dir).withColumn("at", GRID.time(F.col("i"))).select("rule_id", "fingerprint", "at", "value")
    out = _finished(states.stream_alert_states(_stream_of(spark, active), alerting.RULE, alerting.RESEND))
    # The watermark ends at the last time with any alert; what lasts until then is not resolved yet.
    return out.select("fingerprint", us("at").alias("us"), "status", rounded(), us("starts_at").alias("starts"))


def stream_alert_ticks(spark, sf_dir):
    """Alerts that all fall silent at one time, while evaluation goes on: every one is resolved."""
    active = alerting._results(spark, sf_dir).filter(F.col("i") <= QUIET).withColumn("at", GRID.time(F.col("i"))).select("rule_id", "fingerprint", "at", "value")
    ticks = spark.range(GRID.last + 1).select(GRID.time(F.col("id")).alias("at"))
    out = _finished(states.stream_alert_states(_stream_of(spark, active), alerting.RULE, alerting.RESEND, ticks=_stream_of(spark, ticks)))
    return out.select("fingerprint", us("at").alias("us"), "status", rounded(), us("starts_at").alias("starts"))


def stream_group(spark, sf_dir):
    """Sendings of the groups until the last event's time."""
    routed = A.route_receivers(alerting.R.build_alerts(alerting._forwarded(spark, sf_dir), alerting.RULE), alerting.GROUPING)
    rows = routed.select("receiver", "labels", "at", "fingerprint", "status")
    return _finished(states.stream_group(_stream_of(spark, rows), alerting.GROUPING)).select("group", "receiver", us("sent_at").alias("us"), "fingerprint", "status")


def _requests(spark, sf_dir):
    rows = events.samples(spark, sf_dir)
    return rows.select(series_key(F.lit("agent"), F.col("labels")).alias("key"), F.col("event_id").alias("seq"), "ts")


def token_bucket(spark, sf_dir):
    """Which events of each agent are within a budget of one in two hours, three at once."""
    return ratelimit.token_bucket(_requests(spark, sf_dir), RATE, BURST)


def stream_token_bucket(spark, sf_dir):
    return _finished(states.stream_token_bucket(_stream_of(spark, _requests(spark, sf_dir)), RATE, BURST, idle_ms=None))


QUERIES = {f.__name__: f for f in (stream_ingest, stream_accounting, stream_dedup, stream_live, stream_window, stream_window_p95, stream_rules, stream_alert_states, stream_alert_ticks, stream_group, token_bucket, stream_token_bucket)}

_CLOSED = f"""WITH {SAMPLES.replace("{", "{{").replace("}", "}}")}, w AS (SELECT series, (us // 86400000000 + 1) * 86400000000 AS us, {{0}} AS value FROM keyed GROUP BY 1, 2)
SELECT series, us, round(value, 6) AS value FROM w WHERE us <= (SELECT max(us) FROM keyed) - 86400000000"""
_LAST_T = "(SELECT max(i) FROM r)"

_BUCKET = f"""WITH RECURSIVE {SAMPLES}, req AS (
    SELECT 'agent{{' || key || '}}' AS key, event_id AS seq, us, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS n FROM samples
), walk AS (
    SELECT key, seq, n, us AS stamp, CAST({BURST} - 1 AS DOUBLE) AS tokens, true AS allowed FROM req WHERE n = 1
    UNION ALL
    SELECT key, seq, n, stamp, CASE WHEN had >= 1 THEN had - 1 ELSE had END, had >= 1 FROM (
        SELECT r.key, r.seq, r.n, greatest(w.stamp, r.us) AS stamp, least(CAST({BURST} AS DOUBLE), w.tokens + greatest(0, r.us - w.stamp) / CAST(1000000 AS DOUBLE) * CAST('{RATE!r}' AS DOUBLE)) AS had
        FROM walk w JOIN req r ON r.key = w.key AND r.n = w.n + 1
    )
) SELECT key, seq, allowed FROM walk"""

ORACLE_SQL = {
    "stream_accounting": f"""
WITH e AS (SELECT *, user_id % 7 BETWEEN 1 AND 3 AS broken, event_id % 11 = 2 AS faulty, epoch_us(ts) >= {LAST_DAY} AS kept_out FROM events),
g AS (SELECT count(*) FILTER (WHERE NOT broken) AS ingested, count(*) FILTER (WHERE NOT broken AND NOT faulty AND NOT kept_out) AS stored, count(*) FILTER (WHERE NOT broken AND faulty) AS invalid,
    count(*) FILTER (WHERE NOT broken AND NOT faulty AND kept_out) AS failed, count(DISTINCT CASE WHEN broken THEN user_id || '|' || CAST(ts AS DATE) END) AS refused FROM e)
SELECT unnest(['ingested', 'stored', 'invalid', 'failed', 'refused', 'rows of samples', 'rows of rejected', 'rows of refused']) AS what,
       unnest([ingested, stored, invalid, failed, refused, stored, invalid + failed, refused]) AS n FROM g""",
    "stream_dedup": "SELECT event_id, round(value, 6) AS value, epoch_us(ts) AS us FROM events",
    "stream_live": f"""WITH {SAMPLES} SELECT client, name, 'gauge' AS type, round(value, 6) AS value, us, key AS labels
FROM samples JOIN (VALUES ('all', NULL), ('a', 't0'), ('b', 't1')) c(client, t) ON t IS NULL OR t = tenant""",
    "stream_group": alerting.group_sql("(SELECT max(us) FROM sides)"),
    "token_bucket": _BUCKET,
    "stream_token_bucket": _BUCKET,
    "stream_ingest": POINTS_SQL["unpack"],
    "stream_window": _CLOSED.format("avg(value)"),
    "stream_window_p95": _CLOSED.format("list_sort(list(value))[CAST(floor((count(*) - 1) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1]"),
    "stream_rules": f"{alerting._BASE} SELECT i, key, fingerprint, round(value, 6) AS value FROM r",
    "stream_alert_states": f"""{alerting._BASE} SELECT fingerprint, us, status, round(value, 6) AS value, {GRID.start} + first_i * {GRID.step} AS starts FROM events_
WHERE status = 'firing' OR i < {_LAST_T}""",
    "stream_alert_ticks": f"""{alerting._BASE.replace("WHERE value > 60", f"WHERE value > 60 AND i <= {QUIET}")} SELECT fingerprint, us, status, round(value, 6) AS value, {GRID.start} + first_i * {GRID.step} AS starts FROM events_""",
}
