"""Queries on ingest, labels and point queries, with their SQL."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import labels as L
from pulsegrid.functions.times import resolve_relative_time as resolve
from pulsegrid.operators import query as Q
from pulsegrid.operators.vector import Engine, Grid
from pulsegrid.sources import events, ingest
from pulsegrid.sources.shared import new_path

SINCE, UNTIL = datetime(2024, 1, 5), datetime(2024, 1, 20)
NAME, AGENT = "purchase", "agent-3"

#: Samples as SQL: the counterpart of sources.events.samples.
SAMPLES = """samples AS (
    SELECT event_id, event_type AS name, value, ts, epoch_us(ts) AS us,
           'agent-' || (user_id % 8) AS agent_id, 's' || (user_id % 3) AS shard, 't' || (user_id % 2) AS tenant,
           'agent_id=agent-' || (user_id % 8) || ',shard=s' || (user_id % 3) || ',tenant=t' || (user_id % 2) AS key
    FROM events
), keyed AS (SELECT *, name || '{' || key || '}' AS series FROM samples)"""


def us(column: str | Column = "ts") -> Column:
    return F.unix_micros(column)


def rounded(column: str | Column = "value", name: str = "value") -> Column:
    """Six places, and never a negative zero."""
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def text(labels: str | Column = "labels") -> Column:
    return L.label_key(F.col(labels) if isinstance(labels, str) else labels)


def key(name: str = "name", labels: str = "labels") -> Column:
    return L.series_key(F.col(name), F.col(labels))


def _json_batches(spark: SparkSession, sf_dir: str, name: Column | None = None) -> DataFrame:
    """Events as the JSON bodies agents would send, one for each user and day; every seventh user's are broken in turn."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    metric = F.struct(
        (F.col("event_type") if name is None else name).alias("name"), F.when(F.col("event_id") % 2 == 0, " Gauge").otherwise("1").alias("type"), "value",
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.create_map(F.lit("event"), F.col("event_id").cast("string"), F.lit("tenant"), F.lit("forged")).alias("labels"),
    )
    day = F.to_date("ts").cast("string")
    b = e.groupBy("user_id", day.alias("day")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.to_json(metric).alias("m")))).alias("m"))
    metrics = F.array_join(F.transform("m", lambda x: x["m"]), ",")
    body = F.concat(F.lit('{"agent_id":"agent-'), (F.col("user_id") % 8).cast("string"), F.lit('","metrics":['), metrics, F.lit("]}"))
    broken = F.when(F.col("user_id") % 7 == 1, F.concat(body, F.lit(" {}"))).when(F.col("user_id") % 7 == 2, F.regexp_replace(body, '"name":', '"title":')).when(F.col("user_id") % 7 == 3, F.substring(body, 1, 20))
    return b.select("user_id", "day", F.coalesce(broken, body).alias("value"))


def read_batches(spark, sf_dir):
    rows = ingest.read_batches(_json_batches(spark, sf_dir))
    return rows.select("user_id", "day", "error", F.col("batch.agent_id").alias("agent_id"), F.coalesce(F.size("batch.metrics"), F.lit(0)).alias("n_metrics"), F.get(F.col("batch.metrics.type"), F.lit(0)).alias("first_type"))


def unpack(spark, sf_dir):
    rows = ingest.read_batches(_json_batches(spark, sf_dir)).filter("error IS NULL")
    return ingest.unpack(rows, tenant=F.concat(F.lit("t"), F.col("user_id") % 2)).select("name", "type", rounded(), us().alias("us"), text().alias("labels"))


def _odd_samples(spark, sf_dir):
    """Samples with every kind of fault, decided by the event's number."""
    n = F.col("event_id") % 11
    name = F.when(n == 1, "").when(n == 2, F.concat("name", F.lit(" x"))).otherwise(F.col("name"))
    value = F.when(n == 3, float("nan")).when(n == 4, float("-inf")).otherwise(F.col("value"))
    return events.samples(spark, sf_dir).withColumns({"name": name, "value": value, "type": F.when(n == 5, "histogram").otherwise(F.col("type")), "ts": F.when(n != 6, F.col("ts"))})


_ODD = """CASE event_id % 11 WHEN 1 THEN 'metric name is empty' WHEN 2 THEN 'metric name contains whitespace'
    WHEN 3 THEN 'value is NaN or Inf' WHEN 4 THEN 'value is NaN or Inf' WHEN 5 THEN 'unsupported metric type' END"""


def validate_sample(spark, sf_dir):
    return ingest.validate_sample(_odd_samples(spark, sf_dir)).select("event_id", "error")


def validate_metric(spark, sf_dir):
    rows = _odd_samples(spark, sf_dir).withColumn("m", F.struct("name", "type", "value", F.col("ts").alias("timestamp")))
    return rows.select("event_id", ingest.validate_metric(F.col("m")).alias("error"))


def validate_batch(spark, sf_dir):
    m = F.struct("event_id", "name", "type", "value", F.col("ts").alias("timestamp"))
    rows = _odd_samples(spark, sf_dir).groupBy(F.col("labels")["agent_id"].alias("agent"), F.floor(F.col("event_id") / 64).alias("block")).agg(F.array_sort(F.collect_list(m)).alias("metrics"))
    batch = F.struct(F.when(F.col("block") % 5 == 0, " ").otherwise(F.col("agent")).alias("agent_id"), "metrics")
    return rows.select("agent", "block", ingest.validate_batch(batch).alias("error"))


def enrich_timestamp(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return ingest.enrich_timestamp(_odd_samples(spark, sf_dir), now).select("event_id", us().alias("us"))


def ingest_accounting(spark, sf_dir):
    checked = ingest.validate_sample(_odd_samples(spark, sf_dir))
    return ingest.ingest_accounting(checked, failed=F.col("event_id") % 13 == 0)


def write_samples(spark, sf_dir):
    """Samples written, read back, and counted by partition."""
    path = new_path(spark, "samples")
    ingest.write_samples(events.samples(spark, sf_dir), path, mode="overwrite")
    return ingest.read_samples(spark, path).groupBy("name", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), rounded(F.sum("value"), "total"))


def scan_series(spark, sf_dir):
    rows = ingest.scan_series(events.samples(spark, sf_dir), NAME, {"agent_id": AGENT, "zone": ""}, SINCE, UNTIL)
    return rows.select("event_id", rounded(), us().alias("us"))


def dedup_points(spark, sf_dir):
    """Two overlapping sources, times cut to hours: the later source's value stays."""
    rows = events.samples(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    both = rows.unionByName(rows.filter("event_id % 3 = 0").withColumns({"value": F.col("value") + 1000, "event_id": F.col("event_id") + 10_000_000, "type": F.lit("counter")}))
    return ingest.dedup_points(both, "event_id").select("series", "type", rounded(), us().alias("us"))


def store_stats(spark, sf_dir):
    return ingest.store_stats(events.samples(spark, sf_dir))


def sketched_stats(spark, sf_dir):
    """Points by name, and whether the series by sketches are within 5 per cent of those counted, from what two halves of the table kept."""
    rows = events.samples(spark, sf_dir)
    kept = ingest.stats_sketches(rows.filter("event_id % 2 = 0")).unionByName(ingest.stats_sketches(rows.filter("event_id % 2 = 1")))
    counted = rows.groupBy("name").agg(F.count_distinct(key()).alias("counted"))
    close = F.abs(F.col("series") - F.col("counted")) <= 0.05 * F.col("counted")
    return ingest.sketched_stats(kept, "name").join(counted, "name").select("name", "points", close.alias("close"))


def tied_points(spark, sf_dir):
    """The newest points of series whose times are cut to days, so that many meet: the last event of a time counts."""
    rows = events.samples(spark, sf_dir).withColumn("ts", F.date_trunc("day", "ts"))
    engine = Engine(rows, Grid.over(SINCE, UNTIL, "24h"), lookback="36h", order="event_id")
    newest = engine.metric(NAME).instant().df.select("i", "key", rounded(name="newest"))
    rise = engine.metric(NAME).range("48h").delta().df.select("i", "key", rounded(name="change"))
    return newest.join(rise, ["i", "key"], "left").withColumnRenamed("key", "labels")


def live_feed(spark, sf_dir):
    return ingest.live_feed(events.samples(spark, sf_dir), "t1").select("name", "type", rounded(), us("timestamp").alias("us"), text().alias("labels"))


def read_bench(spark, sf_dir):
    """Benchmark output made of orders: one result line for each, with two measurements."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.concat(F.lit("Benchmark"), F.regexp_replace("o_orderpriority", " ", "_"), F.lit("/x-"), F.col("o_orderkey") % 3 + 1, F.lit(" \t 100\t"), F.round("o_totalprice", 2).cast("string"), F.lit(" ns/op  "), F.col("o_custkey"), F.lit(" B/op"))
    rows = o.select(F.when(F.col("o_orderkey") % 10 == 0, "ok  \tpkg 1.2s").otherwise(line).alias("value"), F.lit("a").alias("run"))
    out = ingest.read_bench(rows, run=F.col("run")).groupBy("name", "unit", "procs").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out


def match_labels(spark, sf_dir):
    rows = events.samples(spark, sf_dir)
    return rows.filter(L.match_labels(F.col("labels"), {"shard": "s1", "tenant": "t0", "zone": ""})).select("event_id")


def label_matcher(spark, sf_dir):
    rows, labels = events.samples(spark, sf_dir), F.col("labels")
    made = {"eq": ("shard", "=", "s1"), "ne": ("shard", "!=", "s1"), "re": ("agent_id", "=~", "agent-[1-3]"), "nre": ("agent_id", "!~", "agent-[1-3]|gent-5"), "absent": ("zone", "=~", ".*")}
    return rows.select("event_id", *(L.label_matcher(labels, L.Matcher(*m)).alias(k) for k, m in made.items()))


def match_all(spark, sf_dir):
    """Matchers as data: what each event must match depends on its number; every fifth has none, and matches nothing."""
    m = lambda n, o, v: F.struct(F.lit(n).alias("name"), F.lit(o).alias("op"), F.lit(v).alias("value"))
    ms = F.when(F.col("event_id") % 5 == 0, F.array().cast(L.MATCHER_TYPE)).when(F.col("event_id") % 2 == 0, F.array(m("shard", "=", "s1"), m("tenant", "!~", "t1"))).otherwise(F.array(m("agent_id", "=~", "agent-[0-4]"), m("zone", "=", "")))
    return events.samples(spark, sf_dir).select("event_id", L.match_all(ms, F.col("labels")).alias("matched"))


def filter_time(spark, sf_dir):
    now = datetime.fromisoformat("2024-01-25T00:00:00+00:00")
    since, until = resolve("-240h", now), resolve("now", now)
    return Q.filter_time(events.samples(spark, sf_dir), since, until).select("event_id", us().alias("us"))


def scope_tenant(spark, sf_dir):
    """All samples of one tenant, whatever their names."""
    return Q.scope_tenant(events.samples(spark, sf_dir), "t1").select("event_id", "name", F.col("labels")["tenant"].alias("tenant"))


def tenant_override(spark, sf_dir):
    """Tenant t1 asks for t0's points, and gets its own."""
    return Q.query(events.samples(spark, sf_dir), NAME, {"tenant": "t0"}, SINCE, UNTIL, tenant="t1").select("series", us().alias("us"), rounded())


def resolve_relative_time(spark, sf_dir):
    """Samples between two bounds that are given as offsets from the newest sample."""
    rows = events.samples(spark, sf_dir)
    now = rows.agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("now")).head()["now"]
    now = resolve(now, datetime.now(UTC))
    return Q.filter_time(rows, resolve("-10d", now), resolve("-36h", now)).select("event_id", us().alias("us"))


def _awkward(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.concat(F.lit("order,{"), "o_orderstatus", F.lit("}"))
    labels = F.create_map(F.lit("pri=or"), "o_orderpriority", F.lit("a\\b"), F.concat(F.lit("x,"), F.col("o_custkey").cast("string")), F.lit("empty"), F.lit(""))
    return o.select("o_orderkey", name.alias("name"), labels.alias("labels"))


def series_key(spark, sf_dir):
    return _awkward(spark, sf_dir).select("o_orderkey", key().alias("series"))


def parse_series_key(spark, sf_dir):
    rows = _awkward(spark, sf_dir).withColumn("p", L.parse_series_key(key()))
    return rows.select("o_orderkey", F.col("p.name").alias("name"), *(L.label(F.col("p.labels"), k).alias(a) for k, a in (("pri=or", "priority"), ("a\\b", "customer"), ("none", "none"))), F.size("p.labels").alias("n"))


def canonical_labels(spark, sf_dir):
    return _awkward(spark, sf_dir).select("o_orderkey", L.canonical_labels(F.col("labels")).alias("text"))


def merge_labels(spark, sf_dir):
    over = F.create_map(F.lit("shard"), F.lit("moved"), F.lit("zone"), F.col("event_id").cast("string"))
    return events.samples(spark, sf_dir).select("event_id", text(L.merge_labels(F.col("labels"), over)).alias("labels"))


def query_raw(spark, sf_dir):
    return Q.query(events.samples(spark, sf_dir), NAME, {"agent_id": AGENT}, SINCE, UNTIL).select("series", us().alias("us"), rounded())


def query_window(spark, sf_dir, agg: str = "avg"):
    """Daily windows of one agent's purchases from a fixed origin."""
    return Q.query(events.samples(spark, sf_dir), NAME, {"agent_id": AGENT}, SINCE, UNTIL, agg, "24h").select("series", us().alias("us"), rounded())


def query_window_open(spark, sf_dir):
    """Windows of 36 hours of every series from its own first point."""
    return Q.query_window(events.samples(spark, sf_dir), "avg", "36h").select("series", us().alias("us"), rounded())


def query_whole(spark, sf_dir):
    return Q.query_whole(events.samples(spark, sf_dir), "avg").select("series", us().alias("us"), rounded())


def query_limit(spark, sf_dir):
    return Q.query(events.samples(spark, sf_dir), NAME, {"tenant": "t0"}, limit=10).select("series", us().alias("us"), rounded())


def _aggregate(agg):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.query_window(events.samples(spark, sf_dir), agg, "24h", SINCE, UNTIL).select("series", us().alias("us"), rounded())

    return run


def _us(at: datetime) -> int:
    return round((at - datetime(1970, 1, 1)) / timedelta(microseconds=1))


_A, _B = _us(SINCE), _us(UNTIL)
_DAY = 86_400_000_000
_WINDOW = f"""SELECT series, CAST({_A} + (floor((us - {_A}) / {_DAY}.0) + 1) * {_DAY} AS BIGINT) AS us, round({{0}}, 6) AS value
FROM keyed WHERE us BETWEEN {_A} AND {_B} {{1}} GROUP BY 1, 2"""
_SQL_AGG = {"avg": "avg(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "count": "CAST(count(*) AS DOUBLE)"} | {
    k: f"list_sort(list(value))[CAST(floor((count(*) - 1) * CAST({p} AS DOUBLE)) AS BIGINT) + 1]" for k, p in Q.PERCENTILES.items()
}
_ESC = r"regexp_replace({0}, '([\\,={{}}])', '\\\1', 'g')"
_AWKWARD = r"""awkward AS (SELECT o_orderkey, 'order,{' || o_orderstatus || '}' AS name, o_orderpriority AS p, 'x,' || o_custkey AS c FROM orders)"""
_BROKEN = "CASE user_id % 7 WHEN 1 THEN 'invalid json' WHEN 2 THEN 'unknown field' WHEN 3 THEN 'invalid json' END"

QUERIES = {
    f.__name__: f
    for f in (
        read_batches, unpack, validate_sample, validate_metric, validate_batch, enrich_timestamp, ingest_accounting, write_samples, scan_series, dedup_points, store_stats, sketched_stats, tied_points, live_feed, read_bench,
        match_labels, label_matcher, match_all, filter_time, scope_tenant, tenant_override, resolve_relative_time, series_key, parse_series_key, canonical_labels, merge_labels,
        query_raw, query_window, query_window_open, query_whole, query_limit,
    )
} | {f"agg_{a}": _aggregate(a) for a in _SQL_AGG}

ORACLE_SQL = {
    "read_batches": f"""
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_BROKEN} AS error, CASE WHEN {_BROKEN} IS NULL THEN 'agent-' || (user_id % 8) END AS agent_id,
       CASE WHEN {_BROKEN} IS NULL THEN CAST(count(*) AS INTEGER) ELSE CAST(0 AS INTEGER) END AS n_metrics,
       CASE WHEN {_BROKEN} IS NULL THEN CASE WHEN min(event_id) % 2 = 0 THEN 'gauge' ELSE 'counter' END END AS first_type
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "unpack": f"""
SELECT event_type AS name, CASE WHEN event_id % 2 = 0 THEN 'gauge' ELSE 'counter' END AS type, round(value, 6) AS value, epoch_us(ts) AS us,
       'agent_id=agent-' || (user_id % 8) || ',event=' || event_id || ',tenant=t' || (user_id % 2) AS labels
FROM events WHERE {_BROKEN} IS NULL""",
    "validate_sample": f"SELECT event_id, {_ODD} AS error FROM events",
    "validate_metric": """
SELECT event_id, CASE event_id % 11 WHEN 1 THEN 'metric name is required' WHEN 3 THEN 'metric value must be finite' WHEN 4 THEN 'metric value must be finite'
    WHEN 5 THEN 'unsupported metric type' WHEN 6 THEN 'timestamp is required' END AS error FROM events""",
    "validate_batch": """
WITH e AS (
    SELECT 'agent-' || (user_id % 8) AS agent, event_id // 64 AS block, event_id, CASE event_id % 11 WHEN 1 THEN 'metric name is required' WHEN 3 THEN 'metric value must be finite'
        WHEN 4 THEN 'metric value must be finite' WHEN 5 THEN 'unsupported metric type' WHEN 6 THEN 'timestamp is required' END AS bad FROM events
), n AS (SELECT *, row_number() OVER (PARTITION BY agent, block ORDER BY event_id) - 1 AS place FROM e)
SELECT agent, block, CASE WHEN block % 5 = 0 THEN 'agent_id is required' ELSE arg_min('metric[' || place || ']: ' || bad, place) FILTER (WHERE bad IS NOT NULL) END AS error
FROM n GROUP BY agent, block""",
    "enrich_timestamp": "SELECT event_id, CASE WHEN event_id % 11 = 6 THEN epoch_us(TIMESTAMP '2024-02-01 00:00:00') ELSE epoch_us(ts) END AS us FROM events",
    "ingest_accounting": f"""
SELECT count(*) AS ingested, count(e) AS invalid, count(*) FILTER (WHERE e IS NULL AND f) AS failed, count(*) FILTER (WHERE e IS NULL AND NOT f) AS stored
FROM (SELECT {_ODD} AS e, event_id % 13 = 0 AS f FROM events)""",
    "write_samples": "SELECT event_type AS name, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "scan_series": f"WITH {SAMPLES} SELECT event_id, round(value, 6) AS value, us FROM samples WHERE name = '{NAME}' AND agent_id = '{AGENT}' AND us BETWEEN {_A} AND {_B}",
    "dedup_points": f"""
WITH {SAMPLES}, cut AS (SELECT series, epoch_us(date_trunc('hour', ts)) AS us, value, event_id, 'gauge' AS type FROM keyed),
both_ AS (SELECT * FROM cut UNION ALL SELECT series, us, value + 1000, event_id + 10000000, 'counter' FROM cut WHERE event_id % 3 = 0)
SELECT series, 'gauge' AS type, round(arg_max(value, event_id), 6) AS value, us FROM both_ GROUP BY series, us""",
    "store_stats": f"WITH {SAMPLES} SELECT count(DISTINCT series) AS series, count(*) AS points FROM keyed",
    "sketched_stats": f"WITH {SAMPLES} SELECT name, count(*) AS points, true AS close FROM samples GROUP BY name",
    "tied_points": f"""
WITH {SAMPLES}, p AS (SELECT key, us // {_DAY} * {_DAY} AS us, value, event_id FROM samples WHERE name = '{NAME}'), ticks AS (SELECT i, {_A} + i * {_DAY} AS t FROM range(0, {(_B - _A) // _DAY} + 1) r(i)),
newest AS (SELECT i, key, arg_max(value, (us, event_id)) AS v FROM p JOIN ticks ON us BETWEEN t - {36 * 3_600_000_000} AND t GROUP BY i, key),
rise AS (SELECT i, key, arg_max(value, (us, event_id)) - arg_min(value, (us, event_id)) AS v FROM p JOIN ticks ON us BETWEEN t - {2 * 86_400_000_000} AND t GROUP BY i, key HAVING count(*) > 1)
SELECT n.i, n.key AS labels, round(n.v, 6) + 0.0 AS newest, round(r.v, 6) + 0.0 AS change FROM newest n LEFT JOIN rise r ON r.i = n.i AND r.key = n.key""",
    "live_feed": f"WITH {SAMPLES} SELECT name, 'gauge' AS type, round(value, 6) AS value, us, key AS labels FROM samples WHERE tenant = 't1'",
    "read_bench": """
WITH o AS (SELECT replace(o_orderpriority, ' ', '_') || '/x' AS name, CAST(o_orderkey % 3 + 1 AS VARCHAR) AS procs, CAST(round(o_totalprice, 2) AS DOUBLE) AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders WHERE o_orderkey % 10 <> 0)
SELECT name, unit, procs, count(*) AS n, round(sum(v), 2) AS total
FROM (SELECT name, procs, 'ns/op' AS unit, a AS v FROM o UNION ALL SELECT name, procs, 'B/op', b FROM o) GROUP BY name, unit, procs""",
    "match_labels": f"WITH {SAMPLES} SELECT event_id FROM samples WHERE shard = 's1' AND tenant = 't0'",
    "label_matcher": f"""WITH {SAMPLES} SELECT event_id, shard = 's1' AS eq, shard <> 's1' AS ne, regexp_full_match(agent_id, 'agent-[1-3]') AS re,
       NOT regexp_full_match(agent_id, 'agent-[1-3]|gent-5') AS nre, true AS absent FROM samples""",
    "match_all": f"""WITH {SAMPLES} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN false WHEN event_id % 2 = 0 THEN shard = 's1' AND tenant <> 't1'
       ELSE regexp_full_match(agent_id, 'agent-[0-4]') END AS matched FROM samples""",
    "filter_time": "SELECT event_id, epoch_us(ts) AS us FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'",
    "scope_tenant": f"WITH {SAMPLES} SELECT event_id, name, tenant FROM samples WHERE tenant = 't1'",
    "tenant_override": f"WITH {SAMPLES} SELECT series, us, round(value, 6) AS value FROM keyed WHERE name = '{NAME}' AND tenant = 't1' AND us BETWEEN {_A} AND {_B}",
    "resolve_relative_time": f"WITH {SAMPLES}, n AS (SELECT max(us) AS now FROM samples) SELECT event_id, us FROM samples, n WHERE us BETWEEN now - 10 * 86400000000 AND now - 36 * 3600000000",
    "series_key": f"WITH {_AWKWARD} SELECT o_orderkey, {_ESC.format('name')} || '{{a\\\\b=' || {_ESC.format('c')} || ',empty=,pri\\=or=' || {_ESC.format('p')} || '}}' AS series FROM awkward",
    "parse_series_key": f"WITH {_AWKWARD} SELECT o_orderkey, name, p AS priority, c AS customer, '' AS none, CAST(3 AS INTEGER) AS n FROM awkward",
    "canonical_labels": f"""WITH {_AWKWARD} SELECT o_orderkey, 'a\\b="' || c || '", empty="", pri=or="' || p || '"' AS text FROM awkward""",
    "merge_labels": f"WITH {SAMPLES} SELECT event_id, 'agent_id=' || agent_id || ',shard=moved,tenant=' || tenant || ',zone=' || event_id AS labels FROM samples",
    "query_raw": f"WITH {SAMPLES} SELECT series, us, round(value, 6) AS value FROM keyed WHERE name = '{NAME}' AND agent_id = '{AGENT}' AND us BETWEEN {_A} AND {_B}",
    "query_window": f"WITH {SAMPLES} " + _WINDOW.format("avg(value)", f"AND name = '{NAME}' AND agent_id = '{AGENT}'"),
    "query_window_open": f"""
WITH {SAMPLES}, f AS (SELECT *, min(us) OVER (PARTITION BY series) AS o FROM keyed)
SELECT series, CAST(o + (floor((us - o) / {36 * 3_600_000_000}.0) + 1) * {36 * 3_600_000_000} AS BIGINT) AS us, round(avg(value), 6) AS value FROM f GROUP BY 1, 2""",
    "query_whole": f"WITH {SAMPLES} SELECT series, max(us) AS us, round(avg(value), 6) AS value FROM keyed GROUP BY series",
    "query_limit": f"WITH {SAMPLES} SELECT series, us, round(value, 6) AS value FROM keyed WHERE name = '{NAME}' AND tenant = 't0' ORDER BY series, us LIMIT 10",
} | {f"agg_{a}": f"WITH {SAMPLES} " + _WINDOW.format(expr, "") for a, expr in _SQL_AGG.items()}
