"""Agent batches into valid samples, and samples to and from tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.floats import finite
from pulsegrid.functions.labels import from_entries, match_labels, merge_labels, series_key, without
from pulsegrid.functions.times import epoch_micros, utc_date

#: Longest body of one batch, in bytes.
BODY_LIMIT = 1 << 20
#: Logarithm of the registers of a sketch of series.
SKETCH_BITS = 12
#: Labels that the server sets and clients cannot.
SERVER_LABELS = ["agent_id", "tenant"]

BATCH_SCHEMA = "agent_id string, metrics array<struct<name:string,type:string,value:double,timestamp:timestamp,labels:map<string,string>>>"
_FIELDS = {"batch": ["agent_id", "metrics"], "metric": ["name", "type", "value", "timestamp", "labels"]}


def metric_type(raw: Column) -> Column:
    """gauge or counter, from text in any case or the numbers 0 and 1; other text stays."""
    text = F.lower(F.trim(raw))
    return F.when(text.isin("0", "gauge"), "gauge").when(text.isin("1", "counter"), "counter").otherwise(raw)


def read_batches(lines: DataFrame, body: str = "value", limit: int = BODY_LIMIT) -> DataFrame:
    """Parse one JSON batch a row: all columns, `batch`, and `error` (null if good).

    Strict: over-long bodies, unknown fields at any level and anything after the object
    are errors. A row with an error has a null batch and can be put in quarantine.
    """
    text = F.trim(F.col(body))
    parsed = F.from_json(text, BATCH_SCHEMA, {"mode": "PERMISSIVE"})
    top = F.json_object_keys(text)
    each = F.from_json(F.get_json_object(text, "$.metrics"), "array<string>")
    inner = F.flatten(F.transform(each, lambda m: F.coalesce(F.json_object_keys(m), F.array().cast("array<string>"))))
    known = lambda names: F.array(*(F.lit(n) for n in names))
    # Parsers stop at the end of the first object; counted as the one element of an array, more text is an error.
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    error = (
        F.when(F.octet_length(F.col(body)) > limit, "body too large")
        .when(top.isNull() | parsed.isNull() | alone.isNull() | (alone != 1), "invalid json")
        .when(F.size(F.array_except(top, known(_FIELDS["batch"]))) > 0, "unknown field")
        .when(F.size(F.array_except(F.coalesce(inner, F.array().cast("array<string>")), known(_FIELDS["metric"]))) > 0, "unknown field")
    )
    fixed = F.struct(
        parsed["agent_id"].alias("agent_id"),
        F.transform(
            parsed["metrics"],
            lambda m: F.struct(m["name"].alias("name"), metric_type(m["type"]).alias("type"), m["value"].alias("value"), m["timestamp"].alias("timestamp"), m["labels"].alias("labels")),
        ).alias("metrics"),
    )
    return lines.withColumn("error", error).withColumn("batch", F.when(F.col("error").isNull(), fixed))


def validate_metric(m: Column) -> Column:
    """Why a metric of a batch is refused, or null."""
    return (
        F.when(F.coalesce(F.trim(m["name"]), F.lit("")) == "", "metric name is required")
        .when(~F.coalesce(m["type"].isin("gauge", "counter"), F.lit(False)), "unsupported metric type")
        .when(~F.coalesce(finite(m["value"]), F.lit(False)), "metric value must be finite")
        .when(m["timestamp"].isNull(), "timestamp is required")
    )


def validate_batch(batch: Column) -> Column:
    """Why a whole batch is refused, or null; a bad metric is named by its index, the first one only."""
    errors = F.transform(batch["metrics"], lambda m: F.coalesce(validate_metric(m), F.lit("")))
    first = F.array_position(F.transform(errors, lambda e: e != ""), True)
    return (
        F.when(F.coalesce(F.trim(batch["agent_id"]), F.lit("")) == "", "agent_id is required")
        .when(F.coalesce(F.size(batch["metrics"]), F.lit(0)) <= 0, "metrics list is empty")
        .when(first > 0, F.concat(F.lit("metric["), first - 1, F.lit("]: "), F.get(errors, (first - 1).cast("int"))))
    )


def unpack(batches: DataFrame, batch: str = "batch", tenant: Column | None = None) -> DataFrame:
    """One row for each metric: name, type, value, ts, labels.

    agent_id comes from the batch; tenant from the caller, and without one the label is
    removed, so no client can claim another's.
    """
    rows = batches.withColumn("_tenant", tenant if tenant is not None else F.lit(None).cast("string"))
    rows = rows.select(F.col(f"{batch}.agent_id").alias("_agent"), "_tenant", F.explode(f"{batch}.metrics").alias("m"))
    of = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    stamps = F.array_compact(F.array(of("agent_id", F.col("_agent")), F.when(F.coalesce(F.col("_tenant"), F.lit("")) != "", of("tenant", F.col("_tenant")))))
    labels = merge_labels(without(F.coalesce(F.col("m.labels"), F.create_map().cast("map<string,string>")), SERVER_LABELS), from_entries(stamps))
    return rows.select("m.name", "m.type", "m.value", F.col("m.timestamp").alias("ts"), labels.alias("labels"))


def validate_sample(samples: DataFrame) -> DataFrame:
    """All columns and `error`: why a sample is dropped, or null."""
    error = (
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", "metric name is empty")
        .when(F.col("name").rlike("[ \t\n]"), "metric name contains whitespace")
        .when(~F.coalesce(F.col("type").isin("gauge", "counter"), F.lit(False)), "unsupported metric type")
        .when(~F.coalesce(finite(F.col("value")), F.lit(False)), "value is NaN or Inf")
    )
    return samples.withColumn("error", error)


def enrich_timestamp(samples: DataFrame, now: Column | None = None) -> DataFrame:
    """Samples without a time get the present one."""
    return samples.withColumn("ts", F.coalesce("ts", now if now is not None else F.current_timestamp()))


def ingest_accounting(checked: DataFrame, failed: Column | None = None) -> DataFrame:
    """One row: ingested = stored + invalid + failed, from samples with `error`; `failed` marks valid ones that were not written."""
    lost = failed if failed is not None else F.lit(False)
    bad = F.col("error").isNotNull()
    count = lambda c: F.count(F.when(c, True))
    return checked.agg(F.count("*").alias("ingested"), count(bad).alias("invalid"), count(~bad & lost).alias("failed"), count(~bad & ~lost).alias("stored"))


def promoted(samples: DataFrame) -> DataFrame:
    """Samples with the columns that tables are partitioned and pruned by: the date in UTC, agent_id, tenant, series.

    Filters on map elements don't reach Parquet, so labels that matter are columns.
    """
    return samples.withColumns({"date": utc_date(F.col("ts")), "agent_id": F.col("labels")["agent_id"], "tenant": F.col("labels")["tenant"], "series": series_key(F.col("name"), F.col("labels"))})


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows dealt out by name and date for writing, and sorted by series and time.

    What goes to one directory comes from one task, or where a name and date have more than
    Spark's advised size of a partition, from as many as it takes: neither tasks times
    directories of small files, nor one task for a hot name.
    """
    return rows.hint("rebalance", F.col("name"), F.col("date")).sortWithinPartitions("name", "date", "series", "ts")


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Append to a table partitioned by name and date, sorted by series and time within files, so time filters skip row groups."""
    laid_out(promoted(samples)).write.mode(mode).partitionBy("name", "date").parquet(path)


def scan_series(source: DataFrame, name: str, labels: dict[str, str] | None = None, since=None, until=None) -> DataFrame:
    """Samples of one name with equal labels in a time range, both ends included.

    On a table of `write_samples`, the name and the dates prune partitions, times and
    the promoted labels are pushed to Parquet. Dates are those in UTC, so tables can be
    written and read under different zones; a bound without a zone is in UTC.
    """
    rows = source.filter(F.col("name") == name)
    for bound, low in ((since, True), (until, False)):
        if bound is not None:
            at = F.timestamp_micros(F.lit(epoch_micros(bound))) if isinstance(bound, datetime) else F.lit(bound).cast("timestamp")
            rows = rows.filter(F.col("ts") >= at if low else F.col("ts") <= at)
            if "date" in source.columns:
                rows = rows.filter(F.col("date") >= utc_date(at) if low else F.col("date") <= utc_date(at))
    for k, v in (labels or {}).items():
        if k in SERVER_LABELS and k in source.columns and v != "":
            rows = rows.filter(F.col(k) == v)
    return rows.filter(match_labels(F.col("labels"), labels or {}))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dedup_points(samples: DataFrame, order: str) -> DataFrame:
    """One value for each series and time, the last by `order`; a series has the type it was first written with."""
    rows = samples.withColumn("series", series_key(F.col("name"), F.col("labels")))
    latest = rows.groupBy("series", "ts").agg(F.max_by(F.struct("name", "labels", "value"), order).alias("s"), F.max(order).alias(order), F.min_by("type", order).alias("type"), F.min(order).alias("_first"))
    first = latest.groupBy("series").agg(F.min_by("type", "_first").alias("type"))
    return latest.drop("type", "_first").join(first, "series").select("series", "s.name", "type", "s.value", "ts", "s.labels", order)


def store_stats(samples: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: number of series, number of points."""
    key = series_key(F.col("name"), F.col("labels"))
    series = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return samples.agg(series.alias("series"), F.count("*").alias("points"))


def stats_sketches(samples: DataFrame) -> DataFrame:
    """(name, date, points, series_sketch): what is kept beside a table to know its numbers without reading it.

    Rows of what has been added are appended to those kept before: sketches of series merge, and points add up.
    """
    key = series_key(F.col("name"), F.col("labels"))
    return samples.groupBy("name", utc_date(F.col("ts")).alias("date")).agg(F.count("*").alias("points"), F.hll_sketch_agg(key, SKETCH_BITS).alias("series_sketch"))


def sketched_stats(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, series, points) from kept sketches alone; the number of series is off by about 1.6 per cent."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("series_sketch")).alias("series"), F.sum("points").alias("points"))


def live_feed(samples: DataFrame, tenant: str = "") -> DataFrame:
    """What a live view of one tenant shows; all tenants for the empty name. Works on streams alike."""
    rows = samples if tenant == "" else samples.filter(match_labels(F.col("labels"), {"tenant": tenant}))
    return rows.select("name", "type", "value", F.col("ts").alias("timestamp"), "labels")


def live_feeds(samples: DataFrame, clients: DataFrame) -> DataFrame:
    """What each of many live views (client, tenant) shows, from samples or a stream of them, read once for all.

    A sample goes to the clients of its tenant and to those without one.
    """
    scopes = F.array_distinct(F.array(F.coalesce(F.col("labels")["tenant"], F.lit("")), F.lit("")))
    rows = samples.select("name", "type", "value", F.col("ts").alias("timestamp"), "labels", F.explode(scopes).alias("_scope"))
    return rows.join(clients.select("client", F.coalesce("tenant", F.lit("")).alias("_scope")), "_scope").drop("_scope").select("client", "name", "type", "value", "timestamp", "labels")


def read_bench(lines: DataFrame, text: str = "value", run: Column | None = None) -> DataFrame:
    """(name, unit, value, run, procs) from benchmark output, other lines skipped.

    A result line is a name that begins with Benchmark, a whole number of iterations,
    and pairs of value and unit; the pairs end at the first that isn't a number. A
    -N at the name's end is the number of processors.
    """
    parts = F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ")
    rows = lines.select((run if run is not None else F.lit("")).alias("run"), parts.alias("p"))
    rows = rows.filter((F.size("p") >= 4) & F.get("p", F.lit(0)).startswith("Benchmark") & F.get("p", F.lit(1)).rlike(r"^[+-]?\d+$"))
    name = F.regexp_replace(F.get("p", F.lit(0)), "^Benchmark", "")
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("p") - 4) / 2).cast("int")),
        lambda i: F.struct(F.get(F.col("p"), 2 * i + 2).try_cast("double").alias("value"), F.get(F.col("p"), 2 * i + 3).alias("unit")),
    )
    bad = F.array_position(F.transform(pairs, lambda x: x["value"].isNull()), True)
    good = F.when(bad > 0, F.slice(pairs, F.lit(1), (bad - 1).cast("int"))).otherwise(pairs)
    procs = F.regexp_extract(name, r"-(\d+)$", 1)
    rows = rows.select(F.regexp_replace(name, r"-\d+$", "").alias("name"), F.when(procs == "", "1").otherwise(procs).alias("procs"), "run", F.explode(good).alias("m"))
    return rows.select("name", "m.unit", "m.value", "run", "procs")


def mixed_procs(measurements: DataFrame) -> DataFrame:
    """Names of a run that were measured with several numbers of processors."""
    return measurements.groupBy("run", "name").agg(F.array_sort(F.collect_set("procs")).alias("procs")).filter(F.size("procs") > 1)


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
