"""Streaming forms of ingest, windows and rule evaluation.

Sources are any readStream frame; the same Column functions run as in batch. Rates are
bounded at the source (maxFilesPerTrigger, maxOffsetsPerTrigger).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from pulsegrid.functions.labels import series_key
from pulsegrid.functions.times import micros
from pulsegrid.operators.query import AGGREGATORS, PERCENTILES
from pulsegrid.operators.rules import Rule, evaluate
from pulsegrid.operators.vector import Engine, Grid, Vector
from pulsegrid.sources import ingest, shared

#: Evaluation times in one plan of a rule on a stream.
MOST_TICKS = 5000
EPOCH = date(1970, 1, 1).toordinal()


def write_batch(rows: DataFrame, table: str, number: int) -> None:
    """Samples of a numbered batch, by date, batch and name; what an earlier run of the batch has left there goes first."""
    spark = rows.sparkSession
    shared.remove(spark, f"{table}/date=*/batch={number}")
    rows = ingest.laid_out(ingest.promoted(rows)).withColumn("batch", F.lit(number).cast("long"))
    rows.write.mode("append").partitionBy("date", "batch", "name").parquet(table)


def read_table(spark: SparkSession, table: str, schema: T.StructType, since_us: int, until_us: int) -> DataFrame:
    """The samples of the dates between two times; only directories of those dates are listed, whatever else is stored."""
    day = micros("24h")
    dates = [str(date.fromordinal(EPOCH + d)) for d in range(since_us // day, until_us // day + 1)]
    paths = shared.present(spark, [f"{table}/date={d}" for d in dates])
    fields = [f for f in schema.fields if f.name not in ("name", "date", "batch", "agent_id", "tenant", "series")]
    fields += [T.StructField(n, T.StringType()) for n in ("agent_id", "tenant", "series")]
    fields += [T.StructField("date", T.DateType()), T.StructField("batch", T.LongType()), T.StructField("name", T.StringType())]
    stored = T.StructType(fields)
    return spark.read.schema(stored).option("basePath", table).parquet(*paths) if paths else spark.createDataFrame([], stored)


class IngestRunner:
    """foreachBatch sink of JSON batches: samples to a table, the rest to a quarantine, and counts, each under the batch's number.

    `root` gets the folders samples (by date, batch and name), refused (lines that are no
    batch), rejected (samples with an error) and counts (batch, ingested, stored, invalid,
    failed, refused). A batch that runs again replaces all of its own. Every sample of a good line is ingested and
    either stored, invalid, or failed: valid, but one that `refuse` keeps out of the table.
    """

    def __init__(self, root: str, tenant: Column | None = None, now: Column | None = None, refuse: Column | None = None):
        self.root, self.tenant, self.now, self.refuse = root, tenant, now, refuse

    def __call__(self, batch: DataFrame, number: int) -> None:
        lines = ingest.read_batches(batch).persist()
        samples = ingest.validate_sample(ingest.unpack(lines.filter("error IS NULL"), tenant=self.tenant))
        samples = ingest.enrich_timestamp(samples, self.now)
        refused = F.coalesce(self.refuse, F.lit(False)) if self.refuse is not None else F.lit(False)
        samples = samples.withColumn("failed", F.col("error").isNull() & refused).persist()
        try:
            write_batch(samples.filter("error IS NULL AND NOT failed").drop("error", "failed"), f"{self.root}/samples", number)
            self._keep(samples.filter("error IS NOT NULL OR failed"), "rejected", number)
            broken = lines.filter("error IS NOT NULL").drop("batch")
            self._keep(broken, "refused", number)
            self._keep(ingest.ingest_accounting(samples, F.col("failed")).withColumn("refused", F.lit(broken.count()).cast("long")), "counts", number)
        finally:
            samples.unpersist()
            lines.unpersist()

    def _keep(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")


def stream_ingest(lines: DataFrame, runner: IngestRunner, checkpoint: str) -> DataStreamWriter:
    """JSON batches to the samples table: parse, unpack, validate, fill in times, write; what is not good is kept and counted.

    The writer is returned unstarted, so the caller picks the trigger.
    """
    return lines.writeStream.foreachBatch(runner).option("checkpointLocation", checkpoint)


def stream_dedup(samples: DataFrame, watermark: str) -> DataFrame:
    """The first sample of each series and time; the first that comes wins.

    Repeats are known for as long as the watermark reaches back, and samples that come
    later than that are dropped, so no repeat gets through and the state is bounded by the time.
    """
    rows = samples.withColumn("series", series_key(F.col("name"), F.col("labels"))).withWatermark("ts", watermark)
    return rows.dropDuplicatesWithinWatermark(["series", "ts"])


def stream_window(samples: DataFrame, agg: str, step: str, since_us: int = 0, watermark: str = "10 minutes") -> DataFrame:
    """(series, ts, value) of windows that the watermark has closed; windows count from a fixed origin, and ts is their end.

    For order statistics equal values are counted in a state of their own, and a closed
    window's counts go on to a second one: states hold a window's distinct values, not its samples.
    """
    width = micros(step)
    span = F.window("ts", f"{width} microseconds", startTime=f"{since_us % width} microseconds")
    rows = samples.withWatermark("ts", watermark).select("ts", series_key(F.col("name"), F.col("labels")).alias("series"), "value")
    if agg in PERCENTILES:
        counts = rows.groupBy(span.alias("closed"), "series", "value").agg(F.count(F.lit(1)).alias("n"))
        again = F.window(F.window_time("closed"), f"{width} microseconds", startTime=f"{since_us % width} microseconds")
        closed = counts.groupBy(again, "series").agg(F.collect_list(F.struct("value", "n")).alias("counts"), F.sum("n").alias("whole"))
        place = F.floor((F.col("whole") - 1) * F.lit(PERCENTILES[agg]))
        out = closed.select("window", "series", _at_place(F.sort_array("counts"), place).alias("value"))
    else:
        out = rows.groupBy(span, "series").agg(AGGREGATORS[agg]("value").alias("value"))
    return out.select("series", F.col("window.end").alias("ts"), "value")


def _at_place(counts: Column, place: Column) -> Column:
    """The value at a place of counted values in order; `place` is worked out at every value, so it must be a column, not a walk over them."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("value"))
    step = lambda s, x: F.struct((s["upto"] + x["n"]).alias("upto"), F.when(s["upto"] <= place, x["value"]).otherwise(s["value"]).alias("value"))
    return F.aggregate(counts, start, step, lambda s: s["value"])


class RuleRunner:
    """foreachBatch sink that stores samples and evaluates a rule at every time that has passed.

    A batch is written by date, under its own number and by name, so one that runs twice
    replaces itself, and a rule lists the directories of the dates it looks back to, not of all batches so far. A time counts as passed once a sample of `delay` later has come. The
    newest time of all batches so far is a row under the batch's number, so the next one
    reads that row and its own samples, and the rule only the names, dates and times that
    its selectors look back to. Samples dated after `ahead` from now, by the clock `now`,
    move nothing: they are stored, and count once their time has come and a later batch
    with them. At most MOST_TICKS times are evaluated in one plan.
    """

    def __init__(
        self, rule: Rule, build: Callable[[Engine], Vector], table: str, results: str, start_us: int, lookback: str, delay: str = "0s", ahead: str = "5m", now: Callable[[], int] = lambda: time.time_ns() // 1000
    ):
        self.rule, self.build, self.table, self.results = rule, build, table, results
        self.start, self.step, self.lookback, self.delay = start_us, micros(rule.interval), lookback, micros(delay)
        self.ahead, self.now = micros(ahead), now

    def _passed(self, us: int | None) -> int:
        """The last evaluation time that has passed at a newest time, or -1."""
        return -1 if us is None or us - self.delay < self.start else (us - self.delay - self.start) // self.step

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch.persist()
        limit, us = self.now() + self.ahead, F.unix_micros("ts")
        came = rows.agg(F.max(F.when(us <= limit, us)).alias("us")).head()["us"]
        write_batch(rows, self.table, number)
        rows.unpersist()
        before = spark.read.parquet(f"{self.table}-newest/batch={number - 1}").head()["us"] if number else None
        newest = max((x for x in (before, came) if x is not None), default=None)
        spark.createDataFrame([(newest,)], "us long").coalesce(1).write.mode("overwrite").parquet(f"{self.table}-newest/batch={number}")
        first, final = self._passed(before) + 1, self._passed(newest)
        if final < first:
            return
        for at in range(first, final + 1, MOST_TICKS):
            grid = Grid(self.start + at * self.step, self.step, min(final - at, MOST_TICKS - 1))
            stored = lambda since, until: read_table(spark, self.table, batch.schema, since, until).filter(F.col("batch") <= number)
            found = evaluate(self.rule, self.build(Engine(stored, grid, tenant=self.rule.tenant, lookback=self.lookback)))
            found = found.withColumns({"i": F.col("i") + at, "at": grid.time(F.col("i"))})
            found.write.mode("overwrite" if at == first else "append").parquet(f"{self.results}/batch={number}")


def stream_rules(samples: DataFrame, runner: RuleRunner, checkpoint: str) -> DataStreamWriter:
    """Periodic evaluation of a rule over samples as they come."""
    return samples.writeStream.foreachBatch(runner).option("checkpointLocation", checkpoint)
