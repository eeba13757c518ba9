"""Point queries: raw samples, or one aggregate for each window of each series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.labels import match_labels, series_key
from pulsegrid.functions.times import epoch_micros, micros
from pulsegrid.operators import ranks
from pulsegrid.sources.ingest import scan_series

AGGREGATORS = {
    "avg": F.avg,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": lambda v: F.count(v).cast("double"),
}
#: Order statistics: the value at place floor((n - 1) p) from 0.
PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def filter_time(samples: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Samples from `since` to `until`, both included; open where not given."""
    rows = samples
    if since is not None:
        rows = rows.filter(F.unix_micros("ts") >= epoch_micros(since))
    if until is not None:
        rows = rows.filter(F.unix_micros("ts") <= epoch_micros(until))
    return rows


def scope_tenant(samples: DataFrame, tenant: str) -> DataFrame:
    """Only the caller's tenant, whatever else was asked for; the empty tenant sees all."""
    return samples if tenant == "" else samples.filter(match_labels(F.col("labels"), {"tenant": tenant}))


def order_statistic(rows: DataFrame, keys: list[str], p: float, value: str = "value") -> DataFrame:
    """(keys, value, last): the value at place floor((n - 1) p) of each group, and the group's last time."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.max("ts").alias("_ts"))
    place = F.floor((F.col("_all") - 1) * F.lit(float(p)))
    if ranks.is_wide(rows, keys):
        found = ranks.at_places(counts, keys, {"_value": place}, wide=True, value=value)
        return found.join(rows.groupBy(*keys).agg(F.max("ts").alias("last")), keys).select(*keys, F.col("_value").alias("value"), "last")
    whole = Window.partitionBy(*keys)
    upto = F.sum("_n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(whole), "last": F.max("_ts").over(whole)})
    return ranked.filter((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n"))).select(*keys, F.col(value).alias("value"), "last")


def query_raw(samples: DataFrame, name: str, labels: dict[str, str] | None = None, since=None, until=None) -> DataFrame:
    """Points of the matching series."""
    return filter_time(scan_series(samples, name, labels), since, until).select("name", "type", "value", "ts", "labels")


def query_window(samples: DataFrame, agg: str, step: str | int, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """(series, ts, value): one aggregate for each window of `step` that has points; ts is the window's end.

    Windows are [start, start + step) from `since`, or from the series' first point.
    """
    width = micros(step) if isinstance(step, str) else step
    rows = filter_time(samples, since, until).select(series_key(F.col("name"), F.col("labels")).alias("series"), "ts", "value")
    if width <= 0:
        return query_whole(samples, agg, since, until)
    if since is not None:
        origin: Column = F.lit(epoch_micros(since))
    else:
        # The first points come from an aggregate, so long series aren't sorted for it.
        first = rows.groupBy("series").agg(F.min("ts").alias("_first"))
        rows = rows.join(first, "series")
        origin = F.unix_micros("_first")
    bucket = F.floor((F.unix_micros("ts") - origin) / width).cast("long")
    rows = rows.withColumn("end", F.timestamp_micros(origin + (bucket + 1) * width))
    if agg in PERCENTILES:
        return order_statistic(rows, ["series", "end"], PERCENTILES[agg]).select("series", F.col("end").alias("ts"), "value")
    return rows.groupBy("series", "end").agg(AGGREGATORS[agg]("value").alias("value")).select("series", F.col("end").alias("ts"), "value")


def query_whole(samples: DataFrame, agg: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """(series, ts, value): one aggregate for each series over all its points; ts is its last point."""
    rows = filter_time(samples, since, until).select(series_key(F.col("name"), F.col("labels")).alias("series"), "ts", "value")
    if agg in PERCENTILES:
        return order_statistic(rows, ["series"], PERCENTILES[agg]).select("series", F.col("last").alias("ts"), "value")
    return rows.groupBy("series").agg(F.max("ts").alias("ts"), AGGREGATORS[agg]("value").alias("value"))


def query(
    samples: DataFrame, name: str, labels: dict[str, str] | None = None, since=None, until=None, agg: str | None = None, step: str | None = None, limit: int | None = None, tenant: str = ""
) -> DataFrame:
    """The whole point query: selection, tenant, raw points or windows, and a limit over all series in order."""
    if step is not None and agg is None:
        raise ValueError("a step needs an aggregator")
    if agg is not None and agg not in AGGREGATORS and agg not in PERCENTILES:
        raise ValueError(f"unknown aggregator {agg!r}")
    # The caller's tenant stands in for one that was asked for.
    wanted = (labels or {}) | ({"tenant": tenant} if tenant else {})
    found = scan_series(samples, name, wanted, since, until)
    if agg is None:
        out = filter_time(found, since, until).select(series_key(F.col("name"), F.col("labels")).alias("series"), "ts", "value")
    else:
        out = query_window(found, agg, step, since, until) if step else query_whole(found, agg, since, until)
    return query_limit(out, limit) if limit else out


def query_limit(points: DataFrame, n: int) -> DataFrame:
    """The first n points by series and time; n <= 0 keeps all."""
    return points.orderBy("series", "ts").limit(n) if n > 0 else points
