"""Exact ranks and order statistics of groups of any size.

Values are counted first. A group of fewer than WIDE rows is put in order by a window. A
larger one isn't, by any task: doubles become 64-bit numbers of the same order, and the
counts are added up for the upper 48, 32 and 16 bits of them. At each of these levels a
prefix has at most 65,536 next ones, and that is all that is ever sorted together. An
order statistic goes down from the upper 16 bits, at each level into the one prefix that
holds its rank, so of the values themselves only 65,536 are looked at for each group. Ranks of all values go
down all prefixes, which are spread over the tasks.

Keys may be null. NaN is the largest value, and both zeros are one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a group from which on it isn't sorted by one task.
WIDE = 1 << 20
#: Bits that the levels leave out, from the top down.
LEVELS = (48, 32, 16, 0)


@F.pandas_udf(T.LongType())
def order_bits(values: pd.Series) -> pd.Series:
    """Numbers in the order of doubles: negative ones have their lower bits turned round."""
    v = values.to_numpy(dtype=np.float64) + 0.0
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def is_wide(rows: DataFrame, keys: list[str]) -> bool:
    """Whether some group has WIDE rows or more."""
    return (rows.groupBy(*keys).count().agg(F.max("count").alias("n")).head()["n"] or 0) >= WIDE


def _levels(counts: DataFrame, keys: list[str], value: str) -> dict[int, DataFrame]:
    """For each of LEVELS, (_k, _p, _n): how many values have each prefix; for the last, `_v` too, the value and more columns."""
    more = [c for c in counts.columns if c not in (*keys, value, "_n")]
    level = counts.select(F.struct(*keys).alias("_k"), order_bits(value).alias("_p"), "_n", F.struct(F.col(value).alias("value"), *more).alias("_v"))
    out = {LEVELS[-1]: level}
    for bits in reversed(LEVELS[:-1]):
        level = level.groupBy("_k", F.shiftright("_p", 16).alias("_p")).agg(F.sum("_n").alias("_n"))
        out[bits] = level
    return out


def _below(level: DataFrame) -> DataFrame:
    """A level with the prefix above as `_above`."""
    return level.withColumn("_above", F.shiftright("_p", 16))


def cumulative(counts: DataFrame, keys: list[str], wide: bool, value: str = "value") -> DataFrame:
    """Counted values (keys, value, _n and more columns) with `_upto` and `_all`: how many of the group are up to each, and in all."""
    if not wide:
        whole = Window.partitionBy(*keys)
        upto = F.sum("_n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(whole)})
    levels = _levels(counts, keys, value)
    running = lambda *by: F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    above = levels[LEVELS[0]].withColumns({"_upto": running("_k"), "_all": F.sum("_n").over(Window.partitionBy("_k"))})
    for bits in LEVELS[1:]:
        above = above.select("_k", F.col("_p").alias("_above"), (F.col("_upto") - F.col("_n")).alias("_before"), "_all")
        above = _below(levels[bits]).join(above, ["_k", "_above"]).withColumn("_upto", F.col("_before") + running("_k", "_above"))
    more = [F.col(f"_v.{c}") for c in counts.columns if c not in (*keys, value, "_n")]
    return above.select("_k.*", F.col("_v.value").alias(value), "_n", *more, "_upto", "_all")


def at_places(counts: DataFrame, keys: list[str], places: dict[str, Column], wide: bool, value: str = "value") -> DataFrame:
    """(keys, _all, one column for each of `places`): the values at places of each group in order, counted from 0 and given in terms of `_all`."""
    if not wide:
        ranked = cumulative(counts, keys, wide, value)
        inside = lambda place: (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n"))
        return ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *(F.max(F.when(inside(place), F.col(value))).alias(name) for name, place in places.items()))
    levels = _levels(counts, keys, value)
    whole = levels[LEVELS[0]].groupBy("_k").agg(F.sum("_n").alias("_all"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in places.items()))).alias("q")
    found = whole.select("_k", "_all", asked).select("_k", "_all", F.col("q.name").alias("_name"), F.col("q.place").alias("_place"))
    upto = F.sum("_n").over(Window.partitionBy("_k", "_name").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    for bits in LEVELS:
        level, on = (levels[bits], ["_k"]) if bits == LEVELS[0] else (_below(levels[bits]), ["_k", "_above"])
        found = level.join(found, on).withColumn("_upto", upto).filter((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_n")))
        left = (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_place")
        found = found.select("_k", "_all", "_name", left, F.col("_p").alias("_above"), *(["_v"] if bits == LEVELS[-1] else []))
    return found.groupBy("_k", "_all").agg(*(F.max(F.when(F.col("_name") == name, F.col("_v.value"))).alias(name) for name in places)).select("_k.*", "_all", *places)
