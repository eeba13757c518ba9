"""Comparison of two runs of measurements, many quantities at once.

Measurements are (name, unit, value, run). Ranks are those of counted values, whatever
a quantity's size; the test's p-value is the one step Spark has no function for, and runs
vectorised over one row for each quantity.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import ranks

#: Most values on a side for which the exact distribution is used.
EXACT_LIMIT = 20
ALPHA = 0.05
KEY = ["name", "unit"]


def median_spread(measurements: DataFrame, keys: list[str], wide: bool | None = None) -> DataFrame:
    """(keys, n, median, spread): spread is half the range in per cent of the median; 0 for one value or a median of 0.

    `wide` says whether a group can be large, and is found out if not given.
    """
    counts = measurements.groupBy(*keys, "value").agg(F.count("value").alias("_n"))
    last = F.col("_all") - 1
    places = {"_left": F.floor(last / 2), "_right": F.floor(F.col("_all") / 2), "low": F.lit(0), "high": last}
    found = ranks.at_places(counts, keys, places, ranks.is_wide(measurements, keys) if wide is None else wide)
    # The middle value, or the mean of both middle ones.
    rows = found.withColumns({"n": F.col("_all"), "median": F.col("_left") / 2 + F.col("_right") / 2})
    spread = F.when((F.col("n") < 2) | (F.col("median") == 0), 0.0).otherwise((F.col("high") - F.col("low")) / 2 / F.abs("median") * 100)
    return rows.select(*keys, "n", "median", spread.alias("spread"))


def _ranked(measurements: DataFrame, *more: Column, wide: bool | None = None) -> DataFrame:
    """(KEY, value, rank, tied, more): each value of a quantity once, with the average rank of all that share it; `more` are aggregates of those."""
    counts = measurements.groupBy(*KEY, "value").agg(F.count("*").alias("_n"), *more)
    found = ranks.cumulative(counts, KEY, ranks.is_wide(measurements, KEY) if wide is None else wide)
    rank = F.col("_upto") - (F.col("_n") - 1) / 2
    return found.withColumn("rank", rank).withColumnRenamed("_n", "tied").drop("_upto", "_all")


def _with_values(rows: DataFrame, ranked: DataFrame, how: str) -> DataFrame:
    """Rows with what is known of their quantity's values."""
    names = {c: f"_{c}" for c in (*KEY, "value")}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return rows.join(ranked.withColumnsRenamed(names), same, how).drop(*names.values())


def rank_pooled(measurements: DataFrame) -> DataFrame:
    """All columns, `rank` (ties share their average) within a quantity over both runs, and `tied`, how many share the value."""
    return _with_values(measurements, _ranked(measurements), "inner")


@lru_cache(maxsize=None)
def u_distribution(n1: int, n2: int) -> tuple[float, ...]:
    """How many of the orders of n1 and n2 different values give each U: the coefficients of a Gaussian binomial.

    They are the product of (1 - x^(n2 + i)) / (1 - x^i) for i from 1 to n1.
    """
    size = n1 * n2 + 1
    ways = [1.0] + [0.0] * (size - 1)
    for i in range(1, n1 + 1):
        for k in range(size - 1, n2 + i - 1, -1):
            ways[k] -= ways[k - n2 - i]
        for k in range(i, size):
            ways[k] += ways[k - i]
    return tuple(ways)


def p_value(n1: int, n2: int, u: float, ties: float) -> tuple[float, str]:
    """Two-sided p-value of the smaller U, and the method: exact without ties up to EXACT_LIMIT a side, else normal with corrections."""
    if n1 == 0 or n2 == 0:
        return 1.0, "none"
    if ties == 0 and max(n1, n2) <= EXACT_LIMIT:
        ways = u_distribution(n1, n2)
        return min(1.0, 2 * sum(ways[: math.floor(u) + 1]) / sum(ways)), "exact"
    n = n1 + n2
    variance = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if variance <= 0:
        return 1.0, "normal"
    z = min(0.0, (u - n1 * n2 / 2 + 0.5) / math.sqrt(variance))
    return min(1.0, math.erfc(-z / math.sqrt(2))), "normal"


@F.pandas_udf(T.StructType([T.StructField("p", T.DoubleType()), T.StructField("method", T.StringType())]))
def _p_values(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([p_value(int(a), int(b), float(x), float(t)) for a, b, x, t in zip(n1, n2, u, ties, strict=True)], columns=["p", "method"])


def mann_whitney(measurements: DataFrame, old: str, new: str, wide: bool | None = None) -> DataFrame:
    """(name, unit, n1, n2, u, ties, p, method) for each quantity of either run."""
    of = lambda run: F.count(F.when(F.col("run") == run, True))
    ranked = _ranked(measurements.filter(F.col("run").isin(old, new)), of(old).alias("_old"), of(new).alias("_new"), wide=wide)
    t = F.col("tied").cast("double")
    rows = ranked.groupBy(*KEY).agg(
        F.sum("_old").alias("n1"),
        F.sum("_new").alias("n2"),
        F.sum(F.col("rank") * F.col("_old")).alias("r1"),
        F.sum(t * t * t - t).alias("ties"),
    )
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    rows = rows.withColumn("u", F.least(u1, F.col("n1") * F.col("n2") - u1)).withColumn("_p", _p_values("n1", "n2", "u", "ties"))
    return rows.select(*KEY, "n1", "n2", "u", "ties", "_p.p", "_p.method")


def percent_delta(old: Column, new: Column) -> Column:
    """Change in per cent; from 0 to anything else it is infinite."""
    return F.when(old == 0, F.when(new == 0, 0.0).otherwise(math.inf)).otherwise((new - old) / old * 100)


def compare_runs(measurements: DataFrame, old: str, new: str, alpha: float = ALPHA) -> DataFrame:
    """One row for each quantity: both medians, spreads and counts, delta, p, method, significant, and `side`: both, old or new."""
    # Where no quantity is large, none is in one run.
    wide = ranks.is_wide(measurements, KEY)
    stats = median_spread(measurements.filter(F.col("run").isin(old, new)), [*KEY, "run"], wide)
    of = lambda run, p: stats.filter(F.col("run") == run).select(*KEY, *(F.col(c).alias(f"{p}_{c}") for c in ("n", "median", "spread")))
    both = of(old, "old").join(of(new, "new"), KEY, "full").join(mann_whitney(measurements, old, new, wide).select(*KEY, "p", "method"), KEY)
    side = F.when(F.col("old_n").isNull(), "new").when(F.col("new_n").isNull(), "old").otherwise("both")
    paired = side == "both"
    return both.select(
        *KEY, side.alias("side"), "old_n", "old_median", "old_spread", "new_n", "new_median", "new_spread",
        F.when(paired, percent_delta(F.col("old_median"), F.col("new_median"))).alias("delta"),
        F.when(paired, F.col("p")).alias("p"), F.when(paired, F.col("method")).alias("method"), F.when(paired, F.col("p") < alpha).alias("significant"),
    )
