"""Ranks and order statistics of large groups against those of small ones and against plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import compare, query, ranks

MEASURED = "name string, unit string, run string, value double"


@pytest.fixture(scope="module")
def measured(spark):
    rng = random.Random(2)
    odd = [0.0, -0.0, 1e-310, -1e-310, 1e300, -1e300, math.inf, -math.inf, 1.0, 1.0 + 2**-52, -1.0]
    value = lambda: rng.choice([rng.choice(odd), rng.gauss(0, 1), float(rng.randrange(-5, 5)), rng.uniform(1, 1 + 1e-9)])
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice(["s", None]), rng.choice(["old", "new"]), value()) for _ in range(3000)]
    return spark.createDataFrame(rows + [("alone", "s", "old", 3.0)], MEASURED)


def test_bits_have_the_order_of_doubles():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=1000), rng.integers(0, 1 << 63, 1000).view(np.float64), [0.0, np.inf, -np.inf, 5e-324, -5e-324]])
    v = np.sort(v[~np.isnan(v)])
    bits = ranks.order_bits.func(pd.Series(v)).to_numpy()
    assert (np.diff(bits)[np.diff(v) > 0] > 0).all()
    zeros, nan = ranks.order_bits.func(pd.Series([0.0, -0.0])), ranks.order_bits.func(pd.Series([np.nan, np.inf]))
    assert zeros[0] == zeros[1] and nan[0] > nan[1]


def same(a, b):
    plain = lambda df: sorted(tuple(str(r[c]).replace("-0.0", "0.0") for c in sorted(df.columns)) for r in df.collect())
    assert plain(a) == plain(b)


@pytest.mark.parametrize("run", [
    lambda m: compare.median_spread(m, ["name", "unit", "run"]),
    compare.rank_pooled,
    lambda m: compare.mann_whitney(m, "old", "new"),
    lambda m: query.order_statistic(m.filter("name IS NOT NULL").withColumn("ts", F.lit("2026-01-01").cast("timestamp")), ["name", "run"], 0.95),
])
def test_large_groups_give_what_small_ones_do(measured, monkeypatch, run):
    small = run(measured)
    expected = small.sparkSession.createDataFrame(small.collect(), small.schema)
    monkeypatch.setattr(ranks, "WIDE", 1)
    same(run(measured), expected)


@pytest.mark.parametrize("wide", [False, True])
def test_ranks_equal_plain_python(measured, monkeypatch, wide):
    monkeypatch.setattr(ranks, "WIDE", 1 if wide else 1 << 40)
    of = {}
    for r in measured.collect():
        of.setdefault((r["name"], r["unit"]), []).append(r["value"])
    for r in compare.rank_pooled(measured).collect():
        values = of[r["name"], r["unit"]]
        below, ties = sum(v < r["value"] for v in values), sum(v == r["value"] for v in values)
        assert (r["tied"], r["rank"]) == (ties, below + (ties + 1) / 2)


def test_one_group_of_ten_million_values_is_no_task_s_own(spark, monkeypatch):
    """No window over the group: nothing that is sorted together is longer than 65,536 rows, and tasks share the values."""
    n = 10_000_000
    rows = spark.range(n).select(F.lit("all").alias("k"), ((F.col("id") * 7_654_321) % n / 1000 - 2000).alias("value"), F.lit("2026-01-01").cast("timestamp").alias("ts"))
    assert ranks.is_wide(rows, ["k"])
    found = query.order_statistic(rows, ["k"], 0.99).collect()
    assert [r["value"] for r in found] == [math.floor((n - 1) * 0.99) / 1000 - 2000]
    counts = rows.groupBy("k", "value").agg(F.count("*").alias("_n"))
    levels = ranks._levels(counts, ["k"], "value")
    for bits in ranks.LEVELS[1:]:
        assert ranks._below(levels[bits]).groupBy("_k", "_above").count().agg(F.max("count")).head()[0] <= 1 << 16
    assert levels[48].count() <= 1 << 16
    share = ranks._below(levels[0]).repartition("_k", "_above").groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0]
    assert share < 0.6 * n  # of four tasks
    plan = ranks.at_places(counts, ["k"], {"p": F.lit(5)}, wide=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "partitionBy" not in plan and plan.count("Window [") == len(ranks.LEVELS)
