"""Range functions against plain Python: long ranges in two levels, points at one time in either row order, and how many rows a pane becomes."""

import math
import random
import statistics
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import vector
from pulsegrid.operators.vector import Engine, Grid

T0 = datetime(2026, 3, 1, tzinfo=UTC)
SCHEMA = "name string, type string, value double, ts timestamp, labels map<string,string>, seq long"
STEP, RANGE, TIMES = 60, 3600, 200


@pytest.fixture(scope="module")
def points():
    rng = random.Random(8)
    out = []
    for host, gap in (("a", 7), ("b", 90), ("c", 4000)):
        t = -5000.0
        while t < STEP * TIMES + 500:
            t += rng.choice([0, 0, rng.uniform(0, 2 * gap)])
            out.append((host, round(t * 1e6), rng.choice([rng.uniform(0, 9), 1e9 + rng.uniform(0, 1)]), len(out)))
    return out


def frame(spark, points):
    return spark.createDataFrame([("m", "gauge", v, T0 + timedelta(microseconds=us), {"host": h}, n) for h, us, v, n in points], SCHEMA)


def plain(points, i):
    """Every function at one time, for each series, from points in order of time and number."""
    start, end = (i * STEP - RANGE) * 10**6, i * STEP * 10**6
    out = {}
    for host in "abc":
        p = sorted((us, n, v) for h, us, v, n in points if h == host and start <= us <= end)
        v = [x[2] for x in p]
        if p:
            out[host] = {"last_over_time": v[-1], "sum_over_time": math.fsum(v), "avg_over_time": math.fsum(v) / len(v), "min_over_time": min(v), "max_over_time": max(v), "count_over_time": len(v), "stddev_over_time": statistics.pstdev(v)}
        if len(p) > 1:
            inc = sum(b if b < a else b - a for a, b in zip(v, v[1:], strict=False))
            out[host] |= {"delta": v[-1] - v[0], "increase": inc} | ({"rate": inc / ((p[-1][0] - p[0][0]) / 1e6)} if p[-1][0] > p[0][0] else {})
    return out


NAMES = ["last_over_time", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "count_over_time", "stddev_over_time", "delta", "increase", "rate"]


@pytest.mark.parametrize("long", [1, 1 << 40])
def test_long_ranges_equal_plain_python(spark, points, monkeypatch, long):
    monkeypatch.setattr(vector, "LONG", long)
    grid = Grid.over(T0, T0 + timedelta(seconds=STEP * (TIMES - 1)), f"{STEP}s")
    engine = Engine(frame(spark, points).repartition(3), grid, order="seq")
    expected = [plain(points, i) for i in range(TIMES)]
    for name in NAMES:
        rows = getattr(engine.metric("m").range(f"{RANGE}s"), name)().df.select("i", "key", "value").collect()
        got = {(r["i"], r["key"].partition("=")[2]): r["value"] for r in rows}
        wanted = {(i, h): x[name] for i, e in enumerate(expected) for h, x in e.items() if name in x}
        assert got.keys() == wanted.keys(), name
        for k, x in wanted.items():
            assert math.isclose(got[k], x, rel_tol=1e-9, abs_tol=1e-6), (name, k, got[k], x)


@pytest.mark.parametrize("order", ["seq", None])
def test_points_at_one_time_count_in_one_order(spark, order):
    """Two points at one time: the later number is the newest, or without numbers the greater value, whatever the rows' order."""
    rows = [("a", 0, 4.0, 0), ("a", 60_000_000, 50.0, 1), ("a", 60_000_000, 5.0, 2), ("a", 120_000_000, 60.0, 3)]
    newest, rise, change = (5.0, 46 + 5 + 55, 60 - 50) if order else (50.0, 1 + 45 + 10, 60 - 5)
    for some in (rows, rows[::-1], [rows[2], rows[0], rows[3], rows[1]]):
        for parts in (1, 4):
            engine = Engine(frame(spark, some).repartition(parts), Grid.over(T0, T0 + timedelta(minutes=2)), order=order)
            assert [r["value"] for r in engine.metric("m").instant().df.filter("i = 1").collect()] == [newest]
            assert [r["value"] for r in engine.metric("m").range("1m").last_over_time().df.filter("i = 1").collect()] == [newest]
            assert [r["value"] for r in engine.metric("m").range("5m").increase().df.filter("i = 2").collect()] == [rise]
            assert [r["value"] for r in engine.metric("m").range("1m").delta().df.filter("i = 2").collect()] == [change]


def test_a_pane_becomes_few_rows(spark):
    """A day's range at a minute's step: 1,441 times a point, in about three times their root of rows."""
    times, last = 1441, 5000
    panes = spark.range(0, last - times, 97).select(F.lit("k").alias("key"), F.col("id").alias("low"), (F.col("id") + times - 1).alias("high"))
    rows = vector._spread(panes, math.isqrt(times))
    counts = rows.join(panes.select("key"), "key", "left_semi").groupBy("size").count().collect()
    assert sum(r["count"] for r in counts) <= panes.count() * 3 * (math.isqrt(times) + 1)
    marked = rows.select(F.explode(F.sequence(F.col("place") * F.col("size"), (F.col("place") + 1) * F.col("size") - 1)).alias("i")).groupBy("i").count()
    plain_marked = panes.select(F.explode(F.sequence("low", "high")).alias("i")).groupBy("i").count()
    assert marked.exceptAll(plain_marked).count() == plain_marked.exceptAll(marked).count() == 0
