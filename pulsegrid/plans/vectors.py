"""Queries on the vector algebra, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.labels import Matcher
from pulsegrid.operators.vector import Engine, Grid, Vector, literal
from pulsegrid.plans.points import SAMPLES, _us, rounded, us
from pulsegrid.sources import events

START, END, STEP, LOOKBACK, RANGE = datetime(2024, 1, 3), datetime(2024, 1, 28), "12h", "48h", "48h"
GRID = Grid.over(START, END, STEP)
_STEP, _TWO_DAYS = GRID.step, 48 * 3_600_000_000

#: A view of samples with fewer labels, so that aggregates and samples without labels meet.
COUNTERS = f"""{SAMPLES}, numbered AS (
    SELECT *, (row_number() OVER (PARTITION BY series ORDER BY us, event_id) - 1) // 20 AS life FROM keyed
), counters AS (
    SELECT name, key, series, us, sum(value) OVER (PARTITION BY series, life ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS value FROM numbered
), ticks AS (SELECT i, {_us(START)} + i * {_STEP} AS t FROM range(0, {GRID.last + 1}) r(i))"""


def engine(spark, sf_dir: str, counters: bool = False) -> Engine:
    made = events.counters if counters else events.samples
    return Engine(made(spark, sf_dir), GRID, lookback=LOOKBACK)


def shown(vector: Vector) -> DataFrame:
    """t in microseconds, the label set as text, the value to six places."""
    return vector.result().select(us("t").alias("t"), F.col("key").alias("labels"), rounded())


def _instant(name: str) -> str:
    return f"""SELECT i, t, key, arg_max(value, us) AS value FROM keyed JOIN ticks ON us BETWEEN t - {_TWO_DAYS} AND t WHERE name = '{name}' GROUP BY i, t, key"""


def _shown(body: str) -> str:
    return f"WITH {COUNTERS}, p AS ({_instant('purchase')}), c AS ({_instant('click')}), r AS ({body}) SELECT t, key AS labels, round(value, 6) + 0.0 AS value FROM r"


def instant_vector(spark, sf_dir):
    return shown(engine(spark, sf_dir).metric("purchase", Matcher("agent_id", "=~", "agent-[0-3]")).instant())


def range_vector(spark, sf_dir):
    """Number and sum of the points of each range."""
    points = engine(spark, sf_dir).metric("purchase").range(RANGE).points()
    return points.groupBy("i", "key").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), rounded(F.sum("value"), "total")).select(us(GRID.time(F.col("i"))).alias("t"), F.col("key").alias("labels"), "n", "first_us", "total")


def scalar_guard(spark, sf_dir):
    """Series of samples that may be without labels: the check that none is a scalar runs, and all pass."""
    e = Engine(events.samples(spark, sf_dir), GRID, lookback=LOOKBACK, labelled=False)
    return shown((e.metric("purchase").instant() > 50.0).and_(e.metric("click").instant() > 50.0))


def literal_(spark, sf_dir):
    """A number added to the number of series at each time."""
    e = engine(spark, sf_dir)
    return shown(literal(e, 2.5) + e.metric("purchase").instant().agg("count"))


_RANGED = ("rate", "increase", "delta", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "count_over_time", "last_over_time", "stddev_over_time")


def _ranged(name):
    def run(spark, sf_dir):
        counters = name in ("rate", "increase")
        return shown(getattr(engine(spark, sf_dir, counters).metric("purchase").range(RANGE), name)())

    return run


_REDUCED = {
    "delta": ("arg_max(value, us) - arg_min(value, us)", 2),
    "sum_over_time": ("sum(value)", 1),
    "avg_over_time": ("avg(value)", 1),
    "min_over_time": ("min(value)", 1),
    "max_over_time": ("max(value)", 1),
    "count_over_time": ("CAST(count(*) AS DOUBLE)", 1),
    "last_over_time": ("arg_max(value, us)", 1),
    "stddev_over_time": ("stddev_pop(value)", 1),
}
_INCREMENTS = f"""WITH {COUNTERS}, d AS (
    SELECT key, us, lag(us) OVER w AS us0, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS inc
    FROM counters WHERE name = 'purchase' WINDOW w AS (PARTITION BY key ORDER BY us)
), g AS (
    SELECT t, key, sum(CASE WHEN us0 >= t - {_TWO_DAYS} THEN inc END) AS inc, count(*) AS n, max(us) - min(us) AS span
    FROM d JOIN ticks ON us BETWEEN t - {_TWO_DAYS} AND t GROUP BY t, key
) SELECT t, key AS labels, round({{0}}, 6) AS value FROM g WHERE n >= 2 AND span > 0"""


def _of(build):
    def run(spark, sf_dir):
        e = engine(spark, sf_dir)
        return shown(build(e.metric("purchase").instant(), e.metric("click").instant()))

    return run


#: name: (expression over purchases p and clicks c, the same in SQL).
EXPRESSIONS = {
    "abs": (lambda p, c: (p - 250.0).abs(), "SELECT t, key, abs(value - 250) AS value FROM p"),
    "ceil": (lambda p, c: (p - 250.0).ceil(), "SELECT t, key, ceil(value - 250) AS value FROM p"),
    "floor": (lambda p, c: (p - 250.0).floor(), "SELECT t, key, floor(value - 250) AS value FROM p"),
    "round": (lambda p, c: (p - 250.0).round(), "SELECT t, key, round(value - 250) AS value FROM p"),
    "clamp_min": (lambda p, c: p.clamp_min(100.0), "SELECT t, key, greatest(value, 100) AS value FROM p"),
    "clamp_max": (lambda p, c: p.clamp_max(c.agg("avg")), "SELECT t, key, least(value, m) AS value FROM p JOIN (SELECT t, avg(value) AS m FROM c GROUP BY t) USING (t)"),
    "negate": (lambda p, c: -p, "SELECT t, key, -value AS value FROM p"),
    "arith_add": (lambda p, c: p + c, "SELECT t, key, p.value + c.value AS value FROM p JOIN c USING (t, key)"),
    "arith_sub": (lambda p, c: 1000.0 - p, "SELECT t, key, 1000 - value AS value FROM p"),
    "arith_mul": (lambda p, c: p * c.agg("min"), "SELECT t, key, value * m AS value FROM p JOIN (SELECT t, min(value) AS m FROM c GROUP BY t) USING (t)"),
    "arith_div": (lambda p, c: p / c, "SELECT t, key, p.value / c.value AS value FROM p JOIN c USING (t, key)"),
    "arith_mod": (lambda p, c: (p - 250.0) % 7.0, "SELECT t, key, (value - 250) % 7 AS value FROM p"),
    "div_by_zero": (
        lambda p, c: ((p - p) / (c - c)).or_(p.clamp_max(0.0) / 0.0).or_((p / 0.0) > 1e300).agg("count"),
        "SELECT t, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM p WHERE value > 0 GROUP BY t",
    ),
    "compare_gt": (lambda p, c: p > 90.0, "SELECT t, key, value FROM p WHERE value > 90"),
    "compare_lt": (lambda p, c: 90.0 > p, "SELECT t, key, value FROM p WHERE value < 90"),
    "compare_ge": (lambda p, c: p >= c, "SELECT t, key, p.value AS value FROM p JOIN c USING (t, key) WHERE p.value >= c.value"),
    "compare_le": (lambda p, c: c.agg("avg") <= p, "SELECT t, key, value FROM p JOIN (SELECT t, avg(value) AS m FROM c GROUP BY t) USING (t) WHERE m <= value"),
    "compare_eq": (lambda p, c: p.eq(p.agg("max")), "SELECT t, key, value FROM p JOIN (SELECT t, max(value) AS m FROM p GROUP BY t) USING (t) WHERE value = m"),
    "compare_ne": (lambda p, c: p.ne(p.agg("max")), "SELECT t, key, value FROM p JOIN (SELECT t, max(value) AS m FROM p GROUP BY t) USING (t) WHERE value <> m"),
    "vec_and": (lambda p, c: (p > 60.0).and_(c > 60.0), "SELECT t, key, value FROM p WHERE value > 60 AND (t, key) IN (SELECT (t, key) FROM c WHERE value > 60)"),
    "vec_unless": (lambda p, c: (p > 60.0).unless(c > 60.0), "SELECT t, key, value FROM p WHERE value > 60 AND (t, key) NOT IN (SELECT (t, key) FROM c WHERE value > 60)"),
    "vec_or": (lambda p, c: (p > 60.0).or_(c > 60.0), "SELECT t, key, value FROM p WHERE value > 60 UNION ALL SELECT t, key, value FROM c WHERE value > 60 AND (t, key) NOT IN (SELECT (t, key) FROM p WHERE value > 60)"),
    "agg_all": (lambda p, c: p.agg("sum"), "SELECT t, '' AS key, sum(value) AS value FROM p GROUP BY t"),
    "agg_by": (lambda p, c: p.agg("avg", by=["shard", "tenant", "zone"]), "SELECT t, regexp_extract(key, 'shard=.*', 0) AS key, avg(value) AS value FROM p GROUP BY 1, 2"),
    "agg_by_max": (lambda p, c: p.agg("max", by=["agent_id"]), "SELECT t, regexp_extract(key, 'agent_id=[^,]*', 0) AS key, max(value) AS value FROM p GROUP BY 1, 2"),
    "agg_without": (lambda p, c: p.agg("stddev", without_=["agent_id", "zone"]), "SELECT t, regexp_extract(key, 'shard=.*', 0) AS key, stddev_pop(value) AS value FROM p GROUP BY 1, 2"),
    "agg_without_count": (lambda p, c: p.agg("count", without_=["shard", "tenant"]), "SELECT t, regexp_extract(key, 'agent_id=[^,]*', 0) AS key, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2"),
    "vector_match_general": (
        # Grouped by a label that no sample has, the sum is one sample without labels; by tenant, at some times one group is left above the bound.
        lambda p, c: p.agg("max", by=["tenant"]) - c.agg("sum", by=["zone"]),
        "SELECT t, key, p.value - m AS value FROM (SELECT t, regexp_extract(key, 'tenant=.*', 0) AS key, max(value) AS value FROM p GROUP BY 1, 2) p JOIN (SELECT t, sum(value) AS m FROM c GROUP BY t) USING (t)",
    ),
}

QUERIES = {"instant_vector": instant_vector, "range_vector": range_vector, "literal": literal_, "scalar_guard": scalar_guard}
QUERIES |= {name: _ranged(name) for name in _RANGED} | {name: _of(build) for name, (build, _) in EXPRESSIONS.items()}

ORACLE_SQL = {
    "instant_vector": _shown("SELECT t, key, value FROM p WHERE regexp_full_match(key, 'agent_id=agent-[0-3],.*')"),
    "range_vector": f"""WITH {COUNTERS} SELECT t, key AS labels, count(*) AS n, min(us) AS first_us, round(sum(value), 6) AS total
FROM keyed JOIN ticks ON us BETWEEN t - {_TWO_DAYS} AND t WHERE name = 'purchase' GROUP BY t, key""",
    "scalar_guard": _shown("SELECT t, key, value FROM p WHERE value > 50 AND (t, key) IN (SELECT (t, key) FROM c WHERE value > 50)"),
    "literal": _shown("SELECT t, '' AS key, count(*) + 2.5 AS value FROM p GROUP BY t"),
    "rate": _INCREMENTS.replace("{0}", "inc / (span / 1e6)"),
    "increase": _INCREMENTS.replace("{0}", "inc"),
} | {
    name: f"""WITH {COUNTERS} SELECT t, key AS labels, round({expr}, 6) + 0.0 AS value
FROM keyed JOIN ticks ON us BETWEEN t - {_TWO_DAYS} AND t WHERE name = 'purchase' GROUP BY t, key HAVING count(*) >= {least}"""
    for name, (expr, least) in _REDUCED.items()
} | {name: _shown(sql) for name, (_, sql) in EXPRESSIONS.items()}
