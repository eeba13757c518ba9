"""Vector algebra over a grid of evaluation times.

A vector is a frame (i, key, value): the number of the evaluation time, a label set as
text, and a value. One plan evaluates a single instant or every step of a backtest.

Selectors don't join times with points. Points of a series that lie in the same windows
are combined first; each such pane is then exploded to the times whose windows cover it,
and aggregated by (i, key). Where that is more than LONG times, range / step + 1, a pane goes to blocks of
times that it covers whole and to single times at both ends, about three times the root as
many rows, and blocks are taken apart after they are combined. So what functions
combine are summaries that merge: sums, ends, increments between neighbours, and for
deviations number, mean and sum of squares around it.

Of points of one series at one time, the last by the engine's `order` column is the
newest, or without such a column the one with the greatest value; where points are put
in order, that order goes after time.

A vector of exactly one sample without labels at some time is a scalar there. Where
that is known beforehand (numbers, aggregates without a clause) the plan is simple;
where it depends on the data (`maybe_scalar`), scalars are told apart by time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import floats
from pulsegrid.functions.labels import Matcher, label_key, label_matcher, labels_of, only, without
from pulsegrid.functions.times import epoch_micros, micros
from pulsegrid.sources.ingest import scan_series

LOOKBACK = "5m"
MOST_STEPS = 500
#: Into how many stretches of time the points of a series are parted where they must be put in order.
STRETCHES = 1024
#: Times in a range from which on panes are exploded in two levels.
LONG = 32


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ... in microseconds; `last` is the number of the final one."""

    start: int
    step: int
    last: int

    @staticmethod
    def over(since: datetime, until: datetime, step: str = "1m", most: int | None = MOST_STEPS) -> Grid:
        start, width = epoch_micros(since), micros(step)
        if width <= 0 or epoch_micros(until) < start:
            raise ValueError("a grid needs a positive step and an end after its start")
        last = (epoch_micros(until) - start) // width
        if most is not None and last + 1 > most:
            raise ValueError(f"{last + 1} steps; at most {most} are evaluated at once")
        return Grid(start, width, last)

    @staticmethod
    def at(time: datetime) -> Grid:
        return Grid(epoch_micros(time), 1, 0)

    @staticmethod
    def last_hour(now: datetime) -> Grid:
        """The default of a preview: one hour in steps of a minute."""
        return Grid.over(now.astimezone(UTC) - timedelta(hours=1), now)

    def time(self, i: Column) -> Column:
        return F.timestamp_micros(F.lit(self.start) + i * self.step)


class Engine:
    """Evaluates expressions over samples (name, type, value, ts, labels) of one tenant.

    `samples` can be a function of two times in microseconds too, which gives at least
    the samples between them: each selector asks for what it looks back to. `labelled`
    says that every sample has a label, as all do that came through ingest; then no
    selector can be a scalar. `order` names a column of the order in which samples came.
    """

    def __init__(self, samples: DataFrame | Callable[[int, int], DataFrame], grid: Grid, tenant: str = "", lookback: str = LOOKBACK, labelled: bool = True, order: str | None = None):
        self.samples, self.grid, self.tenant, self.lookback, self.labelled, self.order = samples, grid, tenant, micros(lookback), labelled, order

    def metric(self, name: str, *matchers: Matcher) -> Selector:
        return Selector(self, name, matchers)


class Selector:
    """Series of one name that all matchers hold for."""

    def __init__(self, engine: Engine, name: str, matchers: tuple[Matcher, ...]):
        self.engine, self.name, self.matchers = engine, name, matchers

    def _points(self, width: int) -> DataFrame:
        """(key, us, value, at) of the points in any window of the grid, which reach `width` back; `at` orders them.

        A caller's tenant stands in for whatever tenant the matchers ask for. Name, dates,
        times and tenant are filters on columns, so a table of samples is pruned by them.
        """
        e, g = self.engine, self.engine.grid
        forced = {"tenant": e.tenant} if e.tenant else {}
        since, until = g.start - width, g.start + g.last * g.step
        samples = e.samples(since, until) if callable(e.samples) else e.samples
        rows = scan_series(samples, self.name, forced, F.timestamp_micros(F.lit(since)), F.timestamp_micros(F.lit(until)))
        for m in self.matchers:
            if not (forced and m.name == "tenant" and m.op == "="):
                rows = rows.filter(label_matcher(F.col("labels"), m))
        rows = rows.withColumn("us", F.unix_micros("ts"))
        at = F.struct("us", *([F.col(e.order).alias("order")] if e.order else []), "value").alias("at")
        return rows.select(label_key(F.col("labels")).alias("key"), "us", "value", at)

    def _times(self, first: Column, last: Column, width: int) -> tuple[Column, Column]:
        """The first and last time, whose window [time - width, time] holds what begins and ends at two times in microseconds."""
        g = self.engine.grid
        return F.greatest(F.ceil((last - g.start) / g.step), F.lit(0)).cast("long"), F.least(F.floor((first + width - g.start) / g.step), F.lit(g.last)).cast("long")

    def _coverage(self, points: DataFrame, width: int) -> DataFrame:
        """Points with the first and last time, `low` and `high`, whose window they lie in."""
        low, high = self._times(F.col("us"), F.col("us"), width)
        return points.withColumns({"low": low, "high": high}).filter("low <= high")

    def _covered(self, points: DataFrame, width: int) -> DataFrame:
        """Points once for each time whose window they lie in."""
        return self._coverage(points, width).withColumn("i", F.explode(F.sequence("low", "high"))).drop("low", "high")

    def _merged(self, width: int, parts: list[Column], merge: list[Column], value: Column, least: int = 1) -> DataFrame:
        """(i, key, value): `parts` are aggregates of points, `merge` aggregates parts to parts, and `value` is taken from them."""
        panes = self._coverage(self._points(width), width).groupBy("key", "low", "high").agg(*parts, F.count("*").alias("n"))
        rows = self._combined(panes, width, merge)
        return rows.filter(F.col("n") >= least).select("i", "key", value.alias("value"))

    def _combined(self, panes: DataFrame, width: int, merge: list[Column]) -> DataFrame:
        """(i, key, n, the merged parts) of panes (key, low, high, n, parts)."""
        g, merge = self.engine.grid, [*merge, F.sum("n").alias("n")]
        long = min(width // g.step, g.last) + 1
        if long < LONG:
            return panes.withColumn("i", F.explode(F.sequence("low", "high"))).groupBy("i", "key").agg(*merge)
        size = math.isqrt(long)
        blocks = _spread(panes, size).groupBy("key", "size", "place").agg(*merge)
        begin = F.col("place") * F.col("size")
        return blocks.withColumn("i", F.explode(F.sequence(begin, begin + F.col("size") - 1))).groupBy("i", "key").agg(*merge)

    def instant(self) -> Vector:
        """The newest point of each series within the lookback."""
        return Vector(self._merged(self.engine.lookback, *_newest()), self.engine.grid, maybe_scalar=not self.engine.labelled)

    def range(self, width: str) -> RangeVector:
        return RangeVector(self, micros(width))


def _spread(panes: DataFrame, block: int) -> DataFrame:
    """Panes once for each block of times that they cover whole (size `block`), and for each time beside those (size 1)."""
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    low, high = F.col("low"), F.col("high")
    # The blocks from the first that begins at `low` or after it, to the last that ends at `high` or before.
    first, last = F.ceil(low / block).cast("long"), (F.floor((high + 1) / block) - 1).cast("long")
    singles = F.when(first <= last, F.concat(run(low, first * block - 1), run((last + 1) * block, high))).otherwise(run(low, high))
    of = lambda size, places: F.transform(places, lambda x: F.struct(F.lit(size).cast("long").alias("size"), x.alias("place")))
    return panes.withColumn("_at", F.explode(F.concat(of(block, run(first, last)), of(1, singles)))).withColumns({"size": F.col("_at.size"), "place": F.col("_at.place")}).drop("_at", "low", "high")


def _newest() -> tuple[list[Column], list[Column], Column]:
    """The newest of points: as parts, merged, and as a value."""
    return [F.max("at").alias("last")], [F.max("last").alias("last")], F.col("last.value")


def _chan(parts: Column) -> Column:
    """Numbers, means and sums of squares around them, of several sets of points as of one."""

    def step(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        mean, m2 = a["mean"] + apart * b["n"] / n, a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n
        return F.when(a["n"] == 0, b).otherwise(F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2")))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(parts, none, step)


class RangeVector:
    """Points of each series in [time - width, time], to be reduced."""

    def __init__(self, selector: Selector, width: int):
        if width <= 0:
            raise ValueError("a range is longer than nothing")
        self.selector, self.width = selector, width

    def points(self) -> DataFrame:
        """(i, key, us, value)."""
        return self.selector._covered(self.selector._points(self.width), self.width).select("i", "key", "us", "value")

    def _vector(self, rows: DataFrame) -> Vector:
        e = self.selector.engine
        return Vector(rows.select("i", "key", "value"), e.grid, maybe_scalar=not e.labelled)

    def _increments(self) -> DataFrame:
        """Per time and series: sum of increments of neighbours inside the window, number of points, span in microseconds.

        A drop counts as the new value, since the counter started again from zero. A point is in the
        windows that hold it, the increment of a pair in those that hold both; what is in the same
        windows is added up before it is exploded.
        """
        pick = self.selector
        of = lambda a, b, **c: F.struct(*(x.alias(n) for n, x in zip(("low", "high"), pick._times(a, b, self.width), strict=True)), *(v.alias(k) for k, v in c.items()))
        long = lambda x=None: F.lit(x).cast("long")
        point = of(F.col("us"), F.col("us"), n=long(1), first=F.col("us"), last=F.col("us"), inc=F.lit(None).cast("double"))
        pair = of(F.col("us0"), F.col("us"), n=long(0), first=long(), last=long(), inc=F.col("inc"))
        items = F.array_compact(F.array(F.when(F.col("one") == 1, point), F.when(F.col("us0").isNotNull(), pair)))
        items = self._pairs().select("key", F.explode(items).alias("s")).select("key", "s.*").filter("low <= high")
        merge = [F.min("first").alias("first"), F.max("last").alias("last"), F.sum("inc").alias("inc")]
        panes = items.groupBy("key", "low", "high").agg(*merge, F.sum("n").alias("n"))
        out = pick._combined(panes, self.width, merge)
        return out.select("i", "key", "inc", "n", (F.col("last") - F.col("first")).alias("span")).filter("n >= 2")

    def _pairs(self) -> DataFrame:
        """(key, us, us0, inc, one): every point, with the time of the one before it and the increment since.

        Points are put in order within stretches of time, so a series that holds most of
        all points is sorted by many tasks. A pair across stretches is a row of its own that
        is no point (`one` is 0), from the ends of each stretch, of which a series has no more
        than STRETCHES.
        """
        grid = self.selector.engine.grid
        length = -(-(grid.last * grid.step + self.width) // STRETCHES)
        points = self.selector._points(self.width).withColumn("stretch", F.floor((F.col("us") - (grid.start - self.width)) / length))
        before = Window.partitionBy("key", "stretch").orderBy("at")
        within = points.withColumns({"us0": F.lag("us").over(before), "v0": F.lag("value").over(before), "one": F.lit(1)})
        ends = points.groupBy("key", "stretch").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        earlier = F.lag("last").over(Window.partitionBy("key").orderBy("stretch"))
        across = ends.withColumn("before", earlier).filter("before IS NOT NULL")
        across = across.select("key", F.col("first.us").alias("us"), F.col("first.value").alias("value"), F.col("before.us").alias("us0"), F.col("before.value").alias("v0"), F.lit(0).alias("one"))
        increment = F.when(F.col("value") < F.col("v0"), F.col("value")).otherwise(F.col("value") - F.col("v0"))
        return within.select(across.columns).unionByName(across).select("key", "us", "us0", increment.alias("inc"), "one")

    def rate(self) -> Vector:
        """Increase a second between the first and last point of the window."""
        rows = self._increments().filter("span > 0")
        return self._vector(rows.withColumn("value", F.col("inc") / (F.col("span") / 1e6)))

    def increase(self) -> Vector:
        return self._vector(self._increments().withColumn("value", F.col("inc")))

    def _of_parts(self, parts: list[Column], merge: list[Column], value: Column, least: int = 1) -> Vector:
        return self._vector(self.selector._merged(self.width, parts, merge, value, least))

    def delta(self) -> Vector:
        """Last minus first, of two points at least."""
        parts, merge, last = _newest()
        return self._of_parts([*parts, F.min("at").alias("first")], [*merge, F.min("first").alias("first")], last - F.col("first.value"), least=2)

    def _same(self, function: Callable[[str], Column]) -> Vector:
        """By a function that aggregates points and what it has made of them alike."""
        return self._of_parts([function("value").alias("s")], [function("s").alias("s")], F.col("s"))

    def sum_over_time(self) -> Vector:
        return self._same(F.sum)

    def avg_over_time(self) -> Vector:
        return self._of_parts([F.sum("value").alias("s")], [F.sum("s").alias("s")], F.col("s") / F.col("n"))

    def min_over_time(self) -> Vector:
        return self._same(F.min)

    def max_over_time(self) -> Vector:
        return self._same(F.max)

    def count_over_time(self) -> Vector:
        return self._of_parts([], [], F.col("n").cast("double"))

    def last_over_time(self) -> Vector:
        return self._of_parts(*_newest())

    def stddev_over_time(self) -> Vector:
        """Population deviation, from summaries that are merged by Chan's formula: sums of squares would lose digits."""
        part = F.struct(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2")).alias("d")
        return self._of_parts([part], [_chan(F.collect_list("d")).alias("d")], F.sqrt(F.col("d.m2") / F.col("d.n")))


REDUCERS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda v: F.count(v).cast("double"), "stddev": F.stddev_pop}


class Vector:
    """Samples at each time of a grid. `scalar`: one without labels at most, known beforehand."""

    def __init__(self, df: DataFrame, grid: Grid, scalar: bool = False, maybe_scalar: bool = True):
        self.df, self.grid, self.scalar, self.maybe_scalar = df, grid, scalar, scalar or maybe_scalar

    def _with(self, df: DataFrame) -> Vector:
        return Vector(df, self.grid, self.scalar, self.maybe_scalar)

    def result(self) -> DataFrame:
        """(t, labels, key, value)."""
        return self.df.select(self.grid.time(F.col("i")).alias("t"), labels_of(F.col("key")).alias("labels"), "key", "value")

    # One sample to one sample

    def _each(self, value: Column) -> Vector:
        return self._with(self.df.withColumn("value", value))

    def abs(self) -> Vector:
        return self._each(F.abs("value"))

    def _whole(self, rounded: Column) -> Vector:
        """Rounding through integers, for values that fit one; larger ones are whole already."""
        v = F.col("value")
        return self._each(F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), v).otherwise(rounded.cast("double")))

    def ceil(self) -> Vector:
        return self._whole(F.ceil("value"))

    def floor(self) -> Vector:
        return self._whole(F.floor("value"))

    def round(self) -> Vector:
        return self._whole(F.round("value"))

    def __neg__(self) -> Vector:
        return self._each(-F.col("value"))

    negate = __neg__

    def clamp_min(self, bound: float | Vector) -> Vector:
        return self._clamp(floats.clamp_min, bound)

    def clamp_max(self, bound: float | Vector) -> Vector:
        return self._clamp(floats.clamp_max, bound)

    def _clamp(self, how, bound: float | Vector) -> Vector:
        if not isinstance(bound, Vector):
            return self._each(how(F.col("value"), F.lit(float(bound))))
        if not bound.maybe_scalar:
            raise ValueError("the bound of a clamp is a scalar")
        limits = bound.df if bound.scalar else bound._scalars(must=True)
        rows = self.df.join(limits.select("i", F.col("value").alias("_bound")), "i")
        return self._with(rows.withColumn("value", how(F.col("value"), F.col("_bound"))).select("i", "key", "value"))

    # Two operands

    def _scalars(self, must: bool = False) -> DataFrame:
        """(i, value) of the times at which this is one sample without labels; with `must`, others raise an error."""
        counts = self.df.groupBy("i").agg(F.count("*").alias("n"), F.max("key").alias("key"), F.max("value").alias("value"))
        alone = (F.col("n") == 1) & (F.col("key") == "")
        if must:
            counts = counts.withColumn("value", F.when(alone, F.col("value")).otherwise(F.raise_error(F.lit("the bound of a clamp is a scalar")).cast("double")))
            return counts.select("i", "value")
        return counts.filter(alone).select("i", "value")

    def _binary(self, other: float | Vector, value, reverse: bool = False) -> Vector:
        """value(a, b) of matching samples, null ones dropped; `value` takes (left, right) columns and which side to keep."""
        if not isinstance(other, Vector):
            number = F.lit(float(other))
            if reverse and self.maybe_scalar:  # at times at which both are scalars the number's side counts as left
                numbers = self.df.select("i").distinct().select("i", F.lit("").alias("key"), number.alias("value"))
                return Vector(numbers, self.grid, scalar=True)._binary(self, value)
            a, b = (number, F.col("value")) if reverse else (F.col("value"), number)
            return self._with(self.df.withColumn("value", value(a, b, F.col("value"))).filter("value IS NOT NULL"))
        left, right = self, other
        out = Vector(None, self.grid, left.scalar and right.scalar, left.maybe_scalar and right.maybe_scalar)
        a, b = F.col("a"), F.col("b")
        if left.scalar or right.scalar or not (left.maybe_scalar or right.maybe_scalar):
            if left.scalar or right.scalar:
                # A side that is one value for each time; the other's samples keep their labels.
                many, one = (left, right) if right.scalar else (right, left)
                dynamic = one is left and many.maybe_scalar and not many.scalar
                rows = many.df.join(one.df.select("i", F.col("value").alias("one")), "i")
                keep = F.col("value")
                if dynamic:  # both are scalars at some times: the left value is kept there
                    alone = many._scalars().select("i", F.lit(True).alias("alone"))
                    rows = rows.join(alone, "i", "left")
                    keep = F.when(F.col("alone"), F.col("one")).otherwise(F.col("value"))
                x, y = (F.col("value"), F.col("one")) if many is left else (F.col("one"), F.col("value"))
                rows = rows.withColumn("out", value(x, y, keep))
            else:
                rows = left.df.withColumnRenamed("value", "a").join(right.df.withColumnRenamed("value", "b"), ["i", "key"]).withColumn("out", value(a, b, a))
            out.df = rows.filter("out IS NOT NULL").select("i", "key", F.col("out").alias("value"))
            return out
        ls, rs = (v._scalars().withColumnRenamed("value", name) for v, name in ((left, "ls"), (right, "rs")))
        lrows = left.df.join(ls, "i", "left").join(rs, "i", "left")
        rrows = right.df.join(ls, "i", "left").join(rs, "i", "left")
        neither = "ls IS NULL AND rs IS NULL"
        by_right = lrows.filter("rs IS NOT NULL").withColumn("out", value(F.col("value"), F.col("rs"), F.col("value")))
        by_left = rrows.filter("rs IS NULL AND ls IS NOT NULL").withColumn("out", value(F.col("ls"), F.col("value"), F.col("value")))
        pairs = lrows.filter(neither).select("i", "key", F.col("value").alias("a")).join(rrows.filter(neither).select("i", "key", F.col("value").alias("b")), ["i", "key"]).withColumn("out", value(a, b, a))
        parts = [x.select("i", "key", F.col("out").alias("value")) for x in (by_right, by_left, pairs)]
        out.df = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("value IS NOT NULL")
        return out

    def _arith(self, op: str, other, reverse: bool = False) -> Vector:
        return self._binary(other, lambda a, b, _: floats.arithmetic(op, a, b), reverse)

    def _compare(self, op: str, other) -> Vector:
        """A filter: the samples for which it holds, with their own values.

        Of two scalars the left one's value is kept. Python turns `3 > v` into `v < 3`; where
        v can be a scalar and its left number should be kept, write `literal(engine, 3) > v`.
        """
        return self._binary(other, lambda a, b, keep: F.when(floats.compare(op, a, b), keep))

    def __add__(self, x):
        return self._arith("+", x)

    def __radd__(self, x):
        return self._arith("+", x, True)

    def __sub__(self, x):
        return self._arith("-", x)

    def __rsub__(self, x):
        return self._arith("-", x, True)

    def __mul__(self, x):
        return self._arith("*", x)

    def __rmul__(self, x):
        return self._arith("*", x, True)

    def __truediv__(self, x):
        return self._arith("/", x)

    def __rtruediv__(self, x):
        return self._arith("/", x, True)

    def __mod__(self, x):
        return self._arith("%", x)

    def __rmod__(self, x):
        return self._arith("%", x, True)

    def __gt__(self, x):
        return self._compare(">", x)

    def __lt__(self, x):
        return self._compare("<", x)

    def __ge__(self, x):
        return self._compare(">=", x)

    def __le__(self, x):
        return self._compare("<=", x)

    def eq(self, x):
        return self._compare("==", x)

    def ne(self, x):
        return self._compare("!=", x)

    # Sets of label sets

    def _guarded(self) -> DataFrame:
        """The samples; at a time at which this is a scalar, an error."""
        if self.scalar:
            raise ValueError("and, or and unless join series, and a scalar has none")
        if not self.maybe_scalar:
            return self.df
        alone = self._scalars().select("i", F.lit(True).alias("alone"))
        failed = F.raise_error(F.lit("and, or and unless join series, and a scalar has none")).cast("double")
        return self.df.join(alone, "i", "left").select("i", "key", F.when(F.col("alone"), failed).otherwise(F.col("value")).alias("value"))

    def and_(self, other: Vector) -> Vector:
        return self._with(self._guarded().join(other._guarded().filter("value IS NOT NULL").select("i", "key"), ["i", "key"], "left_semi"))

    def unless(self, other: Vector) -> Vector:
        return self._with(self._guarded().join(other._guarded().filter("value IS NOT NULL").select("i", "key"), ["i", "key"], "left_anti"))

    def or_(self, other: Vector) -> Vector:
        left, right = self._guarded(), other._guarded()
        rows = left.unionByName(right.join(left.select("i", "key"), ["i", "key"], "left_anti"))
        return Vector(rows, self.grid, False, self.maybe_scalar or other.maybe_scalar)

    # Aggregation

    def _aggregate(self, op: str, key: Column, scalar: bool) -> Vector:
        rows = self.df.groupBy("i", key.alias("key")).agg(REDUCERS[op]("value").alias("value"))
        return Vector(rows, self.grid, scalar, True)

    def agg(self, op: str, by: list[str] | None = None, without_: list[str] | None = None) -> Vector:
        """Reduce samples of each time, grouped by labels, by all labels but some, or all together."""
        labels = labels_of(F.col("key"))
        if without_ is not None:
            return self._aggregate(op, label_key(without(labels, without_)), False)
        if by:
            return self._aggregate(op, label_key(only(labels, by)), False)
        return self._aggregate(op, F.lit(""), True)


def literal(engine: Engine, value: float) -> Vector:
    """A number as a scalar at each time."""
    spark = SparkSession.active() if callable(engine.samples) else engine.samples.sparkSession
    rows = spark.range(engine.grid.last + 1).select(F.col("id").alias("i"), F.lit("").alias("key"), F.lit(float(value)).alias("value"))
    return Vector(rows, engine.grid, scalar=True)
