"""Vector algebra on canned series, at 2026-07-09 12:00 UTC with points a minute apart that end there."""

import math
from datetime import UTC, datetime, timedelta

import pytest

from pulsegrid.functions.labels import Matcher
from pulsegrid.operators.vector import Engine, Grid, literal
from pulsegrid.sources import ingest

NOW = datetime(2026, 7, 9, 12, tzinfo=UTC)


@pytest.fixture
def at(spark):
    def make(series, grid=None, **options):
        """series: {(name, labels as pairs): values}, the last value at NOW."""
        data = [
            (name, "gauge", float(v), NOW - timedelta(minutes=len(values) - 1 - n), dict(labels))
            for (name, labels), values in series.items()
            for n, v in enumerate(values)
        ]
        df = spark.createDataFrame(data, "name string, type string, value double, ts timestamp, labels map<string,string>")
        return Engine(df, grid or Grid.at(NOW), **options)

    return make


def got(vector):
    return {r["key"]: r["value"] for r in vector.df.collect()}


def hosts(name, **values):
    return {(name, (("host", h),)): v if isinstance(v, list) else [v] for h, v in values.items()}


def test_filters_keep_values(at):
    cpu = at(hosts("cpu", a=95, b=50, c=99)).metric("cpu").instant()
    assert got(cpu > 90.0) == {"host=a": 95, "host=c": 99}
    assert got(90.0 < cpu) == {"host=a": 95, "host=c": 99}
    assert got(cpu.eq(50.0)) == {"host=b": 50}


def test_scalars_compare(at):
    e = at(hosts("cpu", a=1))
    one = literal(e, 2)
    assert got(one > 1.0) == {"": 2}
    assert got(literal(e, 1) > one) == {}
    assert got(literal(e, 3) > one) == {"": 3}  # the left value is kept


def test_vectors_compare_and_divide(at):
    e = at(hosts("used", a=90, b=10) | hosts("limit", a=80, b=80))
    used, limit = e.metric("used").instant(), e.metric("limit").instant()
    assert got(used > limit) == {"host=a": 90}
    assert got(literal(e, 2048) / 1024.0) == {"": 2}
    assert got(literal(e, 0) / 0.0) == {}
    assert got((used / 0.0).clamp_max(1.0)) == {"host=a": 1, "host=b": 1}
    assert got(-used / 0.0) == {"host=a": -math.inf, "host=b": -math.inf}
    assert got(used % 0.0) == {}


def test_sets(at):
    e = at(hosts("cpu", a=95, b=95) | hosts("mem", a=99))
    cpu, mem = e.metric("cpu").instant() > 90.0, e.metric("mem").instant() > 90.0
    assert got(cpu.and_(mem)) == {"host=a": 95}
    assert got(cpu.unless(mem)) == {"host=b": 95}
    assert got(cpu.or_(mem)) == {"host=a": 95, "host=b": 95}
    with pytest.raises(ValueError):
        cpu.and_(literal(e, 1))
    with pytest.raises(Exception, match="scalar"):
        cpu.and_(mem.agg("sum", by=["none"])).df.collect()


def test_aggregates(at):
    disk = {("disk", (("host", h), ("mount", m))): [v] for h, m, v in (("a", "/", 10), ("a", "/data", 30), ("b", "/", 5))}
    d = at(disk).metric("disk").instant()
    assert got(d.agg("max", by=["host"])) == {"host=a": 30, "host=b": 5}
    assert got(d.agg("sum", without_=["mount"])) == {"host=a": 40, "host=b": 5}
    assert got(d.agg("sum")) == {"": 45}
    assert got(d.agg("count", by=["host"])) == {"host=a": 2, "host=b": 1}
    assert got(d.agg("stddev", by=["none"])) == {"": pytest.approx(10.8012345)}


def test_dynamic_scalars(at):
    e = at(hosts("cpu", a=10, b=20))
    cpu, total = e.metric("cpu").instant(), e.metric("cpu").instant().agg("sum", by=["none"])
    assert got(cpu / total * 30.0) == {"host=a": 10, "host=b": 20}
    assert got(total - cpu) == {"host=a": 20, "host=b": 10}
    assert got(literal(e, 5) < total) == {"": 5}
    assert got(100.0 - total) == {"": 70}
    assert got(total.clamp_min(total)) == {"": 30}


def test_rate_minds_resets(at):
    e = at(hosts("c", a=[0, 10, 20, 5]))
    assert got(e.metric("c").range("5m").rate()) == {"host=a": pytest.approx(25 / 180)}
    assert got(at(hosts("c", a=[5])).metric("c").range("5m").rate()) == {}


@pytest.mark.parametrize("stretches", [1, 3, 7, 100_000])
def test_increments_across_stretches(spark, monkeypatch, stretches):
    """However a series is parted in time, the increments are those of its points in order."""
    import random

    from pulsegrid.operators import vector

    monkeypatch.setattr(vector, "STRETCHES", stretches)
    rng = random.Random(11)
    data = {(h, NOW + timedelta(seconds=rng.randrange(0, 3600))): float(rng.randrange(0, 50)) for h in ("a", "b") for _ in range(60)}
    df = spark.createDataFrame([("c", "counter", v, ts, {"h": h}) for (h, ts), v in data.items()], "name string, type string, value double, ts timestamp, labels map<string,string>")
    grid = Grid.over(NOW, NOW + timedelta(hours=1), "7m")
    found = {(r["i"], r["key"]): (r["inc"], r["n"]) for r in Engine(df, grid).metric("c").range("10m")._increments().collect()}
    wanted = {}
    for i in range(grid.last + 1):
        t = NOW + timedelta(minutes=7 * i)
        for h in ("a", "b"):
            values = [v for (g, ts), v in sorted(data.items()) if g == h and t - timedelta(minutes=10) <= ts <= t]
            if len(values) >= 2:
                wanted[i, f"h={h}"] = (sum(b if b < a else b - a for a, b in zip(values, values[1:], strict=False)), len(values))
    assert found == wanted and len(wanted) > 10


def test_range_functions(at):
    r = at(hosts("c", a=[10, 20, 60])).metric("c").range("5m")
    wanted = {"avg": 30, "min": 10, "max": 60, "sum": 90, "count": 3, "last": 60}
    for name, value in wanted.items():
        assert got(getattr(r, f"{name}_over_time")()) == {"host=a": value}
    assert got(r.delta()) == got(r.increase()) == {"host=a": 50}
    assert got(at(hosts("c", a=[7])).metric("c").range("5m").stddev_over_time()) == {"host=a": 0}


def test_rounding(at):
    v = at(hosts("c", a=-7.4)).metric("c").instant()
    assert [got(x)["host=a"] for x in (v.abs(), v.ceil(), v.floor(), v.round(), v.clamp_min(0.0), v.clamp_max(-9.0))] == [7.4, -7, -8, -7, 0, -9]
    assert got(at(hosts("c", a=-2.5)).metric("c").instant().round()) == {"host=a": -3}


def test_patterns_match_whole_values(at):
    e = at({("up", (("env", x),)): [1] for x in ("prod", "staging", "production", "prod\n")})
    assert set(got(e.metric("up", Matcher("env", "=~", "prod")).instant())) == {"env=prod"}
    assert len(got(e.metric("up", Matcher("env", "!=", "prod")).instant())) == 3
    assert len(got(e.metric("up", Matcher("zone", "=", "")).instant())) == 4
    for bad in ("(?=a)b", r"(a)\1", "a" * 513):
        with pytest.raises(ValueError):
            Matcher("env", "=~", bad)


def test_tenant_is_forced(at):
    e = at({("cpu", (("tenant", t),)): [1] for t in ("a", "b")}, tenant="a")
    assert set(got(e.metric("cpu").instant())) == {"tenant=a"}
    assert got(e.metric("cpu", Matcher("tenant", "=", "b")).instant()) == {"tenant=a": 1}
    assert got(e.metric("cpu", Matcher("tenant", "=~", "b|c")).instant()) == {}


def test_selectors_prune_tables(spark, tmp_path):
    """Dates are partition filters; times and the tenant reach Parquet; rates put only the range's points in order."""
    rows = [("c", "counter", float(d * 10 + m), NOW + timedelta(days=d, minutes=m), {"host": "a", "tenant": t}) for d in range(8) for m in (0, 2) for t in ("a", "b")]
    df = spark.createDataFrame(rows, "name string, type string, value double, ts timestamp, labels map<string,string>")
    ingest.write_samples(df, str(tmp_path / "t"))
    table = ingest.read_samples(spark, str(tmp_path / "t"))
    at = NOW + timedelta(days=5, minutes=2)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    for source in (df, table):
        s = Engine(source, Grid.at(at), tenant="a").metric("c")
        assert got(s.instant()) == got(s.range("5m").last_over_time()) == {"host=a,tenant=a": 52}
        assert got(s.range("5m").increase()) == {"host=a,tenant=a": 2}
    for vector in (s.instant().df, s.range("5m").points(), s.range("5m").rate().df):
        plan = vector._jdf.queryExecution().executedPlan().toString()
        partitions, pushed = (plan.split(f"{part}: [")[1].split("]")[0] for part in ("PartitionFilters", "PushedFilters"))
        assert "name" in partitions and "date" in partitions and "GreaterThanOrEqual(ts" in pushed and "EqualTo(tenant,a)" in pushed, plan


def test_lookback_and_order(spark, at):
    old = spark.createDataFrame([("c", "gauge", v, NOW - timedelta(minutes=m), {"host": "a"}) for m, v in ((2, 10.0), (1, 50.0), (3, 30.0))], "name string, type string, value double, ts timestamp, labels map<string,string>")
    assert got(Engine(old, Grid.at(NOW)).metric("c").instant()) == {"host=a": 50}
    assert got(Engine(old, Grid.at(NOW + timedelta(hours=1))).metric("c").instant()) == {}
    assert got(Engine(old, Grid.at(NOW + timedelta(minutes=4))).metric("c").instant()) == {"host=a": 50}  # both ends count


def test_grid_limits():
    with pytest.raises(ValueError):
        Grid.over(NOW, NOW + timedelta(minutes=500), "1m")
    assert Grid.over(NOW, NOW + timedelta(minutes=499), "1m").last == 499
    assert Grid.over(NOW, NOW + timedelta(minutes=500), "1m", most=None).last == 500


def test_random_expressions_against_an_interpreter(spark):
    """The plan for a whole grid agrees with evaluating each time in plain Python."""
    import random

    rng = random.Random(5)
    data = [(n, "gauge", rng.choice([0.0, 1.0, -2.5, 7.0, 40.0]), NOW + timedelta(seconds=rng.randrange(0, 3600)), {"h": str(h)}) for n in ("x", "y") for h in range(3) for _ in range(25)]
    data = list({(d[0], d[3], d[4]["h"]): d for d in data}.values())
    df = spark.createDataFrame(data, "name string, type string, value double, ts timestamp, labels map<string,string>")
    grid = Grid.over(NOW, NOW + timedelta(hours=1), "5m")
    e = Engine(df, grid)

    def instant(name, t):
        found = {}
        for n, _, v, ts, labels in sorted(data, key=lambda d: d[3]):
            if n == name and t - timedelta(minutes=5) <= ts <= t:
                found[f"h={labels['h']}"] = v
        return found

    x, y = e.metric("x").instant(), e.metric("y").instant()
    cases = {
        "sum": (x + y, lambda a, b: {k: a[k] + b[k] for k in a.keys() & b.keys()}),
        "ratio": ((x / y).abs() > 0.5, lambda a, b: {k: abs(a[k] / b[k]) if b[k] else math.inf for k in a.keys() & b.keys() if (b[k] and abs(a[k] / b[k]) > 0.5) or (not b[k] and a[k])}),
        "share": (x.agg("max", by=["none"]) - y, lambda a, b: {k: max(a.values()) - b[k] for k in b} if a and b else {}),
        "unless": (x.unless(y > 0.0), lambda a, b: {k: v for k, v in a.items() if not b.get(k, 0) > 0}),
    }
    for name, (vector, model) in cases.items():
        rows = {}
        for r in vector.df.collect():
            rows.setdefault(r["i"], {})[r["key"]] = r["value"]
        for i in range(grid.last + 1):
            t = NOW + timedelta(minutes=5 * i)
            wanted = model(instant("x", t), instant("y", t))
            assert rows.get(i, {}).keys() == wanted.keys(), (name, i)
            assert all(rows[i][k] == pytest.approx(v) for k, v in wanted.items()), (name, i)
