"""Labels, rules, alert lifecycles, silences, inhibition, grouping and run comparison on small cases."""

import hashlib
import itertools
import random
import re
import struct
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import labels as L
from pulsegrid.functions.labels import Matcher
from pulsegrid.functions.times import micros, resolve_relative_time
from pulsegrid.operators import alerts as A
from pulsegrid.operators import compare as C
from pulsegrid.operators import rules as R
from pulsegrid.operators.ratelimit import Bucket
from pulsegrid.operators.vector import Grid, Vector

T0 = datetime(2026, 7, 9, 12, tzinfo=UTC)
LABELS = "name string, labels map<string,string>"
AWKWARD = [
    ("cpu", {"a": "b,c=d"}), ("cpu", {"a": "b", "c": "d"}), ("cpu", {"a": "b=c"}), ("cpu", {"a=b": "c"}), ("cpu{a=b}", {}), ("cpu", {"a": "b"}),
    ("cpu", {"a": "b}"}), ("cpu", {"a": "b\\"}), ("cpu", {"a": "b,\\"}), ("cpu", {"b": "2", "a": "1"}), ("cpu", {}), ("", {"": ""}), ("a\nb", {"k": "x\ny,"}),
]


def test_series_keys_are_injective_and_invert(spark):
    df = spark.createDataFrame(AWKWARD, LABELS).withColumn("key", L.series_key(F.col("name"), F.col("labels")))
    out = df.withColumn("p", L.parse_series_key(F.col("key"))).collect()
    assert len({r["key"] for r in out}) == len(AWKWARD)
    assert all((r["p"]["name"], r["p"]["labels"]) == (r["name"], r["labels"]) for r in out)
    assert {"cpu{a=1,b=2}", "cpu"} <= {r["key"] for r in out}
    bad = spark.createDataFrame([("cpu{a}",), ("cpu{a=b",), ("c=d",)], "key string")
    assert [r["p"] for r in bad.select(L.parse_series_key(F.col("key")).alias("p")).collect()] == [None] * 3
    back = df.select("labels", L.labels_of(L.label_key(F.col("labels"))).alias("b")).collect()
    assert all(r["labels"] == r["b"] for r in back)


def test_fingerprints(spark):
    def model(rule, labels):
        fields = [rule, *itertools.chain.from_iterable(sorted(labels.items()))]
        return hashlib.sha256(b"".join(struct.pack(">Q", len(f.encode())) + f.encode() for f in fields)).hexdigest()[:16]

    df = spark.createDataFrame(AWKWARD, LABELS).withColumn("f", L.fingerprint(F.lit("r1"), F.col("labels")))
    assert all(r["f"] == model("r1", r["labels"]) for r in df.collect())


def test_merge_and_match(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), ({}, {"c": "4"}), (None, {"a": "5"})], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in df.select(L.merge_labels(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}, {"a": "5"}]
    none = F.array().cast(L.MATCHER_TYPE)
    assert [r[0] for r in df.select(L.match_all(none, F.col("y"))).collect()] == [False] * 3


def test_times():
    assert [micros(x) for x in ("5m", "1h30m", "250ms", "0", "-1h", 1_000)] == [300_000_000, 5_400_000_000, 250_000, 0, -3_600_000_000, 1]
    assert resolve_relative_time("-1h", T0) == T0 - timedelta(hours=1) and resolve_relative_time("now", T0) == T0 and resolve_relative_time("", T0) is None
    with pytest.raises(ValueError):
        micros("5 apples")


def life(spark, minutes, for_="0", resend="1m", last=40):
    """(minute, status, value) of one alert that holds at the given minutes."""
    grid = Grid(round(T0.timestamp() * 1e6), micros("1m"), last)
    rule = R.Rule("r", "R", for_=for_, interval="1m")
    vector = Vector(spark.createDataFrame([(m, "host=a", 90.0 + m) for m in minutes], "i long, key string, value double"), grid)
    results = R.evaluate(rule, vector)
    states = R.alert_states(results, rule, grid)
    events = R.alert_events(results, states, rule, grid, resend)
    return sorted((r["i"], r["status"], r["value"]) for r in events.collect()), states, grid


def test_fires_after_a_continuous_for(spark):
    assert life(spark, range(0, 6), "5m", last=5)[0] == [(5, "firing", 95.0)]
    assert life(spark, [0, 1, 2, 4, 5, 6, 7, 8], "5m")[0] == []
    assert life(spark, [0], last=0)[0] == [(0, "firing", 90.0)]


def test_resolves_returns_and_is_sent_again(spark):
    assert life(spark, [0, 2])[0] == [(0, "firing", 90.0), (1, "resolved", 90.0), (2, "firing", 92.0), (3, "resolved", 92.0)]
    events, states, grid = life(spark, range(0, 12), resend="10m")
    assert events == [(0, "firing", 90.0), (10, "firing", 100.0), (12, "resolved", 101.0)]
    assert [r["state"] for r in R.state_at(states, 13, grid).collect()] == ["resolved"]
    assert R.state_at(states, 28, grid).count() == 0 and R.active_alerts(states, 13, grid).count() == 0


def test_rule_labels_and_templates(spark):
    rule = R.Rule("r", "R", tenant="a", labels={"x": "1"}, annotations={"s": "{{ .Value }}% {{.Labels.host}}{{ .Labels.no }}", "b": "{{ if }}"})
    df = spark.createDataFrame([({"host": "h", "tenant": "forged", "alertname": "mine"}, v) for v in (95.0, 1e7, 0.5, float("inf"))], "l map<string,string>, v double")
    out = df.select(R.alert_labels(rule, F.col("l")).alias("l"), R.render_annotations(rule, F.col("v"), F.col("l")).alias("a")).collect()
    assert out[0]["l"] == {"host": "h", "tenant": "a", "alertname": "mine", "severity": "warning", "x": "1"}
    assert [r["a"]["s"] for r in out] == ["95% h", "1e+07% h", "0.5% h", "+Inf% h"] and out[0]["a"]["b"] == "{{ if }}"
    with pytest.raises(ValueError):
        R.Rule("r", "R", labels={"tenant": "x"})


def test_floats_in_templates(spark):
    wanted = {
        1e6: "1e+06", 999999.0: "999999", 8589934592.0: "8.589934592e+09", 5e-05: "5e-05", 0.0001: "0.0001", -0.00012: "-0.00012", -0.0: "-0", 95.0: "95", 95.5: "95.5", -1234567.25: "-1.23456725e+06",
        0.1 + 0.2: "0.30000000000000004", 2.0**-44: "5.684341886080802e-14", 1e23: "1e+23", 100000.0: "100000", 1.7976931348623157e308: "1.7976931348623157e+308", 5e-324: "5e-324", float("nan"): "NaN", float("-inf"): "-Inf",
    }
    df = spark.createDataFrame([(v,) for v in wanted], "v double")
    assert [r[0] for r in df.select(R.shortest(F.col("v"))).collect()] == list(wanted.values())


def test_templates(spark):
    df = spark.createDataFrame([(2.46, {"host": "a" + "é" * 3000})], "v double, l map<string,string>")
    show = lambda t: df.select(R.render(t, F.col("v"), F.col("l"))).head()[0]
    assert show("{{ .Labels.host }}") == "a" + "é" * 2047  # 4,095 bytes: the next character would be cut through
    assert show("x{{ .Labels.host }}") == "xa" + "é" * 2047
    assert show("€😀" * 600) == "€😀" * 585
    assert show('{{ printf "%.1f%%" .Value }} {{printf "%.0f" .Value}} {{ printf "%v" .Value }} {{ printf "<%s>" .Labels.none }}') == "2.5% 2 2.46 <>"
    for raw in ("{{ .Oops }}", "{{ if }}", "{{ .Value", "}}"):
        assert show(raw) == raw
    for bad in ('{{ if .Value }}x{{ end }}', '{{ printf "%d" .Value }}', '{{ printf "%x" .Labels.a }}', "{{ len .Labels }}", "{{ .Value | printf \"%f\" }}", '{{ printf "x" .Value }}', "{{- .Value }}"):
        with pytest.raises(ValueError):
            show(bad)


ALERTS = "fingerprint string, status string, labels map<string,string>, at timestamp"


def test_silence_window_is_half_open(spark):
    matcher = [("host", "=", "web-1")]
    s = spark.createDataFrame([("s", "", matcher, T0, T0 + timedelta(hours=1)), ("t", "other", matcher, T0, T0 + timedelta(hours=9))], f"id string, tenant string, matchers {L.MATCHER_TYPE}, starts_at timestamp, ends_at timestamp")
    times = [T0 - timedelta(seconds=1), T0, T0 + timedelta(minutes=59), T0 + timedelta(hours=1)]
    a = spark.createDataFrame([(str(n), "firing", {"host": "web-1", "tenant": "a"}, t) for n, t in enumerate(times)], ALERTS)
    assert [r["silenced"] for r in A.silence_mutes(a, s).orderBy("fingerprint").collect()] == [False, True, True, False]


def test_silences_of_any_length(spark):
    """Against all pairs: silences from a microsecond to a century, ended before their start, or without end."""
    rng = random.Random(5)
    micro = lambda n: timedelta(microseconds=n)
    silences = [(str(n), rng.choice(["", "a", None]), [("host", "=", f"h{n % 3}")], start := T0 + micro(rng.randrange(-(10**13), 10**13)), start + micro(int(10 ** rng.uniform(0, 15.5)))) for n in range(80)]
    silences += [("none", "", [("host", "=", "h0")], T0, None), ("back", "", [("host", "=", "h0")], T0, T0 - timedelta(days=1))]
    edges = [t + micro(d) for _, _, _, a, b in silences[:80] for t in (a, b) for d in (-1, 0)]
    alerts = [(str(n), "firing", {"host": f"h{rng.randrange(4)}", "tenant": rng.choice(["a", "b", ""])}, t) for n, t in enumerate(edges)]
    wanted = {f: any((t or "") in ("", labels["tenant"]) and m[0][2] == labels["host"] and b and a <= at < b for _, t, m, a, b in silences) for f, _, labels, at in alerts}
    s = spark.createDataFrame(silences, f"id string, tenant string, matchers {L.MATCHER_TYPE}, starts_at timestamp, ends_at timestamp")
    got = {r["fingerprint"]: r["silenced"] for r in A.silence_mutes(spark.createDataFrame(alerts, ALERTS), s).collect()}
    assert got == wanted and 0 < sum(wanted.values()) < len(wanted)


def test_silences_equal_every_pair_looked_at(spark):
    """Silences from a minute to centuries, some without a tenant, some empty; alerts at their bounds."""
    rng = random.Random(6)
    lengths = [60, 3600, 86_400, 40 * 86_400, 4 * 365 * 86_400, 300 * 365 * 86_400, 0, -5]
    starts = [rng.randrange(0, 10**8) for _ in range(30)]
    silences = [(f"s{n}", rng.choice(["", None, "a", "b"]), [{"name": "h", "op": rng.choice(["=", "!="]), "value": rng.choice("xyz")}], start, start + rng.choice(lengths)) for n, start in enumerate(starts)]
    times = sorted({t + d for _, _, _, *both in silences for t in both for d in (-1, 0) if 0 <= t + d < 10**9})
    alerts = [(f"f{n}", {"h": rng.choice("xyz"), "tenant": rng.choice(["", "a", "b"])}, t) for n in range(5) for t in times]
    s = spark.createDataFrame(silences, "id string, tenant string, matchers array<struct<name:string,op:string,value:string>>, starts_at long, ends_at long")
    s = s.withColumns({c: F.timestamp_seconds(c) for c in ("starts_at", "ends_at")})
    a = spark.createDataFrame(alerts, "fingerprint string, labels map<string,string>, at long").withColumn("at", F.timestamp_seconds("at"))
    holds = lambda m, of: (of["h"] == m["value"]) == (m["op"] == "=")
    wanted = {(f, t): any((tenant or "") in ("", of["tenant"]) and start <= t < end and holds(m[0], of) for _, tenant, m, start, end in silences) for f, of, t in alerts}
    got = {(r["fingerprint"], int(r["at"].timestamp())): r["silenced"] for r in A.silence_mutes(a, s).collect()}
    assert got == wanted and 0 < sum(got.values()) < len(got)
    assert A.silence_mutes(a, s.filter("false")).filter("silenced").count() == 0


def test_alerts_of_one_slot_are_spread(spark):
    """Years of alerts look into one slot of centuries, in parts that no key holds more than a share of, and only into slots that silences have."""
    alerts = spark.range(40_000).select(F.col("id").cast("string").alias("fingerprint"), F.create_map(F.lit("tenant"), F.lit("a")).alias("labels"), F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    rows = A._lookups(alerts, [len(A.SLOTS)], "at")
    assert rows.count() == 2 * 40_000  # its tenant's scope, and that of all
    assert rows.groupBy("_scope", "_slot", "_salt").count().agg(F.max("count")).head()[0] < 40_000 / A.SALTS * 1.2


def test_inhibition_equals_every_pair_looked_at(spark):
    """Random alerts and sources, among them ones that overlap themselves, are open, empty, or begin where others end."""
    rng = random.Random(11)
    rules = [A.InhibitRule((Matcher("role", "=", "s"),), (Matcher("sev", "=", "low"),), ("zone",)), A.InhibitRule((Matcher("sev", "=", "high"),), (Matcher("role", "=~", "s|t"),))]
    label = lambda: {"role": rng.choice("st"), "sev": rng.choice(["low", "high"]), "tenant": rng.choice(["", "a"])} | ({"zone": rng.choice("xy")} if rng.random() < 0.7 else {})
    labels = {f"f{n}": label() for n in range(14)}
    hour = 3600
    alerts = [(f, m, t * hour // 2) for f, m in labels.items() for t in range(12)]
    firing = [(f, labels[f], start * hour // 2, rng.choice([None, start * hour // 2 + rng.randrange(4) * hour // 2])) for f in labels for start in (rng.randrange(12) for _ in range(rng.randrange(3)))]
    stamp = lambda c: F.timestamp_seconds(c).alias(c)
    a = spark.createDataFrame(alerts, "fingerprint string, labels map<string,string>, at long").select("fingerprint", "labels", stamp("at"))
    f = spark.createDataFrame(firing, "fingerprint string, labels map<string,string>, fires_at long, resolves_at long").select("fingerprint", "labels", stamp("fires_at"), stamp("resolves_at"))
    holds = lambda m, of: bool(re.fullmatch(m.value, of.get(m.name, "")))

    def wanted(fp, of, t):
        for rule in rules:
            if all(holds(m, of) for m in rule.target):
                for other, its, start, end in firing:
                    same = its["tenant"] == of["tenant"] and all(its.get(k, "") == of.get(k, "") for k in rule.equal)
                    if other != fp and same and all(holds(m, its) for m in rule.source) and start <= t and (end is None or t < end):
                        return True
        return False

    got = {(r["fingerprint"], int(r["at"].timestamp())): r["inhibited"] for r in A.inhibit(a, f, rules).collect()}
    assert got == {(fp, t): wanted(fp, of, t) for fp, of, t in alerts}
    assert 0 < sum(got.values()) < len(got)


def test_inhibition_of_one_key_takes_rows_in_proportion(spark):
    """A hundred thousand alerts and as many sources that all agree: pairs would be ten thousand million."""
    n = 100_000
    base = spark.range(n).select(F.col("id").cast("string").alias("fingerprint"), F.create_map(F.lit("sev"), F.lit("low"), F.lit("role"), F.lit("s")).alias("labels"), F.timestamp_seconds(F.col("id") * 7).alias("at"))
    firing = base.select("fingerprint", "labels", F.col("at").alias("fires_at"), (F.col("at") + F.expr("INTERVAL 7 SECONDS")).alias("resolves_at"))
    rule = [A.InhibitRule((Matcher("role", "=", "s"),), (Matcher("sev", "=", "low"),))]
    began = time.time()
    assert A.inhibit(base, firing, rule).filter("inhibited").count() == 0  # at each time only the alert itself fires
    twice = firing.unionByName(firing.filter("fires_at >= timestamp_seconds(70000)").select("fingerprint", "labels", (F.col("fires_at") - F.expr("INTERVAL 7 SECONDS")).alias("fires_at"), "resolves_at"))
    assert A.inhibit(base, twice, rule).filter("inhibited").count() == n - 10_000
    assert time.time() - began < 120


def test_inhibition_guards(spark):
    down = {"alertname": "HostDown", "host": "web-1"}
    rule = [A.InhibitRule((L.Matcher("alertname", "=", "HostDown"),), (L.Matcher("alertname", "=~", "CPUHigh|HostDown"),), ("host",))]
    targets = [("t1", {"alertname": "CPUHigh", "host": "web-1"}), ("t2", {"alertname": "CPUHigh", "host": "web-2"}), ("t3", {"alertname": "CPUHigh", "host": "web-1", "tenant": "b"}), ("src", down)]
    a = spark.createDataFrame([(f, "firing", labels, T0) for f, labels in targets], ALERTS)
    firing = spark.createDataFrame([("src", down, T0 - timedelta(minutes=1), None)], "fingerprint string, labels map<string,string>, fires_at timestamp, resolves_at timestamp")
    out = lambda f: {r["fingerprint"] for r in A.inhibit(a, f, rule).filter("inhibited").collect()}
    assert out(firing) == {"t1"}
    assert out(firing.withColumn("resolves_at", F.lit(T0))) == set()
    bare = spark.createDataFrame([("x", "firing", {"alertname": "CPUHigh"}, T0)], ALERTS)
    absent = firing.withColumn("labels", F.create_map(F.lit("alertname"), F.lit("HostDown")))
    assert A.inhibit(bare, absent, rule).head()["inhibited"]  # absent on both sides counts as equal


def test_unannounced_resolution_goes_nowhere(spark):
    rows = [("a", "firing", {}, T0, True), ("a", "resolved", {}, T0 + timedelta(minutes=1), False), ("b", "firing", {}, T0, False), ("b", "firing", {}, T0 + timedelta(minutes=1), True), ("b", "resolved", {}, T0 + timedelta(minutes=2), False), ("b", "resolved", {}, T0 + timedelta(minutes=3), False)]
    df = spark.createDataFrame(rows, f"{ALERTS}, muted boolean")
    out = A.forwarded_resolutions(df).select("fingerprint", "status", F.minute("at").alias("m")).collect()
    assert sorted(map(tuple, out)) == [("b", "firing", 0), ("b", "resolved", 2)]


def sendings(events, until=24 * 60, **timers):
    g = A.GroupState(A.Grouping(**timers).timers())
    out = []

    def send(limit):
        while g.next_flush is not None and g.next_flush < limit:
            at = g.next_flush
            if (content := g.flush()) is not None:
                out.append((at / 60e6, content))

    for minute, f, status in events:
        send(round(minute * 60e6))
        g.take(round(minute * 60e6), f, status)
    send(until * 60_000_000 + 1)
    return out


def test_group_timers():
    assert sendings([(0, "a", "firing"), (0.2, "b", "firing")], until=5) == [(0.5, [("a", "firing"), ("b", "firing")])]
    changed = sendings([(0, "a", "firing"), (1, "b", "firing")], until=10)
    assert [at for at, _ in changed] == [0.5, 5.5]
    late = sendings([(0, "a", "firing"), (60, "b", "firing")], until=61)
    assert [at for at, _ in late] == [0.5, 60]
    assert [at for at, _ in sendings([(0, "a", "firing"), (3, "a", "firing")], until=500)] == [0.5, 240.5, 480.5]
    over = sendings([(0, "a", "firing"), (10, "a", "resolved"), (30, "a", "firing")], until=31)
    assert over == [(0.5, [("a", "firing")]), (10, [("a", "resolved")]), (30.5, [("a", "firing")])]
    assert A.Grouping(interval="5m", repeat="1m").timers()[2] == micros("5m")


def test_group_fold_equals_the_model(spark):
    events = [("g", f, s, T0 + timedelta(minutes=m)) for m, f, s in ((0, "a", "firing"), (1, "b", "firing"), (9, "a", "resolved"), (300, "b", "resolved"))]
    df = spark.createDataFrame(events, "receiver string, fingerprint string, status string, at timestamp").withColumn("labels", F.create_map(F.lit("alertname"), F.lit("x")))
    start = round(T0.timestamp() * 1e6)
    out = A.group_notifications(df, A.Grouping(), start + 600 * 60_000_000).orderBy("sent_at", "fingerprint").collect()
    wanted = sendings([(0, "a", "firing"), (1, "b", "firing"), (9, "a", "resolved"), (300, "b", "resolved")], until=600)
    assert [(r["sent_at"].replace(tzinfo=UTC), r["fingerprint"], r["status"]) for r in out] == [(T0 + timedelta(minutes=at), f, s) for at, content in wanted for f, s in content]


@pytest.mark.parametrize(
    ("a", "b", "p", "method"),
    [
        (range(1, 6), range(6, 11), 2 / 252, "exact"),
        ([0] * 10, [0] * 10, 1, "normal"),
        (range(1, 6), range(5, 10), 0.0159707, "normal"),
        (range(2, 13, 2), range(1, 12, 2), 0.699134, "exact"),
    ],
)
def test_mann_whitney(spark, a, b, p, method):
    df = spark.createDataFrame([("k", "u", float(v), r) for r, vs in (("old", a), ("new", b)) for v in vs], "name string, unit string, value double, run string")
    r = C.mann_whitney(df, "old", "new").head()
    assert r["p"] == pytest.approx(p, abs=1e-6) and r["method"] == method


def test_u_distribution_counts_all_orders():
    for n1, n2 in ((1, 1), (3, 4), (5, 2)):
        counts = [0] * (n1 * n2 + 1)
        for chosen in itertools.combinations(range(n1 + n2), n1):
            counts[sum(c - k for k, c in enumerate(chosen))] += 1
        assert list(C.u_distribution(n1, n2)) == counts


def test_ranks_spread_and_one_sided_keys(spark):
    df = spark.createDataFrame([("k", "u", v, r) for r, v in (("old", 1.0), ("old", 2.0), ("new", 2.0), ("new", 3.0))] + [("only", "u", 1.0, "new")], "name string, unit string, value double, run string")
    ranked = C.rank_pooled(df.filter("name = 'k'")).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2.5, 2.5, 4]
    out = {r["name"]: r for r in C.compare_runs(df, "old", "new").collect()}
    assert out["only"]["side"] == "new" and out["only"]["p"] is None and out["k"]["ties"] if "ties" in out["k"] else True
    spread = C.median_spread(spark.createDataFrame([("k", 90.0), ("k", 100.0), ("k", 110.0)], "name string, value double"), ["name"]).head()
    assert spread["median"] == 100 and spread["spread"] == pytest.approx(10)
    assert C.p_value(0, 3, 0, 0) == (1.0, "none")


def test_token_bucket_refills():
    b = Bucket(rate=1, burst=2)
    assert [b.allow(t) for t in (0, 0, 0, 1_000_000, 1_500_000, 10_000_000, 10_000_000, 10_000_000)] == [True, True, False, True, False, True, True, False]
