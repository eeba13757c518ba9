"""Registered queries that SQL can't express, against plain Python over the same tables."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import alerts as A
from pulsegrid.operators import compare as C
from pulsegrid.operators import rules as R
from pulsegrid.plans import alerting


def sides(spark, sf_dir):
    out = defaultdict(lambda: {"old": [], "new": []})
    for r in alerting._measurements(spark, sf_dir).collect():
        out[r["name"], r["unit"]][r["run"]].append(r["value"])
    return out


def test_mann_whitney_counts_pairs(spark, sf_dir):
    got = {(r["name"], r["unit"]): r for r in alerting.mann_whitney(spark, sf_dir).collect()}
    data = sides(spark, sf_dir)
    assert got.keys() == data.keys()
    for key, side in data.items():
        a, b = side["old"], side["new"]
        u1 = sum((x > y) + (x == y) / 2 for x in a for y in b)
        values = a + b
        ties = sum((n := values.count(v)) ** 3 - n for v in set(values))
        p, method = C.p_value(len(a), len(b), min(u1, len(a) * len(b) - u1), ties)
        r = got[key]
        assert (r["n1"], r["n2"], r["method"]) == (len(a), len(b), method)
        assert r["u"] == pytest.approx(min(u1, len(a) * len(b) - u1)) and r["ties"] == pytest.approx(ties) and r["p"] == pytest.approx(p, abs=1e-6)


def test_compare_runs_medians(spark, sf_dir):
    def median(v):
        v = sorted(v)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    for r in alerting.compare_runs(spark, sf_dir).collect():
        side = sides_cache(spark, sf_dir)[r["name"], r["unit"]]
        assert r["side"] == ("both" if side["old"] and side["new"] else "old" if side["old"] else "new")
        if r["side"] == "both":
            old, new = median(side["old"]), median(side["new"])
            assert r["delta"] == pytest.approx((new - old) / old * 100, abs=1e-5)


def test_median_spread_of_odd_groups(spark):
    data = {"one": [3.0], "two": [4.0, 1.0], "ties": [2.0, 2.0, 2.0, 9.0], "nulls": [None, 5.0, None, 7.0, 8.0], "none": [None], "zero": [-1.0, 0.0, 1.0]}
    rows = [(k, v) for k, values in data.items() for v in values]
    got = {r["name"]: tuple(r)[1:] for r in C.median_spread(spark.createDataFrame(rows, "name string, value double"), ["name"]).collect()}
    assert got == {
        "one": (1, 3.0, 0.0), "two": (2, 2.5, pytest.approx(60)), "ties": (4, 2.0, pytest.approx(175)),
        "nulls": (3, 7.0, pytest.approx(150 / 7)), "none": (0, None, 0.0), "zero": (3, 0.0, 0.0),
    }
    assert C.median_spread(spark.createDataFrame([], "name string, value double"), ["name"]).collect() == []


_cache = {}


def sides_cache(spark, sf_dir):
    if sf_dir not in _cache:
        _cache[sf_dir] = sides(spark, sf_dir)
    return _cache[sf_dir]


def test_group_notifications_step_by_step(spark, sf_dir):
    """Second by second, as a flush loop would go; flushes fall on whole seconds here."""
    routed = A.route_receivers(R.build_alerts(alerting._forwarded(spark, sf_dir), alerting.RULE), alerting.GROUPING)
    rows = routed.select(A.group_key(F.col("receiver"), F.col("labels"), alerting.BY).alias("g"), F.unix_micros("at").alias("us"), "fingerprint", "status").collect()
    wait, interval, repeat = alerting.GROUPING.timers()
    end = alerting.GRID.start + alerting.GRID.last * alerting.GRID.step
    wanted, events = set(), defaultdict(list)
    for r in rows:
        events[r["g"]].append((r["us"], r["fingerprint"], r["status"]))
    for group, found in events.items():
        members, due, last, sent = {}, None, None, None
        clock = sorted({us for us, *_ in found} | set(range(min(us for us, *_ in found), end + 1, math.gcd(wait, interval, repeat, alerting.GRID.step))))
        for now in clock:
            for _, f, s in sorted(e for e in found if e[0] == now):
                if due is None:
                    due = now + wait
                elif last is not None and members.get(f) != s:
                    due = max(now, last + interval)
                members[f] = s
            if due is not None and due <= now <= end:
                content = sorted(members.items())
                if last is not None and content == sent and now < last + repeat:
                    due = last + repeat
                    continue
                wanted |= {(group, now, f, s) for f, s in content}
                last, due, sent = now, now + repeat, content
                members = {f: s for f, s in members.items() if s != "resolved"}
                if not members:
                    due = last = sent = None
    got = {(r["group"], r["us"], r["fingerprint"], r["status"]) for r in alerting.group_notifications(spark, sf_dir).collect()}
    assert got == wanted
