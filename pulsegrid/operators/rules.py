"""Rules over vectors: backtests, alert states as intervals, alert events."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.floats import shortest
from pulsegrid.functions.labels import fingerprint, label, labels_of, match_labels, merge_labels, without
from pulsegrid.functions.times import micros
from pulsegrid.operators.vector import Grid, Vector

INTERVAL, RESEND, RESOLVED_MEMORY = "1m", "1m", "15m"
ANNOTATION_LIMIT = 4096
SEVERITIES = ("info", "warning", "critical")


@dataclass(frozen=True)
class Rule:
    """A rule's identity and what its alerts carry; `for_` is how long it must hold."""

    id: str
    name: str
    for_: str = "0"
    interval: str = INTERVAL
    severity: str = "warning"
    tenant: str = ""
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)
    receivers: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.id or not self.name.strip():
            raise ValueError("a rule needs an id and a name")
        if "tenant" in self.labels:
            raise ValueError("tenant is set by the server, not by a rule")
        if micros(self.for_) < 0 or self.severity not in SEVERITIES:
            raise ValueError("a rule's duration isn't negative, and its severity is one of " + ", ".join(SEVERITIES))


def _map(values: dict[str, str]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def backtest(vector: Vector) -> DataFrame:
    """(t, labels, key, value) at every time of the grid that has results; the grid limits its steps."""
    return vector.result()


def alert_labels(rule: Rule, labels: Column) -> Column:
    """A sample's labels under the rule's, with a name and severity, and the rule's own tenant or none."""
    defaults = _map({"alertname": rule.name, "severity": rule.severity})
    out = merge_labels(defaults, labels, _map(rule.labels))
    return merge_labels(out, _map({"tenant": rule.tenant})) if rule.tenant else without(out, ["tenant"])


def collapse_duplicates(results: DataFrame) -> DataFrame:
    """Of samples of one rule, time and fingerprint, the first by key."""
    columns = [c for c in results.columns if c not in ("rule_id", "i", "fingerprint")]
    kept = results.groupBy("rule_id", "i", "fingerprint").agg(F.min_by(F.struct(*columns), "key").alias("s"))
    return kept.select("rule_id", "i", "fingerprint", *(f"s.{c}" for c in columns))


def evaluate(rule: Rule, vector: Vector) -> DataFrame:
    """(rule_id, i, fingerprint, key, labels, value): the rule's active alerts at each time."""
    labels = alert_labels(rule, labels_of(F.col("key")))
    rows = vector.df.select(F.lit(rule.id).alias("rule_id"), "i", labels.alias("labels"), "key", "value")
    return collapse_duplicates(rows.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("labels"))))


def alert_states(results: DataFrame, rule: Rule, grid: Grid) -> DataFrame:
    """One row for each run of consecutive active times of an alert.

    (rule_id, fingerprint, labels, value, first_i, last_i, fired_i, resolved_i): value is
    the last; fired_i is null if the run ends before `for` has passed, resolved_i if it
    has not fired or still lasts at the grid's end.
    """
    wait = -(-micros(rule.for_) // grid.step)
    rows = results.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("rule_id", "fingerprint").orderBy("i")))
    runs = rows.groupBy("rule_id", "fingerprint", "run").agg(
        F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.max_by(F.struct("labels", "value"), "i").alias("s")
    )
    fired = F.when(F.col("last_i") >= F.col("first_i") + wait, F.col("first_i") + wait)
    return runs.select("rule_id", "fingerprint", "s.labels", "s.value", "first_i", "last_i", fired.alias("fired_i")).withColumn(
        "resolved_i", F.when(F.col("fired_i").isNotNull() & (F.col("last_i") < grid.last), F.col("last_i") + 1)
    )


def state_at(states: DataFrame, i: int, grid: Grid) -> DataFrame:
    """Every alert's state at one time: pending, firing, or resolved for as long as that is remembered."""
    memory = micros(RESOLVED_MEMORY) // grid.step
    state = (
        F.when((F.col("first_i") <= i) & (F.col("last_i") >= i), F.when(F.col("fired_i") <= i, "firing").otherwise("pending"))
        .when((F.col("resolved_i") <= i) & (F.lit(i) - F.col("resolved_i") <= memory), "resolved")
    )
    return states.withColumn("state", state).filter("state IS NOT NULL")


def active_alerts(states: DataFrame, i: int, grid: Grid, tenant: str = "") -> DataFrame:
    """Pending and firing alerts at one time, of one tenant or all."""
    rows = state_at(states, i, grid).filter(F.col("state").isin("pending", "firing"))
    return rows.filter(match_labels(F.col("labels"), {"tenant": tenant})) if tenant else rows


def alert_listing(alerts: DataFrame, state: str = "") -> DataFrame:
    """Alerts of a state, firing ones first, then by name and fingerprint."""
    rows = alerts.filter(F.col("state") == state) if state else alerts
    rank = F.when(F.col("state") == "firing", 0).when(F.col("state") == "pending", 1).otherwise(0)
    return rows.orderBy(rank, label(F.col("labels"), "alertname"), "fingerprint")


def alert_events(results: DataFrame, states: DataFrame, rule: Rule, grid: Grid, resend: str = RESEND) -> DataFrame:
    """(rule_id, fingerprint, i, status, labels, value, starts_at, ends_at).

    Firing when the alert fires and again whenever `resend` has passed, each with the
    value of its time; resolved once, with the last value.
    """
    every = max(1, -(-micros(resend) // grid.step))
    fired = states.filter("fired_i IS NOT NULL")
    times = fired.select("rule_id", "fingerprint", "first_i", F.explode(F.sequence("fired_i", "last_i", F.lit(every).cast("long"))).alias("i"))
    firing = times.join(results.select("rule_id", "fingerprint", "i", "labels", "value"), ["rule_id", "fingerprint", "i"])
    columns = ["rule_id", "fingerprint", "i", "status", "labels", "value", "starts_at", "ends_at"]
    firing = firing.withColumns({"status": F.lit("firing"), "starts_at": grid.time(F.col("first_i")), "ends_at": F.lit(None).cast("timestamp")})
    resolved = fired.filter("resolved_i IS NOT NULL").withColumns(
        {"i": F.col("resolved_i"), "status": F.lit("resolved"), "starts_at": grid.time(F.col("first_i")), "ends_at": grid.time(F.col("resolved_i"))}
    )
    return firing.select(*columns).unionByName(resolved.select(*columns))


def resolve_removed(states: DataFrame, removed: DataFrame, i: int, grid: Grid) -> DataFrame:
    """Resolved events at time i for what rules that were deleted or disabled have left firing."""
    open_ = state_at(states, i, grid).filter("state = 'firing'").join(removed.select("rule_id").distinct(), "rule_id", "left_semi")
    return open_.select(
        "rule_id", "fingerprint", F.lit(i).cast("long").alias("i"), F.lit("resolved").alias("status"), "labels", "value", grid.time(F.col("first_i")).alias("starts_at"), grid.time(F.lit(i)).alias("ends_at")
    )


_NAME = r"\.(?:Value|Labels\.[A-Za-z_]\w*)"
_FORMS = re.compile(rf'\{{\{{\s*(?:(?P<name>{_NAME})|printf\s+"(?P<format>(?:[^"\\%]|%%|%\.?\d*[A-Za-z])*)"\s+(?P<of>{_NAME}))\s*\}}\}}')
_VERB = re.compile(r"%(?:%|(?:\.(\d+))?([a-z]))")
#: Words that begin what the template language has besides the forms known here.
_ACTIONS = re.compile(
    r"\{\{-?\s*(?:(?:if|range|with|define|template|block|and|or|not|call|html|index|slice|js|len|print|printf|println|urlquery|eq|ne|lt|le|gt|ge)\s+[^\s}]|(?:else|end|break|continue)\b|[$(\"/])|\{\{[^}]*\||\{\{-|-\}\}"
)


def _printed(format_: str, value: Column, number: bool) -> list[Column]:
    """The parts of a printf with one value: %.Nf, %f or %v of a number, %s or %v of a label."""
    parts, at, used = [], 0, 0
    for m in _VERB.finditer(format_):
        parts.append(F.lit(format_[at : m.start()]))
        at = m.end()
        if m[0] == "%%":
            parts.append(F.lit("%"))
        elif number and m[2] == "f":
            places = int(m[1] or 6) if m[1] != "" else 0
            text = F.format_string(f"%.{places}f", F.bround(value, places))
            parts.append(F.when(F.isnan(value) | (F.abs(value) == float("inf")), shortest(value)).otherwise(text))
            used += 1
        elif m[1] is None and m[2] in (("v", "g") if number else ("v", "s")):
            parts.append(value if not number else shortest(value))
            used += 1
        else:
            raise ValueError(f"templates can't print {m[0]!r} of a {'number' if number else 'label'}")
    if used != 1:
        raise ValueError(f"a printf in a template prints one value: {format_!r}")
    return [*parts, F.lit(format_[at:])]


def render(template: str, value: Column, labels: Column) -> Column:
    """A template's text with {{ .Value }}, {{ .Labels.name }} and printf of one of them filled in.

    Text of more than ANNOTATION_LIMIT bytes is cut there, before a character that
    would be cut through. A template with a name that doesn't exist stays as it is; one
    that uses other parts of the template language raises a ValueError.
    """
    left = _FORMS.sub("", template)
    if _ACTIONS.search(left):
        raise ValueError(f"templates know names and printf only: {template!r}")
    if "{{" in left or "}}" in left:
        return F.lit(template)
    parts, at = [], 0
    of = lambda name: shortest(value) if name == ".Value" else label(labels, name.removeprefix(".Labels."))
    for m in _FORMS.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        if m["name"]:
            parts.append(of(m["name"]))
        else:
            number = m["of"] == ".Value"
            parts += _printed(m["format"], value if number else of(m["of"]), number)
        at = m.end()
    text = F.concat(*parts, F.lit(template[at:]))
    # A character has four bytes at most, and all but its first begin with the bits 10.
    begins = lambda n: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), n, 1)), 16, 10).cast("int").bitwiseAND(0xC0) != 0x80
    end = F.lit(ANNOTATION_LIMIT - 3)
    for back in (2, 1, 0):
        end = F.when(begins(ANNOTATION_LIMIT + 1 - back), ANNOTATION_LIMIT - back).otherwise(end)
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), end), "UTF-8")
    return F.when(F.octet_length(text) <= ANNOTATION_LIMIT, text).otherwise(cut)


def render_annotations(rule: Rule, value: Column, labels: Column) -> Column:
    """A rule's annotations for one alert, as a map."""
    if not rule.annotations:
        return _map({})
    return F.create_map(*(x for k, t in rule.annotations.items() for x in (F.lit(k), render(t, value, labels))))


def build_alerts(events: DataFrame, rule: Rule) -> DataFrame:
    """Events with what notifications need: name, severity, annotations, receivers."""
    return events.withColumns(
        {
            "rule_name": F.lit(rule.name),
            "severity": F.lit(rule.severity),
            "annotations": render_annotations(rule, F.col("value"), F.col("labels")),
            "receivers": F.array(*(F.lit(r) for r in rule.receivers)).cast("array<string>"),
        }
    )
