"""Silencing, inhibition, routing and grouping of alert events.

Alert frames have fingerprint, status, labels and a time `at`. Silences are a table with
arrays of matchers, joined on the tenant; inhibition rules are configuration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.labels import PATTERN_LIMIT, Matcher, canonical_labels, label, label_matcher, match_all
from pulsegrid.functions.times import micros

LISTED, LOOKBACK, STALE_AFTER = 10, "15m", "2m"
#: Parts of a slot, over which the alerts in it are spread.
SALTS = 16
#: Lengths of the time slots (microseconds, an hour to thirty years) that silences and alerts meet in.
SLOTS = [3_600_000_000 * 4**k for k in range(10)]


def tenant_of(labels: Column) -> Column:
    return label(labels, "tenant")


# Silences: id, tenant, matchers, starts_at, ends_at


def silence_active(silences: DataFrame, at: Column) -> DataFrame:
    """Silences in force at a time: from their start, up to but not at their end."""
    return silences.filter((F.col("starts_at") <= at) & (at < F.col("ends_at")))


def silence_mutes(alerts: DataFrame, silences: DataFrame, at: str = "at") -> DataFrame:
    """All alerts and `silenced`: whether a silence in force at `at`, of the alert's tenant or of none, matches.

    Silences without a tenant hold for all, so an alert looks them up beside its own
    tenant's. Both are equi-joins on a slot of time too: a silence is in the one or two
    slots it covers of the shortest length that isn't shorter than itself, and an alert
    looks into its slot of each length that some silence has, so it meets only silences
    near its time. Longer silences than any slot share one. All alerts of years can look
    into one slot of a great length; so a slot is in SALTS parts, its silences in each of
    them and an alert in one.
    """
    first, end = F.unix_micros("starts_at"), F.unix_micros("ends_at") - 1
    covered = F.array(_slot(len(SLOTS), F.lit(0).cast("long")))
    for k, w in reversed(list(enumerate(SLOTS))):
        both = F.array_distinct(F.array(*(_slot(k, x - F.pmod(x, F.lit(w))) for x in (first, end))))
        covered = F.when(end - first < w, both).otherwise(covered)
    s = silences.filter(F.col("starts_at") < F.col("ends_at")).select(F.coalesce("tenant", F.lit("")).alias("_scope"), "matchers", "starts_at", "ends_at", F.explode(covered).alias("_slot"))
    levels = sorted(r["level"] for r in s.select("_slot.level").distinct().collect())  # one more than SLOTS at most
    if not levels:
        return alerts.withColumn("silenced", F.lit(False))
    s = s.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_salt", F.col("_salt").cast("long"))
    hit = _lookups(alerts, levels, at).join(s, ["_scope", "_slot", "_salt"])
    hit = hit.filter((F.col("starts_at") <= F.col("_at")) & (F.col("_at") < F.col("ends_at")) & match_all(F.col("matchers"), F.col("labels")))
    muted = hit.select("fingerprint", F.col("_at").alias(at)).distinct().withColumn("silenced", F.lit(True))
    return alerts.join(muted, ["fingerprint", at], "left").withColumn("silenced", F.coalesce("silenced", F.lit(False)))


def _slot(level: int, start: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), start.alias("start"))


def _lookups(alerts: DataFrame, levels: list[int], at: str) -> DataFrame:
    """Each alert once for each scope and each level of slots: (fingerprint, _at, labels, _scope, _slot, _salt)."""
    us = F.unix_micros(at)
    start = lambda k: us - F.pmod(us, F.lit(SLOTS[k])) if k < len(SLOTS) else F.when(us.isNotNull(), F.lit(0).cast("long"))
    scopes = F.array_distinct(F.array(tenant_of(F.col("labels")), F.lit("")))
    salt = F.pmod(F.xxhash64("fingerprint", at), F.lit(SALTS)).alias("_salt")
    rows = alerts.select("fingerprint", F.col(at).alias("_at"), "labels", F.array(*(_slot(k, start(k)) for k in levels)).alias("_slots"), salt, F.explode(scopes).alias("_scope"))
    return rows.withColumn("_slot", F.explode("_slots")).drop("_slots")


def delivery_silence(members: DataFrame, silences: DataFrame) -> DataFrame:
    """Group members that no silence mutes at the time of sending, `sent_at`."""
    return silence_mutes(members, silences, "sent_at").filter("NOT silenced").drop("silenced")


def silence_gc(silences: DataFrame, now: Column) -> DataFrame:
    """Silences whose end lies ahead."""
    return silences.filter(F.col("ends_at") > now)


def silence_validate(silences: DataFrame) -> DataFrame:
    """Ends filled in from `duration` (seconds) where not given, and `error`: why a silence is refused, or null."""
    rows = silences
    if "duration" in silences.columns:
        rows = rows.withColumn("ends_at", F.coalesce("ends_at", F.timestamp_micros(F.unix_micros("starts_at") + (F.col("duration").cast("double") * 1_000_000).cast("long"))))

    def usable(m: Column) -> Column:
        pattern = m["op"].isin("=~", "!~")
        return (F.coalesce(m["name"], F.lit("")) != "") & (m["op"].isin("=", "!=") | pattern & (F.octet_length(m["value"]) <= PATTERN_LIMIT))

    error = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "silence id is required")
        .when(F.coalesce(F.size("matchers"), F.lit(0)) <= 0, "silence needs at least one matcher")
        .when(~F.coalesce(F.forall("matchers", usable), F.lit(False)), "unusable matcher")
        .when(~F.coalesce(F.col("ends_at") > F.col("starts_at"), F.lit(False)), "silence ends_at must be after starts_at")
    )
    return rows.withColumn("error", error)


def silence_listing(silences: DataFrame, now: Column, tenant: str = "", expired: bool = False) -> DataFrame:
    """Silences with their status, by id; expired ones only if asked for; of one tenant or all."""
    status = F.when(now < F.col("starts_at"), "pending").when(now < F.col("ends_at"), "active").otherwise("expired")
    rows = silences.withColumn("status", status)
    if tenant:
        rows = rows.filter(F.coalesce("tenant", F.lit("")) == tenant)
    return (rows if expired else rows.filter("status <> 'expired'")).orderBy("id")


@dataclass(frozen=True)
class InhibitRule:
    """A firing alert that all source matchers hold for mutes those that all target matchers hold for, if `equal` labels agree."""

    source: tuple[Matcher, ...]
    target: tuple[Matcher, ...]
    equal: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.source or not self.target:
            raise ValueError("an inhibition rule needs source and target matchers")


def inhibit(alerts: DataFrame, firing: DataFrame, rules: list[InhibitRule], at: str = "at") -> DataFrame:
    """All alerts and `inhibited`: whether a firing source mutes them at their time.

    `firing` has fingerprint, labels and the time [fires_at, resolves_at) it fires. A
    source must have the target's tenant, be another alert, and agree on the rule's
    `equal` labels, absent ones counting as empty. Rule, tenant and those labels make a key.

    Sources and targets of a key don't meet. The starts and ends of sources are added up
    along time, so at each time there is a number of sources that fire, and a digest of
    them: of one, its own. A target is muted where two fire, or one with another digest
    than its own. Time is cut into slots of an hour, whose sums are added up first, so a
    key is spread over tasks; the rows are the distinct times of a key.
    """
    labels = F.col("labels")

    def sides(matchers) -> Column:
        """An element for each rule that applies: its number and the values that must agree."""
        each = []
        for n, rule in enumerate(rules):
            holds = F.lit(True)
            for m in matchers(rule):
                holds = holds & label_matcher(labels, m)
            key = F.struct(F.lit(n).alias("rule"), tenant_of(labels).alias("tenant"), F.array(*(label(labels, k) for k in rule.equal)).cast("array<string>").alias("equal"))
            each.append(F.when(holds, key))
        return F.array_compact(F.array(*each))

    unchanged = alerts.withColumn("inhibited", F.lit(False))
    if not rules:
        return unchanged
    targets = alerts.select("fingerprint", F.col(at).alias("_at"), F.unix_micros(at).alias("_us"), F.explode(sides(lambda r: r.target)).alias("_key"))
    sources = firing.select("fingerprint", F.unix_micros("fires_at").alias("_from"), F.unix_micros("resolves_at").alias("_to"), F.explode(sides(lambda r: r.source)).alias("_key"))
    changes = _stretches(sources).withColumn("_change", F.explode(F.array(F.struct(F.col("_from").alias("us"), F.lit(1).alias("n")), F.struct(F.col("_to").alias("us"), F.lit(-1).alias("n")))))
    changes = changes.filter("_change.us IS NOT NULL").select("_key", F.col("_change.us").alias("_us"), F.col("_change.n").alias("n"), *_digests())
    at_times = _firing_at(changes, targets.select("_key", "_us").distinct())
    other = (F.col("n") >= 2) | (F.col("n") == 1) & ((F.col("x") != _digests()[0]) | (F.col("y") != _digests()[1]))
    met = targets.join(at_times, ["_key", "_us"]).filter(other)
    muted = met.select("fingerprint", F.col("_at").alias(at)).distinct().withColumn("inhibited", F.lit(True))
    return alerts.join(muted, ["fingerprint", at], "left").withColumn("inhibited", F.coalesce("inhibited", F.lit(False)))


def _digests() -> list[Column]:
    """Two digests of an alert; those of several are combined by exclusive or, which takes one out again as it was put in."""
    return [F.xxhash64("fingerprint").alias("x"), F.xxhash64("fingerprint", F.lit("second")).alias("y")]


def _stretches(sources: DataFrame) -> DataFrame:
    """(_key, fingerprint, _from, _to): times of one source that overlap or meet are one; an end that is null is open."""
    rows = sources.filter("_from IS NOT NULL AND (_to IS NULL OR _from < _to)").withColumn("_end", F.coalesce("_to", F.lit((1 << 63) - 1)))
    order = Window.partitionBy("_key", "fingerprint").orderBy("_from", "_end")
    reached = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("_from") <= reached, 0).otherwise(1)).withColumn("_stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("_key", "fingerprint", "_stretch").agg(F.min("_from").alias("_from"), F.max("_end").alias("_end"))
    return merged.select("_key", "fingerprint", "_from", F.when(F.col("_end") < (1 << 63) - 1, F.col("_end")).alias("_to"))


def _firing_at(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """(_key, _us, n, x, y) at the times asked for: how many sources fire then, changes of that time included, and their digests."""
    parts = lambda: [F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")]
    times = changes.groupBy("_key", "_us").agg(*parts())
    none = [F.lit(0).cast("long").alias(c) for c in ("n", "x", "y")]
    slot = F.floor(F.col("_us") / SLOTS[0])
    # A slot begins with what all before it add up to, as a row before its first time.
    slots = times.withColumn("slot", slot + 1).groupBy("_key", "slot").agg(*parts())
    slots = slots.unionByName(asked.select("_key", slot.alias("slot"), *none)).groupBy("_key", "slot").agg(*parts())
    slots = slots.unionByName(times.select("_key", slot.alias("slot"), *none)).groupBy("_key", "slot").agg(*parts())
    before = Window.partitionBy("_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    over = lambda w: [F.sum("n").over(w).alias("n"), F.bit_xor("x").over(w).alias("x"), F.bit_xor("y").over(w).alias("y")]
    begin = slots.select("_key", "slot", F.lit(None).cast("long").alias("_us"), *over(before), F.lit(False).alias("asked"))
    rows = times.withColumn("asked", F.lit(False)).unionByName(asked.select("_key", "_us", *none, F.lit(True).alias("asked")))
    rows = rows.groupBy("_key", "_us").agg(*parts(), F.max("asked").alias("asked")).withColumn("slot", slot)
    within = Window.partitionBy("_key", "slot").orderBy(F.asc_nulls_first("_us")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("_key", "slot", "_us", "n", "x", "y", "asked").unionByName(begin).select("_key", "_us", *over(within), "asked")
    return found.filter("asked").drop("asked")


def forwarded_resolutions(alerts: DataFrame, at: str = "at") -> DataFrame:
    """What goes on to grouping: firing alerts that aren't muted, and resolutions of alerts whose firing went on since their last resolution.

    `muted` says of a firing alert whether it was silenced or inhibited.
    """
    past = Window.partitionBy("fingerprint").orderBy(at, F.when(F.col("status") == "firing", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("fingerprint").orderBy(at, F.when(F.col("status") == "firing", 0).otherwise(1))
    rows = alerts.withColumn("_n", F.row_number().over(order))
    sent = F.max(F.when((F.col("status") == "firing") & ~F.col("muted"), F.col("_n"))).over(past)
    ended = F.max(F.when(F.col("status") == "resolved", F.col("_n"))).over(past)
    rows = rows.withColumns({"_sent": F.coalesce(sent, F.lit(0)), "_ended": F.coalesce(ended, F.lit(0))})
    keep = F.when(F.col("status") == "firing", ~F.col("muted")).otherwise(F.col("_sent") > F.col("_ended"))
    return rows.filter(keep).drop("_n", "_sent", "_ended")


# Routing and grouping


@dataclass(frozen=True)
class Grouping:
    """How alerts make groups, and when groups are sent; a repeat below the interval is raised to it."""

    by: tuple[str, ...] = ("alertname", "tenant")
    wait: str = "30s"
    interval: str = "5m"
    repeat: str = "4h"
    default_receivers: tuple[str, ...] = ()

    def timers(self) -> tuple[int, int, int]:
        wait, interval, repeat = (micros(x) if micros(x) > 0 else micros(d) for x, d in ((self.wait, "30s"), (self.interval, "5m"), (self.repeat, "4h")))
        return wait, interval, max(interval, repeat)


def route_receivers(alerts: DataFrame, grouping: Grouping) -> DataFrame:
    """One row for each receiver of an alert, its own or else the defaults; without any it is dropped."""
    defaults = F.array(*(F.lit(r) for r in grouping.default_receivers)).cast("array<string>")
    return alerts.withColumn("receiver", F.explode(F.when(F.size("receivers") > 0, F.col("receivers")).otherwise(defaults)))


def group_key(receiver: Column, labels: Column, by: tuple[str, ...]) -> Column:
    """Readable identity of a group: receiver|k=v,k=v with the names sorted, absent labels empty."""
    parts = [F.concat(F.lit(f"{k}="), label(labels, k)) for k in sorted(by)]
    return F.concat(receiver, F.lit("|"), F.concat_ws(",", *parts))


def group_labels(labels: Column, by: tuple[str, ...]) -> Column:
    """The group-by labels that an alert has."""
    return F.map_filter(labels, lambda k, v: k.isin(*by) & (v != ""))


def group_content_hash(members: Column) -> Column:
    """Digest of members' fingerprints and statuses, in order of fingerprint."""
    each = F.transform(F.array_sort(members), lambda m: F.concat(m["fingerprint"], F.lit("\0"), m["status"], F.lit("\0")))
    return F.sha2(F.array_join(each, "").cast("binary"), 256)


class GroupState:
    """One group's bookkeeping, for the batch fold and the stream alike; times in microseconds."""

    def __init__(self, timers: tuple[int, int, int], members=None, next_flush=None, last_flush=None, sent=None):
        self.wait, self.interval, self.repeat = timers
        self.members: dict[str, str] = members or {}
        self.next_flush, self.last_flush, self.sent = next_flush, last_flush, sent

    def take(self, at: int, fingerprint: str, status: str) -> None:
        """Add or change a member. A change pulls the next sending in, but not closer than the interval to the last."""
        if self.next_flush is None:
            self.next_flush = at + self.wait
        elif self.members.get(fingerprint) != status and self.last_flush is not None:
            self.next_flush = max(at, self.last_flush + self.interval)
        self.members[fingerprint] = status

    def flush(self) -> list[tuple[str, str]] | None:
        """What is sent at next_flush, or None where nothing new is due; moves the timers on."""
        at, content = self.next_flush, sorted(self.members.items())
        if self.last_flush is not None and self.sent == content and at < self.last_flush + self.repeat:
            self.next_flush = self.last_flush + self.repeat
            return None
        self.last_flush, self.next_flush, self.sent = at, at + self.repeat, content
        self.members = {f: s for f, s in self.members.items() if s != "resolved"}
        if not self.members:  # the incident is over, and a later alert opens a new group
            self.next_flush = self.last_flush = self.sent = None
        return content


NOTIFICATIONS = "group string, receiver string, sent_at timestamp, fingerprint string, status string"


def group_notifications(routed: DataFrame, grouping: Grouping, until: int) -> DataFrame:
    """(group, receiver, sent_at, fingerprint, status): the members of every sending up to `until` (microseconds).

    A group's events are folded in order of time and fingerprint; at one time, what is
    due is sent before later alerts are taken in, after those of the same time.
    """
    timers = grouping.timers()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, GroupState(timers), []

        def send(limit: int) -> None:
            while state.next_flush is not None and state.next_flush < limit:
                at = state.next_flush
                out.extend((*key, pd.Timestamp(at, unit="us"), f, s) for f, s in state.flush() or ())

        for events in frames:
            for group, receiver, us, fingerprint, status in events.itertuples(index=False, name=None):
                if (group, receiver) != key:
                    send(until + 1)
                    key, state = (group, receiver), GroupState(timers)
                send(us)
                state.take(int(us), fingerprint, status)
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        send(until + 1)
        yield pd.DataFrame(out, columns=columns)

    columns = ["group", "receiver", "sent_at", "fingerprint", "status"]
    rows = routed.select(group_key(F.col("receiver"), F.col("labels"), grouping.by).alias("group"), "receiver", F.unix_micros("at").alias("us"), "fingerprint", "status")
    return rows.repartition("group", "receiver").sortWithinPartitions("group", "receiver", "us", "fingerprint", "status").mapInPandas(fold, NOTIFICATIONS)


def notifications(members: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each sending: group, receiver, sent_at, alerts (array, by fingerprint); `labels` has fingerprint and labels."""
    rows = members.join(labels.select("fingerprint", "labels"), "fingerprint")
    alert = F.struct("fingerprint", "status", "labels")
    # Maps don't sort, so members are put in order by fingerprint with a comparison of that field.
    ordered = F.array_sort(F.collect_list(alert), lambda a, b: F.when(a["fingerprint"] < b["fingerprint"], -1).when(a["fingerprint"] > b["fingerprint"], 1).otherwise(0))
    return rows.groupBy("group", "receiver", "sent_at").agg(ordered.alias("alerts"))


def group_status_counts(alerts: Column) -> Column:
    """(status, firing, resolved) of a group's alerts; a group fires while any of them does."""
    firing = F.size(F.filter(alerts, lambda a: a["status"] == "firing"))
    return F.struct(F.when(firing > 0, "firing").otherwise("resolved").alias("status"), firing.alias("firing"), (F.size(alerts) - firing).alias("resolved"))


def group_summary(alerts: Column) -> Column:
    """A line for each of the first members, and an ellipsis for the rest."""
    line = lambda a: F.concat_ws(" ", a["status"], label(a["labels"], "alertname"), canonical_labels(a["labels"]))
    lines = F.transform(F.slice(alerts, 1, LISTED), line)
    return F.when(F.size(alerts) > LISTED, F.concat(lines, F.array(F.lit("…")))).otherwise(lines)


def notification_payload(group: Column, receiver: Column, labels: Column, alerts: Column) -> Column:
    """The JSON body that subscribers get."""
    return F.to_json(
        F.struct(
            F.lit("1").alias("version"), group.alias("group_key"), receiver.alias("receiver"), group_status_counts(alerts)["status"].alias("status"), labels.alias("group_labels"), alerts.alias("alerts")
        )
    )


def agents_list(heartbeats: DataFrame, now: Column, lookback: str = LOOKBACK, stale_after: str = STALE_AFTER) -> DataFrame:
    """(agent_id, last_seen, uptime, tenant, status) of each agent heard of in the lookback, by agent."""
    age = lambda ts: F.unix_micros(now) - F.unix_micros(ts)
    rows = heartbeats.withColumn("agent_id", label(F.col("labels"), "agent_id")).filter((F.col("agent_id") != "") & age(F.col("ts")).between(0, micros(lookback)))
    newest = rows.groupBy("agent_id").agg(F.max("ts").alias("last_seen"), F.max_by(F.struct("value", tenant_of(F.col("labels")).alias("tenant")), "ts").alias("s"))
    status = F.when(age(F.col("last_seen")) > micros(stale_after), "stale").otherwise("healthy")
    return newest.select("agent_id", "last_seen", F.col("s.value").alias("uptime"), "s.tenant", status.alias("status")).orderBy("agent_id")
