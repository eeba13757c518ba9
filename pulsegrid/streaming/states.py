"""Stateful streaming: alert states, group notifications, token buckets.

All three keep one small value for each key, in the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.functions.times import micros
from pulsegrid.operators.alerts import Grouping, GroupState, group_key
from pulsegrid.operators.ratelimit import Bucket
from pulsegrid.operators.rules import RESEND, Rule

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 10 * 60 * 1000
#: By how much a tick moves time past its own: beyond the timer of an alert that is due then.
TICK_US = 2000
EVENTS = "rule_id string, fingerprint string, at timestamp, status string, value double, starts_at timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    """Processors with state need this provider; set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _stamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class AlertProcessor(StatefulProcessor):
    """The life of one alert: pending, firing after `for`, sent again, resolved when a time passes without it."""

    def __init__(self, rule: Rule, resend: str = RESEND):
        self.wait, self.interval, self.resend = micros(rule.for_), micros(rule.interval), micros(resend)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", "active long, fired boolean, sent long, last long, value double")

    def _resolved(self, key, state) -> tuple:
        active, _, _, last, value = state
        return (*key, _stamp(last + self.interval), "resolved", value, _stamp(active))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["rule_id", "fingerprint", "at", "status", "value", "starts_at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        times = sorted((int(us), float(v)) for pdf in rows for us, v in zip(pdf["us"], pdf["value"], strict=True))
        out = []
        for us, value in times:
            if state is not None and us <= state[3]:
                continue  # a time that has been taken in before
            if state is not None and us - state[3] > self.interval:
                if state[1]:
                    out.append(self._resolved(key, state))
                state = None
            active, fired, sent, _, _ = state if state is not None else (us, False, 0, us, value)
            if not fired and us - active >= self.wait or fired and us - sent >= self.resend:
                fired, sent = True, us
                out.append((*key, _stamp(us), "firing", value, _stamp(active)))
            state = (active, fired, sent, us, value)
        if state is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.state.update(state)
            # Just after the next time: what comes at that time is still in time.
            self.handle.registerTimer((state[3] + self.interval) // 1000 + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            state = self.state.get()
            if state[1]:
                out.append(self._resolved(key, state))
            self.state.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def stream_alert_states(active: DataFrame, rule: Rule, resend: str = RESEND, watermark: str = "0 seconds", ticks: DataFrame | None = None) -> DataFrame:
    """Alert events from a stream (rule_id, fingerprint, at, value) of active alerts at evaluation times.

    Alerts alone can't tell that time passes without them: when the last ones end, no row
    comes that moves the watermark, and none of them is resolved. `ticks` is a stream of
    evaluation times (at), each sent when the alerts of its time have been. It moves the watermark just past that
    time, so what was not active then is resolved. The watermark stands on the union of
    both streams: with one on each, the lower would hold, the silent alerts' own, or with
    the policy `max` the ticks would make alerts late. `watermark` is how long after its tick an alert may come.
    """
    use_rocksdb(active.sparkSession)
    rows = active.select("rule_id", "fingerprint", "at", "value")
    if ticks is not None:
        over = F.timestamp_micros(F.unix_micros("at") + TICK_US)
        rows = rows.unionByName(ticks.select(over.alias("at")).filter("at IS NOT NULL"), allowMissingColumns=True)
    # Ticks have done their work at the watermark. Naming the time keeps the filter from being moved below it.
    rows = rows.withWatermark("at", watermark).filter(F.col("fingerprint").isNotNull() | F.col("at").isNull())
    rows = rows.select("rule_id", "fingerprint", "at", F.unix_micros("at").alias("us"), "value")
    return rows.groupBy("rule_id", "fingerprint").transformWithStateInPandas(AlertProcessor(rule, resend), EVENTS, outputMode="Append", timeMode="EventTime")


class GroupProcessor(StatefulProcessor):
    """One group's timers: wait before the first sending, pull later ones in on changes, repeat."""

    def __init__(self, grouping: Grouping):
        self.timers = grouping.timers()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", "body string")

    def _load(self) -> GroupState:
        if not self.state.exists():
            return GroupState(self.timers)
        members, next_flush, last_flush, sent = json.loads(self.state.get()[0])
        return GroupState(self.timers, members, next_flush, last_flush, None if sent is None else [tuple(x) for x in sent])

    def _store(self, s: GroupState) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s.next_flush is None:
            self.state.clear()
            return
        self.state.update((json.dumps([s.members, s.next_flush, s.last_flush, s.sent]),))
        self.handle.registerTimer(s.next_flush // 1000 + 1)

    def _send(self, key, s: GroupState, limit: int, out: list) -> None:
        while s.next_flush is not None and s.next_flush < limit:
            at = s.next_flush
            out.extend((*key, _stamp(at), f, status) for f, status in s.flush() or ())

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["group", "receiver", "sent_at", "fingerprint", "status"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        for us, fingerprint, status in sorted((int(a), b, c) for pdf in rows for a, b, c in zip(pdf["us"], pdf["fingerprint"], pdf["status"], strict=True)):
            self._send(key, s, us, out)
            s.take(us, fingerprint, status)
        self._store(s)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        self._send(key, s, expiredTimerInfo.getExpiryTimeInMs() * 1000, out)
        self._store(s)
        yield self._frame(out)

    def close(self) -> None:
        pass


def stream_group(routed: DataFrame, grouping: Grouping, watermark: str = "0 seconds") -> DataFrame:
    """Members of every sending, from a stream of routed alert events (receiver, labels, at, fingerprint, status)."""
    use_rocksdb(routed.sparkSession)
    rows = routed.withWatermark("at", watermark).select(
        group_key(F.col("receiver"), F.col("labels"), grouping.by).alias("group"), "receiver", "at", F.unix_micros("at").alias("us"), "fingerprint", "status"
    )
    schema = "group string, receiver string, sent_at timestamp, fingerprint string, status string"
    return rows.groupBy("group", "receiver").transformWithStateInPandas(GroupProcessor(grouping), schema, outputMode="Append", timeMode="EventTime")


class BucketProcessor(StatefulProcessor):
    """One agent's token bucket; forgotten after `idle_ms` without rows, if given."""

    def __init__(self, rate: float, burst: int, idle_ms: int | None):
        self.rate, self.burst, self.idle_ms = rate, burst, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, at long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, at = self.state.get() if self.state.exists() else (None, None)
        bucket, out = Bucket(self.rate, self.burst, tokens, at), []
        for us, order in sorted((int(a), int(b)) for pdf in rows for a, b in zip(pdf["us"], pdf["seq"], strict=True)):
            out.append((key[0], order, bucket.allow(us)))
        if bucket.at is not None:
            self.state.update((bucket.tokens, bucket.at))
        yield pd.DataFrame(out, columns=["key", "seq", "allowed"])

    def close(self) -> None:
        pass


def stream_token_bucket(rows: DataFrame, rate: float, burst: int, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """(key, seq, allowed) from a stream (key, seq, ts).

    Forgetting idle buckets goes by the clock, which keeps a stream's batches coming; a
    stream that should end with its input does without (idle_ms=None).
    """
    use_rocksdb(rows.sparkSession)
    light = rows.select("key", "seq", F.unix_micros("ts").alias("us"))
    mode = "ProcessingTime" if idle_ms else "None"
    return light.groupBy("key").transformWithStateInPandas(BucketProcessor(rate, burst, idle_ms), "key string, seq long, allowed boolean", outputMode="Append", timeMode=mode)
