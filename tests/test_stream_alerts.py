"""Alert states on streams with ticks: all alerts fall silent, late alerts, and times without alerts."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.rules import Rule
from pulsegrid.streaming import states

T0 = datetime(2026, 7, 1, tzinfo=UTC)
ACTIVE = "rule_id string, fingerprint string, at timestamp, value double"


class Feed:
    """Two folders that streams read, and one that events are written to; every run takes what is new and goes on where the last one ended."""

    def __init__(self, spark, folder, rule, watermark="0 seconds"):
        self.spark, self.folder, self.rule, self.watermark = spark, folder, rule, watermark
        self.send([], [])

    def send(self, active, ticks):
        at = lambda m: T0 + timedelta(minutes=m)
        self.spark.createDataFrame([("r", f, at(m), float(v)) for f, m, v in active], ACTIVE).coalesce(1).write.mode("append").parquet(f"{self.folder}/active")
        self.spark.createDataFrame([(at(m),) for m in ticks], "at timestamp").coalesce(1).write.mode("append").parquet(f"{self.folder}/ticks")

    def run(self):
        read = lambda schema, name: self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}")
        out = states.stream_alert_states(read(ACTIVE, "active"), self.rule, "1h", self.watermark, read("at timestamp", "ticks"))
        out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
        minute = ((F.unix_seconds("at") - int(T0.timestamp())) / 60).cast("int").alias("minute")
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").select("fingerprint", minute, "status").collect())


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path), Rule("r", "R", for_="1m", interval="1m"))


def test_last_alerts_are_resolved_by_ticks_alone(feed):
    feed.send([(f, m, 1) for f in "ab" for m in (0, 1, 2)] + [("c", 2, 1)], [0, 1, 2])
    fired = [("a", 1, "firing"), ("b", 1, "firing")]
    assert feed.run() == fired
    feed.send([("b", 3, 1)], [3])
    assert feed.run() == [fired[0], ("a", 3, "resolved"), fired[1]]
    feed.send([], [4])  # no alert is left; c never fired and is forgotten
    assert feed.run() == [fired[0], ("a", 3, "resolved"), fired[1], ("b", 4, "resolved")]
    feed.send([], [5, 6])
    feed.send([("a", 7, 1), ("a", 8, 1)], [7, 8])  # back again, and its time to fire starts over
    assert ("a", 8, "firing") in feed.run()
    feed.send([], [9])
    assert feed.run() == sorted([*fired, ("a", 3, "resolved"), ("b", 4, "resolved"), ("a", 8, "firing"), ("a", 9, "resolved")])


def test_alerts_may_come_after_their_tick_within_the_watermark(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), Rule("r", "R", interval="1m"), watermark="2 minutes")
    feed.send([("a", 0, 1)], [0, 1])
    assert feed.run() == [("a", 0, "firing")]
    feed.send([("a", 1, 1)], [2])
    assert feed.run() == [("a", 0, "firing")]
    feed.send([], [3, 4, 5])
    assert feed.run() == [("a", 0, "firing"), ("a", 2, "resolved")]


def test_ticks_are_no_alerts(feed):
    feed.send([], [0, 1, 2])
    assert feed.run() == []
