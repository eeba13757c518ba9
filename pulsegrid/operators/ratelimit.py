"""Rows over a budget of requests, by agent."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bucket:
    """A token bucket: `burst` tokens at first, `rate` a second more, one for each row that passes."""

    def __init__(self, rate: float, burst: int, tokens: float | None = None, at: int | None = None):
        self.rate, self.burst = rate, max(1, burst)
        self.tokens, self.at = float(self.burst) if tokens is None else tokens, at

    def allow(self, us: int) -> bool:
        if self.at is not None:
            self.tokens = min(float(self.burst), self.tokens + max(0, us - self.at) / 1e6 * self.rate)
        self.at = us if self.at is None else max(us, self.at)
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False


def token_bucket(rows: DataFrame, rate: float, burst: int, key: str = "key", ts: str = "ts", order: str = "seq") -> DataFrame:
    """(key, order, allowed): whether each row is within its key's budget, in order of time and `order`.

    A key's rows go through one task in order, and one batch and one bucket are held at a time.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, None
        for batch in batches:
            allowed = []
            for k, us in zip(batch.column("key").to_pylist(), batch.column("us").to_pylist(), strict=True):
                if bucket is None or k != last and not (k != k and last != last):  # NaN is one key
                    last, bucket = k, Bucket(rate, burst)
                allowed.append(bucket.allow(us))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("order"), pa.array(allowed, pa.bool_())], ["key", "order", "allowed"])

    light = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.unix_micros(ts).alias("us"))
    kinds = {f.name: f.dataType.simpleString() for f in light.schema}
    ordered = light.repartition("key").sortWithinPartitions("key", "us", "order")
    out = ordered.mapInArrow(fold, f"key {kinds['key']}, order {kinds['order']}, allowed boolean")
    return out.select(F.col("key").alias(key), F.col("order").alias(order), "allowed")
