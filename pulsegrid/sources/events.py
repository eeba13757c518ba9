"""Samples derived from the standard tables.

A sample is (name, type, value, ts, labels). Events become gauges named by their type,
labelled by agent, shard and tenant; a running sum per series, set back to zero at
every twentieth point, makes counters. Orders become a second shape of gauges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.labels import series_key

RESET_EVERY = 20


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges: one sample for each event."""
    user = F.col("user_id")
    labels = F.create_map(
        F.lit("agent_id"), F.concat(F.lit("agent-"), user % 8), F.lit("shard"), F.concat(F.lit("s"), user % 3), F.lit("tenant"), F.concat(F.lit("t"), user % 2)
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("name"), F.lit("gauge").alias("type"), "value", F.col("ts").cast("timestamp").alias("ts"), labels.alias("labels"), "event_id")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters: running sums of each series, starting again at every RESET_EVERY-th point."""
    rows = samples(spark, sf_dir).withColumn("series", series_key(F.col("name"), F.col("labels")))
    order = Window.partitionBy("series").orderBy("ts", "event_id")
    rows = rows.withColumn("life", F.floor((F.row_number().over(order) - 1) / RESET_EVERY))
    running = F.sum("value").over(Window.partitionBy("series", "life").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("name", F.lit("counter").alias("type"), running.alias("value"), "ts", "labels", "event_id")


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges named order_total, labelled by priority and status."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    labels = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus")
    return orders.select(
        F.lit("order_total").alias("name"), F.lit("gauge").alias("type"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderdate").cast("timestamp").alias("ts"), labels.alias("labels"), F.col("o_orderkey").alias("event_id")
    )
