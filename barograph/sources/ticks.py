"""Tick views of the ``events`` table, the only time series among the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.functions.timeframes import HOUR
from barograph.operators.ordered import scan

TICKS = "symbol string, seq long, ms long, bid double, ask double"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def ticks_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each event type; the event's value is the bid."""
    ask = F.col("value") + (F.col("event_id") % 7 + 1) / F.lit(100.0)
    return _events(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), "ms", F.col("value").alias("bid"), ask.alias("ask"))


def ticks_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol whose bid walks by whole cents; the running sum is made by blocks of an hour."""
    step = F.round(F.col("value") * 100).cast("long") % 41 - 20
    walked = scan(_events(spark, sf_dir).select("ms", "ts", "event_id", step.alias("step")), [], ["ms", "ts", "event_id"], HOUR, {"walk": ("sum", F.col("step"), True)}, levels=1)
    bid = (F.lit(100_000) + F.col("walk")) / F.lit(100.0)
    spread = (F.col("event_id") % 7 + 1) / F.lit(100.0)
    return walked.select(F.lit("WALK").alias("symbol"), F.col("event_id").alias("seq"), "ms", bid.alias("bid"), (bid + spread).alias("ask"))
