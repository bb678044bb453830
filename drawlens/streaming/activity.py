"""Incremental activity counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, delay: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Rows and value by user and window; windows close when the watermark passes them."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    out = e.groupBy(F.window("at", size).alias("w"), "user_id").agg(F.count("*").alias("rows"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "rows", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Rows by user and session, a session ending after a gap."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    out = e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("rows"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "rows")
