"""Streams: event counts by window with late data, and incremental default rates of a growing panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events and their value by window and type. On a stream, windows close when the watermark has passed them."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = marked.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events by user and session, which ends after a gap."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = marked.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


def panel_rates(rows: DataFrame, late: str = "90 days") -> DataFrame:
    """Rows and defaults by month, as rows arrive: months close after the watermark."""
    marked = rows.withColumn("at", F.col("performance_date").cast("timestamp")).withWatermark("at", late)
    return marked.groupBy(F.window("at", "1 day"), "performance_date").agg(F.count(F.lit(1)).alias("n"), F.sum("default_flag").alias("defaults")).select("performance_date", "n", "defaults")
