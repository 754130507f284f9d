"""Streaming jobs: hourly load with a watermark, sliding averages, and incremental chunks of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.operators.tables import level


def hourly_load(events: DataFrame, capacity: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling counts per site and hour; events later than the watermark are dropped. Append mode."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "site").agg(F.count("*").alias("visitors"))
    ratio = F.when(F.col("capacity") > 0, F.col("visitors") / F.col("capacity")).otherwise(0.0)
    return n.join(capacity, "site").select("site", F.col("window.start").alias("hour"), "visitors", F.round(ratio, 3).alias("ratio"), level(ratio).alias("level"))


def sliding_mean(events: DataFrame, hours: int = 3, step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """site, start, mean: visitors an hour over sliding windows of so many hours."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours", step), "site").agg(F.count("*").alias("n"))
    return n.select("site", F.col("window.start").alias("start"), F.round(F.col("n") / hours, 4).alias("mean"))
