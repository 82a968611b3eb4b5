"""Counters as a stream: an extension, the batch form stays the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Readings by type and hour from (ts, event_type, value); later rows than the watermark allows are left out."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")
