"""Sentiment by session from a stream of mentions: late rows change their window until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """events: ts timestamp, event_type, value. Works on a stream and on a table alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
