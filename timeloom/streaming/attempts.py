"""Streams of stage events: windowed counts with a watermark, and the latest attempt of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, at: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and window; events later than the watermark are dropped by the engine."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def attempts(stream: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """Number of attempts and time of the last one for each key, kept as streaming state (output mode update or complete)."""
    return stream.groupBy(key).agg(F.count("*").alias("attempts"), F.max(at).alias("last"))
