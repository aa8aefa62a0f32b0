"""Streams of reflog entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(entries: DataFrame, window: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "event_type") -> DataFrame:
    """(start, end, key, n): entries by time window and key; entries later than ``late`` behind the newest are left out."""
    counts = entries.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def expired(entries: DataFrame, cutoff: str, time: str = "ts", keep: str = "nth = 0") -> DataFrame:
    """Reflog entries that stay: newer than the cutoff, or kept by the condition (the newest entry of a ref)."""
    return entries.where((F.col(time) >= F.lit(cutoff).cast("timestamp")) | F.expr(keep))
