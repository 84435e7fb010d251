"""Incremental aggregates and promotion sessions over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, width: str = "1 day", late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """n and total per window and key; on a stream the watermark bounds the state."""
    w = F.window("ts", width)
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Runs of a key's events that are less than gap apart."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
