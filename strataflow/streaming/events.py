"""Windowed aggregates of events; the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by windows of ``size``; a stream needs ``late``, its watermark."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of events of a user without a pause of ``gap``."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str) -> DataFrame:
    """A stream without repeats of an event id inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
