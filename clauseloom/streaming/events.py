"""Event-time aggregations that work on a table and on a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums of each event type by window; on a stream, events later than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events of a user until a pause of ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"))
