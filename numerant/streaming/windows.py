"""Time windows over events; each works on a stream and on a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def tumbling_totals(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n and total of each window."""
    grouped = _timed(events, late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_totals(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """user_id, start, n and total of each session: events less than ``gap`` apart."""
    grouped = _timed(events, late).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key: in a stream within the watermark, in a table by event_id."""
    if events.isStreaming:
        return _timed(events, late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), "event_id").alias("_row")).select(*keys, "_row.*")
