"""Windows over event streams, and the document build on a stream. All work on batch tables as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigraph.operators import chunking


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read in the session's time zone. On a batch table nothing changes."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total`` in tumbling or sliding windows; rows later than ``late`` are left out of a stream."""
    grouped = _timed(events, late).groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``user_id, start, end, n``: runs of a user's events with less than ``gap`` between."""
    grouped = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_chunks(documents: DataFrame, **options) -> DataFrame:
    """Chunks of arriving documents: a projection without state."""
    return chunking.chunk(documents, **options)
