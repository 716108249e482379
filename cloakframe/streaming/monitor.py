"""Streams: stateless detection, windowed counts by type, and session expiry. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import Detection, detect, entities_of


def detected_stream(requests: DataFrame, how: Detection | None = None) -> DataFrame:
    """Works on batch and streaming frames alike: rows (ts, request_id, type, ...) without values."""
    return entities_of(detect(requests.select("request_id", "ts", "text"), how=how), "request_id", "ts")


def windowed_counts(events: DataFrame, by: str, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by window and `by`; on a stream, rows later than the watermark are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), by).count().select(F.col("window.start").alias("window_start"), by, F.col("count").alias("n"))


def sessions(events: DataFrame, key: str, ttl: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions with a sliding time to live: each event extends its session."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", ttl), key).count().select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires_at"), F.col("count").alias("n"))
