"""Event-time windows that read the same over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, by: str, window: Column, watermark: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """by, window_start, window_end, n, total. On a stream, rows later than the watermark are left out."""
    if watermark and events.isStreaming:
        events = events.withWatermark(ts, watermark)
    out = events.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")


def tumbling(events: DataFrame, by: str, size: str, watermark: str | None = None) -> DataFrame:
    return windowed(events, by, F.window("ts", size), watermark)


def sliding(events: DataFrame, by: str, size: str, slide: str, watermark: str | None = None) -> DataFrame:
    return windowed(events, by, F.window("ts", size, slide), watermark)


def sessions(events: DataFrame, by: str, gap: str, watermark: str | None = None) -> DataFrame:
    return windowed(events, by, F.session_window("ts", gap), watermark)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is final to a table, once each, and stop when the source is read."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
