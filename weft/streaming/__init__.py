"""Streams of graph changes and events: windowed counts, change feeds, incremental counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) per tumbling window; ``late`` sets the watermark of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, session_start, n) per session window."""
    if late:
        events = events.withWatermark("ts", late)
    s = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def change_feed(changes: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str, once: bool = True):
    """Run the handlers, in order, on every batch of changes (ts, event, name, tail, head)."""

    def each(batch: DataFrame, number: int) -> None:
        for h in handlers:
            h(batch, number)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
