"""The streaming forms: chat sessions by event time, and indexing of what arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """room, start, end, n_messages: for batch or streaming input (room, ts). Messages exactly a gap apart belong together,
    as in the batch form. Rows without a time aren't seen."""
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp"))
    if messages.isStreaming:
        timed = timed.withWatermark("ts", late)
    window = F.session_window("ts", gap)
    out = timed.filter("ts is not null").groupBy("room", window.alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_messages"))
    return out.select("room", "start", "end", "n_messages")


def keep_first_stream(units: DataFrame, key: str = "unit_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """First of each key within the watermark; what duplicates would merge isn't kept in a stream."""
    return units.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def index_stream(units: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Calls `index` with each micro-batch and its number; equal numbers come again after a failure, so that a sink that
    overwrites by number is exact."""
    return units.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
