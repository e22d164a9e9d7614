"""Streaming forms (extensions): windows over event time with a watermark, and continuous reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, size: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(F.col(time).cast("timestamp"), size), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    return events.groupBy(F.session_window(F.col(time).cast("timestamp"), gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late)


def each_batch(listing: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``handle`` (such as a reconciliation) on what arrives."""
    return listing.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
