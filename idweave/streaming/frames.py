"""Frames as a stream: the batch gate on every micro-batch, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idweave.sources.captures import checked


def gated(frames: DataFrame) -> DataFrame:
    """path, length, reason of a stream or table of captures; the same plan serves both."""
    return checked(frames).select("path", "length", "reason")


def drained(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Run the stream over all that is there and stop; with its checkpoint a second run adds only what is new."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


def counts_by_window(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type) a window and type; rows later than ``late`` are dropped on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
