"""Counts of label maps over a stream: they only add up, so late and repeated batches of new pixels need no window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def occupancy_stream(labels: DataFrame) -> DataFrame:
    """sample_id, label, pixels of a streaming frame of pixels; write in complete or update mode."""
    return labels.groupBy("sample_id", "label").agg(F.count(F.lit(1)).alias("pixels"))


def flip_stream(rows: DataFrame) -> DataFrame:
    """sample_id, draw, pixels, flips of a streaming frame with label and clean_label."""
    return rows.groupBy("sample_id", "draw").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("label") != F.col("clean_label")).alias("flips"))


def events_per_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events in tumbling windows; rows later than the watermark are left out by Spark."""
    kept = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
