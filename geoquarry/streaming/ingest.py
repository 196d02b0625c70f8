"""Streaming forms of ingestion: windowed counts and first-of-key within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def timed(rows: DataFrame, late: str) -> DataFrame:
    """``rows`` with a watermark on ``ts``; streams need it with a time zone, tables are left as they are."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """event_type, day, n, total over tumbling windows of ``ts``; rows later than ``late`` behind the newest are left out.

    Works on a stream and on a table alike; state is bounded by the watermark.
    """
    w = timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("w.start").alias("day"), "n", "total")


def first_of_key(features: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key that arrives within the watermark: repeats of a feature are dropped, state expires."""
    return timed(features, late).dropDuplicatesWithinWatermark([key]) if features.isStreaming else features.dropDuplicates([key])
