"""Counts and sums by key over event-time windows of a stream, with a bound on late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, end, key, n and total of each window; events later than `late` behind the newest are dropped.

    Works on batches as well, where nothing is late. State is a row for each open window and key.
    """
    stamped = events.withColumn("__time", F.col(f"`{time}`").cast("timestamp")).withWatermark("__time", late)
    parts = F.window("__time", length, slide) if slide else F.window("__time", length)
    out = stamped.groupBy(parts.alias("w"), F.col(f"`{key}`").alias("key")).agg(F.count("*").alias("n"), F.sum(F.col(f"`{value}`").cast("double")).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n", "total")
