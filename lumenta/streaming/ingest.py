"""New files as a stream: the batch operators with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_copies(files: DataFrame, time_col: str, hash_col: str, delay: str = "1 day") -> DataFrame:
    """The first file of each hash that arrives within the delay; later state is dropped."""
    return files.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([hash_col])


def arrivals(files: DataFrame, time_col: str, window: str = "1 hour", delay: str = "1 day", *by: str) -> DataFrame:
    """Files and bytes by window of arrival; late files count until the watermark passes."""
    w = F.window(time_col, window)
    return files.withWatermark(time_col, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).select(
        F.col("w.start").alias("from"), F.col("w.end").alias("to"), *by, "files", "bytes"
    )
