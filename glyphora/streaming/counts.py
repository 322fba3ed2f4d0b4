"""Counts kept up to date from a stream of changes, as the batch views compute them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(changes: DataFrame, keys: list[str]) -> DataFrame:
    """changes (keys, action insert or delete; update counts as neither) -> keys, count. Batch or stream (output mode update or complete)."""
    weight = F.when(F.col("action") == "insert", 1).when(F.col("action") == "delete", -1).otherwise(0)
    return changes.groupBy(*keys).agg(F.sum(weight).alias("count"))


def counted_by_time(changes: DataFrame, keys: list[str], time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """keys, window, count of changes per span of time; rows later than `late` are left out, so state stays bounded."""
    return changes.withWatermark(time, late).groupBy(*keys, F.window(time, width)).agg(F.count("*").alias("count"))
