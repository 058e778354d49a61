"""Aggregations of streams (also right for batches): our own additions, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(stream: DataFrame, value: str, ts: str, every: str = "1 hour", late: str = "2 hours", keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean and extremes of each time window; rows later than `late` are dropped by the watermark."""
    win = F.window(ts, every).alias("w")
    agg = stream.withWatermark(ts, late).groupBy(win, *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "low", "high")


def sessions(stream: DataFrame, ts: str, gap: str, keys: tuple[str, ...], late: str = "2 hours") -> DataFrame:
    """Episodes of rows that are no more than gap apart."""
    win = F.session_window(ts, gap).alias("w")
    return stream.withWatermark(ts, late).groupBy(win, *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
