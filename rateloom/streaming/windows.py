"""Windowed aggregates that run alike on a table and on a stream (with a watermark there)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], value: str, delay: str = "1 hour") -> DataFrame:
    out = watermarked(df, ts, delay).groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    out = watermarked(df, ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
