"""Structured Streaming: search logs by canonical key in windows, and a vocabulary that grows with the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_counts(log: DataFrame, key: Column, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, searches, users of a log stream (ts, user_id); rows later than the watermark are dropped."""
    keyed = log.withWatermark(time, late).select(F.window(time, window).alias("w"), key.alias("key"), "user_id")
    out = keyed.groupBy("w", "key").agg(F.count(F.lit(1)).alias("searches"), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("window_start"), "key", "searches", "users")


def vocabulary_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """token, n of a stream of documents; for the complete or update output mode."""
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
