"""Windowed aggregation of the event stream; the same plan serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tumbling(events: DataFrame, size: str) -> DataFrame:
    got = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def late_safe(events: DataFrame, size: str, lateness: str) -> DataFrame:
    """Windows close once the watermark has passed them; later events are left out."""
    return tumbling(events.withWatermark("ts", lateness), size)


def sessions(events: DataFrame, gap: str) -> DataFrame:
    got = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
