"""Windowed counts over a stream of events; the same plan runs on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of value per window and event type; late rows beyond ``late`` are closed out."""
    rows = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    got = rows.groupBy(F.window("time", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events no further apart than ``gap``."""
    rows = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", gap)
    got = rows.groupBy(F.session_window("time", gap), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


def read_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(folder)
