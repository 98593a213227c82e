"""Structured Streaming around the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def activity(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their value by window and type; rows later than the watermark are dropped, closed windows are emitted once."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def without_repeats(logs: DataFrame, id_col: str, time_col: str, within: str = "1 hour") -> DataFrame:
    """Logs with each id once, remembered for as long as the watermark."""
    return logs.withWatermark(time_col, within).dropDuplicatesWithinWatermark([id_col])
