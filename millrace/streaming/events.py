"""Streams of events, beyond the batch queries: windowed counts with late data, sessions, running sequence numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def once_each(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Repeated deliveries dropped while they can still come."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def weekly_counts(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts a Monday week and key; a week closes once the watermark has passed it."""
    week = F.window(ts, "7 days", startTime="4 days")  # the epoch was a Thursday
    return events.withWatermark(ts, late).groupBy(week, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), *keys, "n")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))
    return s.select(user, F.col("session_window.start").alias("start"), ((F.unix_micros("session_window.end") - F.unix_micros("session_window.start")) / 60e6).alias("minutes"), "n")
