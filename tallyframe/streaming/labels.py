"""The per-row operators on streams, and label counts by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_counts(events: DataFrame, label: Column, at: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """start, label, row_count by window; rows later than `late` are left out of streams. Works on tables as well."""
    rows = events.select(F.col(at).cast("timestamp").alias("at"), label.alias("label"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "label").agg(F.count("*").alias("row_count")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "label", "row_count")


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Rows of a key with no longer gap between them: start, end and count."""
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark(at, gap)
    return events.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("row_count")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "row_count")
