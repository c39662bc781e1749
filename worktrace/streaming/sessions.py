"""Streams of events: deduplication, gap sessions and quality counters. Each takes and returns a streaming (or batch)
DataFrame. A stream is watermarked once, at its source; the operators after it share that watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, at: str, late: str) -> DataFrame:
    return events.withWatermark(at, late)


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event id once; state is dropped once the watermark has passed."""
    return events.dropDuplicatesWithinWatermark([key])


def gap_segments(events: DataFrame, at: str, gap: str) -> DataFrame:
    """Segments of a session that end when nothing comes for ``gap``; rows behind the watermark are left out."""
    windowed = events.groupBy("session_id", F.session_window(at, gap).alias("w"))
    return windowed.agg(F.count("*").alias("n_events"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).select("session_id", "n_events", "first_at", "last_at")


def quality_counters(events: DataFrame, at: str, width: str) -> DataFrame:
    """Per tumbling window: events, events without application, domain coverage."""
    return (
        events.groupBy(F.window(at, width).alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("application").isNull()).alias("no_app"), F.avg(F.col("browser_domain").isNotNull().cast("double")).alias("coverage"))
        .select(F.col("w.start").alias("start"), "n", "no_app", "coverage")
    )
