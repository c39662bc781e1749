"""Adapters: work-log tables derived from the TPC-like driver tables.

A session is a user, a chunk a day; applications, titles, domains and routes come from the number in ``props``, with
nulls on purpose. Ground truth are the runs of events that end in a purchase; every fifth run is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktrace.functions import scalar

CATEGORIES = {"view": "navigation", "signup": "input", "click": "pointer", "purchase": "clipboard", "error": "ui_state"}
NOISE_APPS = ("app3",)
MARKERS = ("Doc_5",)
NOISE_TITLES = ("Doc_6 - Word",)
SUFFIXES = {"app0": r"\s*-\s*Word$", "app1": r"\s*-\s*Word$"}
MANUAL = ("input", "pointer", "clipboard")

HOUR = 3_600_000


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        "event_type",
        "value",
        k.alias("k"),
        "user_id",
        F.date_format("ts", "yyyy-MM-dd").alias("chunk_id"),
    )


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with their index in the session and their system identity."""
    k = F.col("k")
    text = lambda c: c.cast("string")
    domain = F.concat(F.lit("127.0.0.1:"), text(5130 + k % 3))
    out = raw_events(spark, sf_dir).select(
        "session_id",
        "event_id",
        "timestamp_ms",
        "event_type",
        scalar.interaction_category(F.col("event_type"), CATEGORIES).alias("interaction_category"),
        F.when(k % 10 != 9, F.concat(F.lit("app"), text(k % 4))).alias("application"),
        F.when(k % 7 != 0, F.concat(F.lit("Doc_"), text(k % 7), F.lit(" - Word"))).alias("window_title"),
        F.when(k % 2 == 0, domain).alias("browser_domain"),
        F.when(k % 2 == 0, F.concat(F.lit("http://"), domain, F.lit("/#/r"), text(k % 6))).alias("browser_url"),
        (F.col("value") > 100).alias("has_extracted_text"),
        "chunk_id",
        F.concat(F.lit("op"), text(F.col("user_id") % 4)).alias("operator"),
        (F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp_ms", "event_id")) - 1).cast("long").alias("idx"),
    )
    return out.withColumn("system", scalar.system_identity(F.col("application"), F.col("window_title"), F.col("browser_domain"), NOISE_APPS, MARKERS, NOISE_TITLES))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, case_id, process_code, start_ms, end_ms)."""
    before = Window.partitionBy("session_id").orderBy("timestamp_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum((F.col("event_type") == "purchase").cast("long")).over(before), F.lit(0))
    runs = raw_events(spark, sf_dir).withColumn("grp", run).where("grp % 5 <> 4")
    return runs.groupBy("session_id", "grp").agg(F.max("k").alias("k"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms")).select(
        "session_id",
        F.concat("session_id", F.lit("-c"), F.col("grp").cast("string")).alias("case_id"),
        F.concat(F.lit("P"), (F.col("k") % 15).cast("string")).alias("process_code"),
        "start_ms",
        "end_ms",
    )
