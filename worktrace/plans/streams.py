"""Plans that run as streams: the events are written as chunks of JSON lines in several waves, with repeats and broken lines,
read as a file stream, and what the stream wrote is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace import fixtures as fx
from worktrace.functions import scalar
from worktrace.operators.tables import dropped, new_folder, written
from worktrace.plans import sequences as base
from worktrace.plans.oracle import sql
from worktrace.streaming import cuts, ingest, sessions

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Waves in which the chunks come, files of a wave at least, and lines of a file about.
WAVES, FILES, LINES = 4, 4, 100_000
DAY = 86_400_000


def plan(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle)
        return f

    return add


def feed(s: SparkSession, d: str) -> tuple[str, str, int]:
    """(folder of the chunks, how late a row may be, files of a wave). Every fifth event comes twice, every eleventh once more, cut short. Rows of a
    wave are mixed; waves follow each other in time. A last line without a session, far ahead in time, moves the watermark over all others."""
    rows = base.canon(s, d)
    text = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("event_id"),
            "session_id",
            "timestamp_ms",
            "event_type",
            F.struct(F.struct(F.col("application").alias("app_name"), "window_title").alias("active_app"), F.struct(F.col("browser_url").alias("url")).alias("active_browser_tab")).alias("context"),
            F.struct(F.col("event_id").cast("long").alias("sequence_number"), "chunk_id").alias("correlation"),
        )
    )
    copies = F.expr("filter(array(0, CASE WHEN event_id % 5 = 0 THEN 1 END, CASE WHEN event_id % 11 = 0 THEN 2 END), x -> x IS NOT NULL)")
    sent = rows.select("event_id", "timestamp_ms", F.explode(copies).alias("copy"), text.alias("raw")).withColumn("raw", F.expr("CASE WHEN copy = 2 THEN substring(raw, 1, 40) ELSE raw END"))
    sent = written(sent, "sent")
    low, high, n = sent.agg(F.min("timestamp_ms"), F.max("timestamp_ms"), F.count("*")).first()
    files = max(FILES, -(-n // (WAVES * LINES)))
    width = (((high or 0) - (low or 0)) // WAVES) + 1
    root = new_folder(s, "chunks")
    for wave in range(WAVES):
        part = sent.where((F.col("timestamp_ms") >= (low or 0) + wave * width) & (F.col("timestamp_ms") < (low or 0) + (wave + 1) * width))
        part.repartition(files, "event_id", "copy").select("raw").write.mode("append").text(root)
    s.createDataFrame([(f'{{"timestamp_ms": {(high or 0) + 10 * width + 10 * DAY}}}',)], "raw string").write.mode("append").text(root)
    dropped(sent)
    return root, f"{width + DAY} milliseconds", files


def _events(s: SparkSession, d: str) -> DataFrame:
    root, late, files = feed(s, d)
    return ingest.events(ingest.lines(s, root, files), late)


BRONZE = "SELECT event_id, session_id, timestamp_ms, chunk_id, application, browser_url, n.n_lines + 1 AS n_lines, n.n_bad, 0 AS n_late FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, session_id, timestamp_ms, chunk_id, application, browser_url FROM canon), (SELECT count(*) + count(*) FILTER (event_id % 5 = 0) + count(*) FILTER (event_id % 11 = 0) AS n_lines, count(*) FILTER (event_id % 11 = 0) AS n_bad FROM canon) n"


@plan("x01_stream_ingest", BRONZE)
def _(s, d):
    """The bronze table of the chunks, and what the stream counted."""
    bronze, n = ingest.run(_events(s, d), "bronze")
    counts = [F.lit(v).cast("long").alias(k) for k, v in (("n_lines", n.n_lines), ("n_bad", n.n_bad), ("n_late", n.n_late))]
    return bronze.where("session_id IS NOT NULL").select("event_id", "session_id", "timestamp_ms", "chunk_id", "application", "browser_url", *counts)


@plan("x02_stream_segments", "SELECT session_id, count(*) AS n_events, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY session_id ORDER BY idx) AS g FROM (SELECT *, coalesce(timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY idx) > 86400000, false) AS new FROM canon)) GROUP BY session_id, g")
def _(s, d):
    found, _ = ingest.run(sessions.gap_segments(_events(s, d), "at", "24 hours"), "segments")
    return found.where("session_id IS NOT NULL").select("session_id", "n_events", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("last_at").alias("last_ms"))


@plan("x03_stream_cuts", "SELECT * FROM cut0")
def _(s, d):
    system = scalar.system_identity(F.col("application"), F.col("window_title"), scalar.netloc(F.col("browser_url")), fx.NOISE_APPS, fx.MARKERS, fx.NOISE_TITLES)
    found, _ = ingest.run(cuts.system_cuts(_events(s, d).withColumn("system", system)), "cuts")
    return found


@plan("x04_stream_counters", "SELECT (timestamp_ms // 86400000) * 86400000 AS start_ms, count(*) AS n, count(*) FILTER (application IS NULL) AS no_app, round(avg(CAST(browser_domain IS NOT NULL AS INTEGER)), 9) AS coverage FROM canon GROUP BY 1")
def _(s, d):
    rows = _events(s, d).withColumn("browser_domain", scalar.netloc(F.col("browser_url")))
    found, _ = ingest.run(sessions.quality_counters(rows, "at", "1 day"), "counters")
    return found.select(F.unix_millis("start").alias("start_ms"), "n", "no_app", F.round("coverage", 9).alias("coverage"))
