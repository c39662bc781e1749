"""Chunks as a stream of JSON lines: typed events without repeats, and what was counted on the way."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from worktrace.operators.tables import new_folder
from worktrace.sources import logs
from worktrace.streaming import sessions


def lines(spark: SparkSession, root: str, files: int) -> DataFrame:
    """Lines of the files below root, oldest file first, so many files a micro-batch."""
    return spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).text(root).select(F.col("value").alias("raw"))


def events(raw: DataFrame, late: str) -> DataFrame:
    """Typed events of lines (raw), each once, watermarked by ``at``.

    Blank lines go. Malformed lines, and records without a time, are counted as n_bad of n_lines in the observed metrics
    "lines" and go. A repeat has the same event id, or the same line where there is none; it is found as long as it is no later
    than ``late`` behind the newest event. Later rows are dropped and counted by the stream (see Counts).
    """
    parsed = raw.where(F.trim("raw") != "").withColumn("v", F.try_parse_json("raw")).withColumn("chunk_dir", F.lit(None).cast("string"))
    timed = F.try_variant_get("v", "$.timestamp_ms", "long").isNotNull()
    counted = parsed.observe("lines", F.count("*").alias("n_lines"), F.count_if(~F.coalesce(timed, F.lit(False))).alias("n_bad"))
    good = counted.where(timed)
    flat = logs.typed(good.withColumn("line", F.sha2("raw", 256)), "line").withColumn("at", F.timestamp_millis("timestamp_ms"))
    once = flat.withColumn("once", F.coalesce(F.concat(F.lit("id:"), "event_id"), F.concat(F.lit("line:"), "line")))
    return sessions.deduplicated(sessions.watermarked(once, "at", late), "once").drop("once", "line")


@dataclass
class Counts:
    n_lines: int = 0
    n_bad: int = 0
    n_late: int = 0


class _Counting(StreamingQueryListener):
    """Sums over all progress, by run; recentProgress forgets the oldest."""

    def __init__(self):
        self.seen, self.ended = {}, {}

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p, seen = event.progress, event.progress.observedMetrics.get("lines")
        counts = self.seen.setdefault(str(p.runId), Counts())
        if seen is not None:
            counts.n_lines += seen["n_lines"]
            counts.n_bad += seen["n_bad"]
        counts.n_late += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryTerminated(self, event):
        self.ended.setdefault(str(event.runId), threading.Event()).set()


def run(stream: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, Counts]:
    """Everything that is there now, appended to a Parquet table (a new one in the shared folder unless given), and the counts of
    this run. The checkpoint lies beside the table, so that a later run with the same path goes on where this one ended."""
    spark = stream.sparkSession
    path = path or new_folder(spark, name)
    listener = _Counting()
    spark.streams.addListener(listener)
    # state with timers and lists needs this store; it is the setting of a query's start
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
        query.awaitTermination()
        name = str(query.runId)
        listener.ended.setdefault(name, threading.Event()).wait(60)  # events come by another thread, the last one last
    finally:
        spark.conf.set(key, before)
        spark.streams.removeListener(listener)
    return spark.read.schema(stream.schema).parquet(path), listener.seen.get(name, Counts())
