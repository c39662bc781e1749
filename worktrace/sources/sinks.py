"""Rows in the shape of the delivered files, and their writers."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.functions.scalar import iso_utc


def segment_rows(executions: DataFrame, label: str) -> DataFrame:
    """(session_id, start, end, label): ISO times in UTC; a segment without length ends one ms later."""
    end = F.when(F.col("start_ms") >= F.col("end_ms"), F.col("start_ms") + 1).otherwise(F.col("end_ms"))
    return executions.select("session_id", iso_utc(F.col("start_ms")).alias("start"), iso_utc(end).alias("end"), F.col(label).alias("label"))


def write_segments(executions: DataFrame, label: str, path: str) -> None:
    """JSON lines, in ranges of (session, start)."""
    segment_rows(executions, label).repartitionByRange("session_id", "start").sortWithinPartitions("session_id", "start").write.json(path)


def write_transitions(transitions: DataFrame, path: str, buckets: int) -> None:
    """Parquet, partitioned by a bucket of the session, so that a session lies in one folder."""
    transitions.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").parquet(path)


def write_executions_csv(executions: DataFrame, path: str) -> None:
    """Ground-truth executions as CSV with a header, in ranges of (session, start): ISO times, applications joined by a bar."""
    start, end = (iso_utc(F.col(c)) for c in ("start_ms", "end_ms"))
    apps = F.when(F.size("apps") > 0, F.concat_ws("|", "apps"))
    rows = executions.select("session_id", "case_id", "process_code", start.alias("start"), end.alias("end"), F.col("n_events").alias("n"), apps.alias("apps"))
    rows.repartitionByRange("session_id", "start").sortWithinPartitions("session_id", "start").write.option("header", True).csv(path)


def _own_files(folder: str, run: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Writes (session_id, line), sorted by session, into a file a session. A task that runs again writes the same files again."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last, out, n = TaskContext.get().partitionId(), object(), None, 0
        for batch in batches:
            for session, line in zip(batch.session_id, batch.line, strict=True):
                if session != last:
                    if out:
                        out.close()
                    # as Spark names the folders of a partition
                    name = re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", session) if session else "__HIVE_DEFAULT_PARTITION__"
                    os.makedirs(f"{folder}/session_id={name}", exist_ok=True)
                    out, last, n = open(f"{folder}/session_id={name}/part-{part:05d}-{run}.json", "w", encoding="utf-8", newline="\n"), session, n + 1  # noqa: SIM115
                out.write(line + "\n")
        if out:
            out.close()
        yield pd.DataFrame({"n": [n]})

    return put


def write_views(rows: DataFrame, path: str, order: list[str]) -> None:
    """One JSON file a session, in a folder of its name, in the given order. Tasks put their files in place themselves: there are as many as sessions,
    too many for the driver to move one by one. The number of tasks is given, as few bytes in many files would else be put together into few tasks.
    In a file system that the machines mount, tasks open the files themselves: Hadoop's commit starts processes for the rights of each file, folder and checksum."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(tasks, "session_id").sortWithinPartitions("session_id", *order)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getUri().getScheme() == "file":
        folder = files.makeQualified(target).toUri().getPath()
        os.makedirs(folder)
        line = F.to_json(F.struct(*(c for c in rows.columns if c != "session_id")))
        placed.select(F.nullif("session_id", F.lit("")).alias("session_id"), line.alias("line")).mapInPandas(_own_files(folder, uuid.uuid4().hex), "n long").agg(F.sum("n")).collect()
        return
    placed.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("session_id").json(path)
