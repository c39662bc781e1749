"""Tables between jobs, in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table of whole numbers that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def fits(rows: int, columns: int = 1) -> bool:
    """Whether so many rows of 8-byte columns may be broadcast: a hashed row takes about 48 bytes more."""
    return rows * (48 + 8 * columns) <= BROADCAST_BYTES


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder; where none is set, one of our own in local mode (tests), and an error on a cluster, whose
    machines share no temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_worktrace_dir", None)
        if folder is None:
            folder = spark._worktrace_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/worktrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._worktrace_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by keep() that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._worktrace_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def semi_by_id(docs: DataFrame, ids: DataFrame, n_ids: int, key: str) -> DataFrame:
    """Rows of docs whose key is in ids: a broadcast behind a check of its bytes, else a shuffled join."""
    return docs.join(F.broadcast(ids) if fits(n_ids) else ids, key, "left_semi")


def pick(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id, text, ...): a stable column order whatever else the input carries."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), *more)
