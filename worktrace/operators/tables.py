"""Tables between the jobs of one query, in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on a local master (tests), and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark, "_worktrace_tables"):
        spark._worktrace_tables = "file://" + tempfile.mkdtemp(prefix="spark-")
    return spark._worktrace_tables


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/worktrace-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once and read again: what made it is not run anew for each job, nor after the loss of an executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._worktrace_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._worktrace_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
