"""All registered plans of the work-log engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.operators import discovery
from worktrace.plans import audits, comparisons, models, processes, published, sequences, streams, studies, supervised, whole_audit

MODULES = [sequences, processes, audits, models, studies, comparisons, supervised, published, streams, whole_audit]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes by recorded time, each with its main path."""
    rows = processes.rows(spark, sf_dir)
    best = discovery.variants(rows).groupBy("process_id").agg(F.max_by("signature", F.struct("frequency", "signature")).alias("main_path"))
    return discovery.profiles(rows).join(best, "process_id").orderBy(F.desc("total_ms"), "process_id")
