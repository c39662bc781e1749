"""Automation logs: status transitions, replays, reconciliation, lifecycle and evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def illegal_transitions(log: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of a status log (execution_id, at, seq, state) whose step from the state before is not allowed. allowed is a small table."""
    w = Window.partitionBy("execution_id").orderBy("at", "seq")
    steps = log.withColumn("before", F.lag("state").over(w)).where("before IS NOT NULL")
    return steps.join(F.broadcast(allowed), ["before", "state"], "left_anti").select("execution_id", "at", "seq", "before", "state")


def final_states(log: DataFrame) -> DataFrame:
    return log.groupBy("execution_id").agg(F.max_by("state", F.struct("at", "seq")).alias("state"))


def replays(log: DataFrame, confirm: str, terminal: Sequence[str]) -> DataFrame:
    """Confirmations of executions that were already in a terminal state."""
    before = Window.partitionBy("execution_id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    done = F.max(F.col("state").isin(*terminal).cast("int")).over(before)
    return log.withColumn("done", done).where(f"state = '{confirm}' AND done = 1").drop("done")


def latest(log: DataFrame, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), F.desc("seq")))
    return log.withColumn("_r", rank).where("_r = 1").drop("_r")


def reconciled(unknown: DataFrame, record: DataFrame) -> DataFrame:
    """Unknown executions against the system of record: confirmed, failed or still unknown."""
    kind = F.when(F.col("ok").isNull(), "still_unknown").when(F.col("ok"), "confirmed").otherwise("failed")
    return unknown.join(record, "execution_id", "left").select("execution_id", kind.alias("resolution"))


def lifecycle(log: DataFrame) -> DataFrame:
    """Per state at the end: executions, upper-median and largest duration."""
    per = log.groupBy("execution_id").agg((F.max("at") - F.min("at")).alias("ms"), F.max_by("state", F.struct("at", "seq")).alias("state"))
    w = Window.partitionBy("state")
    placed = per.withColumns({"_r": F.row_number().over(w.orderBy("ms", "execution_id")) - 1, "_n": F.count("*").over(w)})
    return placed.groupBy("state").agg(F.count("*").alias("n"), F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2), F.col("ms"))).alias("p50"), F.max("ms").alias("longest"))


def taxonomy(errors: DataFrame, codes: Mapping[str, str], default: str) -> DataFrame:
    out = F.lit(default)
    for code, name in codes.items():
        out = F.when(F.col("error") == code, name).otherwise(out)
    return errors.groupBy(out.alias("failure")).agg(F.count("*").alias("n"))


def evidence(checks: DataFrame) -> DataFrame:
    """passed: at least one check and all pass; conclusive: none unavailable."""
    return checks.groupBy("execution_id").agg(F.bool_and(F.col("result") == "PASS").alias("passed"), F.bool_and(F.col("result") != "UNAVAILABLE").alias("conclusive"), F.count("*").alias("n_checks"))
