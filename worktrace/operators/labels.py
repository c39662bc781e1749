"""Ground-truth construction and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def executions_from_log(log: DataFrame) -> DataFrame:
    """Executions of a ground-truth log (session_id, rec_no, at_ms, event, process_code, case_id, split_id).

    Starts and resumes open an execution; a start that repeats the last start of its process directly is dropped.
    Later records of the process in the session belong to the execution opened last. It ends at its last suspend,
    else its first switch-out, else (the newest run of a process only) at the session's end; otherwise it stays open."""
    w = Window.partitionBy("session_id", "process_code").orderBy("rec_no")
    own = log.where("process_code IS NOT NULL").withColumn("prev", F.lag("event").over(w))
    opens = (F.col("event") == "process_resumed") | ((F.col("event") == "process_started") & ~F.col("prev").eqNullSafe(F.lit("process_started")))
    numbered = own.withColumn("run", F.sum(opens.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("run > 0")
    is_ = lambda e: F.col("event") == e
    grouped = numbered.groupBy("session_id", "process_code", "run").agg(
        F.min_by("case_id", "rec_no").alias("case_id"),
        F.min("at_ms").alias("start_ms"),
        F.max_by(F.when(is_("process_suspended"), F.col("at_ms")), F.when(is_("process_suspended"), F.col("rec_no"))).alias("suspended_ms"),
        F.min_by(F.when(is_("process_switched_out"), F.col("at_ms")), F.when(is_("process_switched_out"), F.col("rec_no"))).alias("switched_ms"),
    )
    ended = log.where(is_("session_ended")).groupBy("session_id").agg(F.max("at_ms").alias("session_ms"))
    newest = F.col("run") == F.max("run").over(Window.partitionBy("session_id", "process_code"))
    end = F.coalesce("suspended_ms", "switched_ms", F.when(newest, F.col("session_ms")))
    return grouped.join(ended, "session_id", "left").select("session_id", "process_code", "run", "case_id", "start_ms", end.alias("end_ms"), F.col("suspended_ms").isNotNull().alias("suspended"))


def unmatched_splits(log: DataFrame) -> DataFrame:
    """Suspends without resume and resumes without suspend, by split id."""
    side = lambda e: log.where(F.col("event") == e).select("session_id", "split_id")
    s, r = side("process_suspended"), side("process_resumed")
    keys = ["session_id", "split_id"]
    return s.join(r, keys, "left_anti").withColumn("kind", F.lit("suspend_without_resume")).unionByName(r.join(s, keys, "left_anti").withColumn("kind", F.lit("resume_without_suspend")))


def overlapping(spans: DataFrame) -> DataFrame:
    """Consecutive spans of a session that overlap."""
    w = Window.partitionBy("session_id").orderBy("start_ms", "case_id")
    return spans.withColumn("next_start", F.lead("start_ms").over(w)).where("next_start < end_ms")


def boundaries(spans: DataFrame) -> DataFrame:
    """Points between consecutive executions: at the start of the later one; a resume if that has the same process."""
    w = Window.partitionBy("session_id").orderBy("start_ms")
    prev = F.lag("process_code").over(w)
    return spans.select("session_id", F.col("start_ms").alias("at_ms"), (prev == F.col("process_code")).alias("is_resume"), prev.alias("prev_code"), F.col("process_code").alias("next_code")).where("prev_code IS NOT NULL")


def continuity(labelled: DataFrame, cases: DataFrame) -> DataFrame:
    """Continuity categories of transitions. cases: (session_id, idx, case_id) per event; label 1 = a new unit begins,
    0 = the same continues, null = left out."""
    w = Window.partitionBy("session_id").orderBy("idx")
    both = cases.select("session_id", "idx", F.col("case_id").alias("a"), F.lead("case_id").over(w).alias("b"))
    rows = labelled.join(both, ["session_id", "idx"])
    category = (
        F.when(F.col("is_boundary") & F.col("is_resume"), "resume_boundary").when(F.col("is_boundary"), "boundary").when(F.col("a").isNull() & F.col("b").isNull(), "noise").when(F.col("a").isNull() | F.col("b").isNull(), "noise_edge").when(F.col("a") == F.col("b"), "inside").otherwise("between")
    )
    out = rows.withColumn("category", category)
    return out.withColumn("label", F.when(F.col("category").isin("boundary", "resume_boundary"), 1).when(F.col("category") == "inside", 0)).select("session_id", "idx", "category", "label")


def reconciliation(labels: DataFrame) -> DataFrame:
    """Per session: labels of each kind and whether only one class is there."""
    return labels.groupBy("session_id").agg(F.count_if(F.col("label") == 1).alias("n_new"), F.count_if(F.col("label") == 0).alias("n_same"), F.count_if(F.col("label").isNull()).alias("n_excluded")).withColumn("one_class", (F.col("n_new") == 0) | (F.col("n_same") == 0))


def concurrency(spans: DataFrame) -> DataFrame:
    """Most executions alive at once per session: a sweep over starts and ends, ends first on ties."""
    points = spans.select("session_id", F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("x")).select("session_id", "x.*")
    w = Window.partitionBy("session_id").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("alive", F.sum("d").over(w)).groupBy("session_id").agg(F.max("alive").alias("max_alive"))


def reappearing(runs: DataFrame) -> DataFrame:
    """Per session: cases, and those that come back after leaving. runs: run-length rows of the known cases."""
    per = runs.where("value IS NOT NULL").groupBy("session_id", "value").agg(F.count("*").alias("n"))
    return per.groupBy("session_id").agg(F.count("*").alias("n_cases"), F.count_if(F.col("n") > 1).alias("n_returning"))
