"""Boundary detectors and reconstruction rules: each adds one boolean column to transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrace.functions import scalar
from worktrace.operators.sequence import fill_forward, ordered, return_patterns, runs, with_runs



def any_change() -> Column:
    return F.expr("application_changed OR window_title_changed OR browser_domain_changed OR interaction_category_changed")


def context() -> Column:
    return F.expr("application_changed OR browser_domain_changed")


def pause(tau: int) -> Column:
    return F.col("delta_t_ms") > tau


def pause_and_change(tau: int) -> Column:
    return pause(tau) & any_change()


def pause_or_change(tau: int) -> Column:
    return pause(tau) | any_change()


def gap_at_least(tau: int) -> Column:
    return F.col("delta_t_ms") >= tau


def two_thresholds(small: int | Column, large: int) -> Column:
    return (context() & (F.col("delta_t_ms") > small)) | (F.col("delta_t_ms") > large)


def with_veto(rule: Column, jaccard: Column, veto: float) -> Column:
    """A missing Jaccard keeps the cut."""
    return rule & ~F.coalesce(jaccard >= veto, F.lit(False))


def coverage_aware(small: int, small_degraded: int, large: int, coverage: Column, floor: float) -> Column:
    return two_thresholds(F.when(coverage < floor, small_degraded).otherwise(small), large)


def system_change(events: DataFrame) -> DataFrame:
    """Cuts where the filled-forward system changes: (session_id, idx, boundary) per transition."""
    filled = fill_forward(events, "system", "filled")
    after = F.lead("filled").over(ordered())
    return filled.select("session_id", "idx", scalar.system_changed(F.col("filled"), after).alias("boundary"), F.lead("idx").over(ordered()).alias("n")).where("n IS NOT NULL").drop("n")


def debounced_change(events: DataFrame, k: int) -> DataFrame:
    """A system change counts only if the new system lasts k events."""
    filled = with_runs(fill_forward(events, "system", "filled"), F.col("filled"))
    length = filled.groupBy("session_id", "run_no").agg(F.count("*").alias("length"))
    w = ordered()
    cols = filled.join(length, ["session_id", "run_no"]).select("session_id", "idx", "filled", F.lead("filled").over(w).alias("after"), F.lead("length").over(w).alias("lasts"))
    return cols.where("lasts IS NOT NULL").select("session_id", "idx", (scalar.system_changed(F.col("filled"), F.col("after")) & (F.col("lasts") >= k)).alias("boundary"))


def merge_leave_and_return(events: DataFrame, cuts: DataFrame, k: int) -> DataFrame:
    """Without both edges of each immediate leave-and-return of at most k events. All patterns are found on the runs as they
    are, at once; the leading events without a system take no part."""
    known = fill_forward(events, "system", "filled").where("filled IS NOT NULL")
    short = return_patterns(runs(known, "filled")).where(f"is_immediate AND away_events <= {k}")
    edges = short.select("session_id", F.explode(F.array("left_end_idx", F.col("return_start_idx") - 1)).alias("idx")).distinct().withColumn("merged", F.lit(True))
    return cuts.join(edges, ["session_id", "idx"], "left").select("session_id", "idx", (F.col("boundary") & F.col("merged").isNull()).alias("boundary"))


def frequent_hops(transitions: DataFrame, events: DataFrame, least: int) -> DataFrame:
    """Application hops (application, next_application) seen at least so often in the other sessions: per session, by the
    total less the session's own count."""
    w = ordered()
    hops = events.select("session_id", "application", F.lead("application").over(w).alias("next_application")).where("application <> next_application")
    own = hops.groupBy("session_id", "application", "next_application").agg(F.count("*").alias("own"))
    total = own.groupBy("application", "next_application").agg(F.sum("own").alias("total"))
    return own.join(total, ["application", "next_application"]).where(F.col("total") - F.col("own") >= least).select("session_id", "application", "next_application")


def with_motif(transitions: DataFrame, events: DataFrame, small: int, large: int, least: int) -> DataFrame:
    """Two-threshold rule where hops frequent elsewhere are no context change on their own."""
    w = ordered()
    hop = events.select("session_id", "idx", "application", F.lead("application").over(w).alias("next_application"))
    usual = frequent_hops(transitions, events, least).withColumn("usual", F.lit(True))
    marked = transitions.join(hop, ["session_id", "idx"]).join(usual, ["session_id", "application", "next_application"], "left")
    change = (F.col("application_changed") & F.col("usual").isNull()) | F.col("browser_domain_changed")
    return marked.select("session_id", "idx", ((change & (F.col("delta_t_ms") > small)) | (F.col("delta_t_ms") > large)).alias("boundary"))


CHUNK_NOISE, RETURN, CLUSTER, CONTINUITY, PROTECTED, NONE = "rule_1_chunk_noise", "rule_2_return_pattern", "rule_3_cluster", "rule_4_continuity", "rule_4_protected", "none"


def reconstruct(rows: DataFrame, threshold: float) -> DataFrame:
    """Ordered rules over candidate, chunk_boundary, duplicate_noise, return_demoted, cluster_size and jaccard: adds final and
    rule. Cuts are only ever removed; a missing Jaccard keeps one."""
    noise = F.col("chunk_boundary") | F.col("duplicate_noise")
    rule = F.when(~F.col("candidate"), NONE).when(noise, CHUNK_NOISE).when(F.col("return_demoted"), RETURN).when(F.col("cluster_size") >= 2, CLUSTER).otherwise(CONTINUITY)
    final = F.when(F.col("rule") == CLUSTER, True).when(F.col("rule") == CONTINUITY, F.coalesce(F.col("jaccard") < threshold, F.lit(True))).otherwise(False)
    return rows.withColumn("rule", rule).withColumn("final", final)


def reconstruct_simple(rows: DataFrame, threshold: float) -> DataFrame:
    """Ablation: chunk and noise override, then continuity for all."""
    rule = F.when(~F.col("candidate"), NONE).when(F.col("chunk_boundary") | F.col("duplicate_noise"), CHUNK_NOISE).otherwise(CONTINUITY)
    return rows.withColumn("rule", rule).withColumn("final", F.when(F.col("rule") == CONTINUITY, F.coalesce(F.col("jaccard") < threshold, F.lit(True))).otherwise(False))


def protect(rows: DataFrame, strategy: str, tempo: Column, threshold: float, agreed: Column) -> DataFrame:
    """Restores cuts that the continuity rule removed, by agreement, tempo or both."""
    fast = F.coalesce(tempo >= threshold, F.lit(False))
    wanted = {"agreement": agreed, "tempo": fast, "combined": agreed & fast}[strategy]
    back = (F.col("rule") == CONTINUITY) & ~F.col("final") & wanted
    return rows.withColumns({"rule": F.when(back, PROTECTED).otherwise(F.col("rule")), "final": F.col("final") | back})


def demote_coherent(rows: DataFrame, signal: Column, threshold: float) -> DataFrame:
    """Removes kept cuts whose segments look alike."""
    return rows.withColumn("final", F.col("final") & ~F.coalesce(signal >= threshold, F.lit(False)))


def sampling_points(spans: DataFrame, min_events: int, per_kind: int, seed: str) -> DataFrame:
    """Review population: midpoints of gaps between executions and of long executions, per_kind of each by md5 of the point id."""
    w = ordered("session_id", by="start_ms")
    nxt = F.lead("start_ms").over(w)
    gaps = spans.select(F.concat_ws("|", F.lit("boundary"), "session_id", "case_id").alias("point_id"), F.lit("boundary").alias("kind"), "session_id", F.floor((F.col("end_ms") + nxt) / 2).alias("at_ms")).where("at_ms IS NOT NULL")
    mids = spans.where(F.col("n_events") >= min_events).select(F.concat_ws("|", F.lit("control"), "session_id", "case_id").alias("point_id"), F.lit("control").alias("kind"), "session_id", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("at_ms"))
    rank = F.row_number().over(ordered("kind", by="_h"))
    return gaps.unionByName(mids).withColumn("_h", F.md5(F.concat("point_id", F.lit(seed)))).withColumn("_r", rank).where(F.col("_r") <= per_kind).drop("_h", "_r")


def debounced_counts(events: DataFrame, lasting: Sequence[int]) -> DataFrame:
    """Cuts of ``debounced_change`` for each number of events that a new identity must last: (k, n_cuts)."""
    out = None
    for k in lasting:
        part = debounced_change(events, k).agg(F.count_if("boundary").alias("n_cuts")).select(F.lit(k).alias("k"), "n_cuts")
        out = part if out is None else out.unionAll(part)
    return out


def motifs(events: DataFrame, least: int) -> DataFrame:
    """For each session the application hops (a, b) of its own that the other sessions make at least so often: total less own."""
    w = Window.partitionBy("session_id").orderBy("idx")
    hops = events.select("session_id", F.col("application").alias("a"), F.lead("application").over(w).alias("b")).where("a <> b")
    own = hops.groupBy("session_id", "a", "b").agg(F.count("*").alias("own"))
    total = own.groupBy("a", "b").agg(F.sum("own").alias("total"))
    return own.join(total, ["a", "b"]).select("session_id", "a", "b", (F.col("total") - F.col("own")).alias("n_elsewhere")).where(F.col("n_elsewhere") >= least)
