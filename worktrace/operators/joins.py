"""Interval, as-of and nearest joins with the session as equi key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrace.operators.sequence import ordered


def boundary_labels(transitions: DataFrame, points: DataFrame) -> DataFrame:
    """Transitions with is_boundary and is_resume: whether a point (session_id, at_ms, is_resume) has t <= at < t_next.

    The latest point up to each transition's end, by a sort of the union, decides; nothing is multiplied."""
    t = transitions.select("session_id", "idx", F.col("next_timestamp_ms").alias("t"), F.lit(0).alias("kind"), "timestamp_ms", F.lit(None).cast("long").alias("at_ms"), F.lit(None).cast("boolean").alias("is_resume"))
    p = points.select("session_id", F.lit(None).cast("long").alias("idx"), F.col("at_ms").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("timestamp_ms"), "at_ms", "is_resume")
    # transitions come before points of their end time, so only points before it are seen
    w = Window.partitionBy("session_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = t.unionByName(p).withColumn("last", F.last(F.when(F.col("kind") == 1, F.struct("at_ms", "is_resume")), ignorenulls=True).over(w)).where("kind = 0")
    hit = F.coalesce(F.col("last.at_ms") >= F.col("timestamp_ms"), F.lit(False))
    return transitions.join(seen.select("session_id", "idx", hit.alias("is_boundary"), F.when(hit, F.col("last.is_resume")).alias("is_resume")), ["session_id", "idx"])


def containing_case(points: DataFrame, spans: DataFrame, at: str, out: str = "case_id") -> DataFrame:
    """Points with the case of the span (session_id, case_id, start_ms, end_ms) that holds them, bounds included; the latest
    start wins where spans overlap. As-of by a sort of the union."""
    columns = points.columns
    p = points.select(F.struct(*columns).alias("row"), "session_id", F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<case_id:string,end_ms:bigint>").alias("span"))
    s = spans.select(F.lit(None).cast(p.schema["row"].dataType).alias("row"), "session_id", F.col("start_ms").alias("t"), F.lit(0).alias("kind"), F.struct("case_id", "end_ms").alias("span"))
    w = Window.partitionBy("session_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = p.unionByName(s).withColumn("span", F.last("span", ignorenulls=True).over(w)).where("kind = 1")
    return seen.select("row.*", F.when(F.col("t") <= F.col("span.end_ms"), F.col("span.case_id")).alias(out))


def overlaps(segments: DataFrame, spans: DataFrame, bin_ms: int) -> DataFrame:
    """Pairs of a segment and a span of one session that overlap by more than 0 ms. Both sides are cut into bins of time, so
    that a long session spreads over many keys; a pair is reported in the bin where its overlap begins."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_ms), F.floor(F.col(b) / bin_ms)))
    left = segments.select("session_id", "seg_no", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"), bins("start_ms", "end_ms").alias("bin"))
    right = spans.select("session_id", "case_id", F.col("start_ms").alias("e0"), F.col("end_ms").alias("e1"), bins("start_ms", "end_ms").alias("bin"))
    begins = F.greatest("s0", "e0")
    both = left.join(right, ["session_id", "bin"]).where((F.col("s0") < F.col("e1")) & (F.col("e0") < F.col("s1")) & (F.floor(begins / bin_ms) == F.col("bin")))
    return both.select("session_id", "seg_no", "case_id", (F.least("s1", "e1") - begins).alias("overlap_ms"))


def nearest(points: DataFrame, targets: DataFrame, at: str, target_at: str, payload: str | None = None) -> DataFrame:
    """Points with the distance to, time of, and optionally a column of the nearest target of the session; the earlier one on a tie."""
    columns = points.columns
    value = F.struct(F.col(target_at).alias("at"), *([F.col(payload).alias("payload")] if payload else []))
    t = targets.select("session_id", F.col(target_at).alias("t"), F.lit(0).alias("kind"), value.alias("hit"))
    p = points.select(F.struct(*columns).alias("row"), "session_id", F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(t.schema["hit"].dataType).alias("hit"))
    t = t.select(F.lit(None).cast(p.schema["row"].dataType).alias("row"), *t.columns)
    w = Window.partitionBy("session_id").orderBy("t", "kind")
    seen = p.unionByName(t).withColumns(
        {"prev": F.last("hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.first("hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}
    )
    back, ahead = F.col("t") - F.col("prev.at"), F.col("next.at") - F.col("t")
    best = F.when(ahead.isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    return seen.where("kind = 1").select("row.*", F.abs(F.col("t") - best["at"]).alias("distance_ms"), best["at"].alias("nearest_ms"), *([best["payload"].alias(payload)] if payload else []))


def one_sided(points: DataFrame, targets: DataFrame, at: str, target_at: str, tolerance_ms: int, after: bool) -> DataFrame:
    """Points with the nearest target strictly before (or after) them within the tolerance."""
    columns = points.columns
    t = targets.select("session_id", F.col(target_at).alias("t"), F.lit(1).alias("kind"), F.col(target_at).alias("hit"))
    p = points.select(F.struct(*columns).alias("row"), "session_id", F.col(at).alias("t"), F.lit(2 if after else 0).alias("kind"), F.lit(None).cast("long").alias("hit"))
    t = t.select(F.lit(None).cast(p.schema["row"].dataType).alias("row"), *t.columns)
    w = Window.partitionBy("session_id").orderBy("t", "kind")
    hit = F.first("hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if after else F.last("hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = p.unionByName(t).withColumn("hit", hit).where("kind <> 1")
    return seen.select("row.*", F.when(F.abs(F.col("hit") - F.col("t")) <= tolerance_ms, F.col("hit")).alias("frame_ms"))


def inside(transitions: DataFrame, spans: DataFrame) -> DataFrame:
    """Transitions that lie wholly in a span of their session, with its case: start <= t and t_next <= end."""
    held = containing_spans(transitions, spans, "timestamp_ms")
    return held.where("next_timestamp_ms <= end_ms").drop("end_ms")


def containing_spans(points: DataFrame, spans: DataFrame, at: str) -> DataFrame:
    """As containing_case, for spans that do not overlap: points inside one, with case_id and end_ms."""
    keyed = spans.withColumn("case_id", F.struct("case_id", "end_ms").cast("struct<case_id:string,end_ms:bigint>"))
    columns = points.columns
    p = points.select(F.struct(*columns).alias("row"), "session_id", F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<case_id:string,end_ms:bigint>").alias("span"))
    s = keyed.select(F.lit(None).cast(p.schema["row"].dataType).alias("row"), "session_id", F.col("start_ms").alias("t"), F.lit(0).alias("kind"), F.col("case_id").alias("span"))
    w = Window.partitionBy("session_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = p.unionByName(s).withColumn("span", F.last("span", ignorenulls=True).over(w)).where("kind = 1 AND t <= span.end_ms")
    return seen.select("row.*", "span.case_id", "span.end_ms")


def offset_pairs(events: DataFrame, label: str, gaps: list[int], most: int | None = None, at: str | None = None) -> DataFrame:
    """Pairs (i, i + gap) of labelled events: all, or at most ``most`` a session: those with the least md5 of their keys. With
    ``at``, a time, the pair's distance in it is added as ``apart``."""
    times = [F.col(at)] if at else []
    left = events.where(F.col(label).isNotNull()).select("session_id", F.col("idx").alias("i"), F.col(label).alias("a"), *(c.alias("t_i") for c in times), F.explode(F.array(*map(F.lit, gaps))).alias("gap"))
    right = events.where(F.col(label).isNotNull()).select("session_id", F.col("idx").alias("j"), F.col(label).alias("b"), *(c.alias("t_j") for c in times))
    pairs = left.withColumn("j", F.col("i") + F.col("gap")).join(right, ["session_id", "j"])
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.md5(F.concat_ws("|", "session_id", F.col("i").cast("string"), F.col("j").cast("string")))))
        pairs = pairs.withColumn("rank", rank).where(F.col("rank") <= most)
    apart = [(F.col("t_j") - F.col("t_i")).alias("apart")] if at else []
    return pairs.select("session_id", "i", "j", "gap", (F.col("a") == F.col("b")).alias("same"), *apart)


def count_mismatches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose number of rows differs between two tables."""
    left, right = a.groupBy(key).agg(F.count("*").alias("n_a")), b.groupBy(key).agg(F.count("*").alias("n_b"))
    both = left.join(right, key, "full").select(key, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.where("n_a <> n_b")


def prefix_lookup(events: DataFrame, pairs: DataFrame, flag: str) -> DataFrame:
    """Pairs (session_id, i, j) with the number of flagged events strictly between i and j, from running sums."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    sums = events.select("session_id", "idx", F.sum(F.col(flag).cast("long")).over(w).alias("s"), F.col(flag).cast("long").alias("f"))
    at_i = sums.select("session_id", F.col("idx").alias("i"), F.col("s").alias("s_i"))
    at_j = sums.select("session_id", F.col("idx").alias("j"), (F.col("s") - F.col("f")).alias("s_j"))
    return pairs.join(at_i, ["session_id", "i"]).join(at_j, ["session_id", "j"]).withColumn("between", F.col("s_j") - F.col("s_i")).drop("s_i", "s_j")
