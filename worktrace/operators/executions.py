"""Segments and executions built from cuts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrace.functions import scalar
from worktrace.operators.sequence import fill_forward, ordered, runs, segments, with_runs

SEG = ("session_id", "seg_no")


def segment_spans(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy(*SEG).agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count("*").alias("event_count"))


def executions(segmented: DataFrame, noise_apps: Sequence[str]) -> DataFrame:
    """One row per segment: id, operator, times, number of events and sorted applications."""
    apps = F.array_sort(F.collect_set(F.when(~F.col("application").isin(*noise_apps), F.col("application"))))
    out = segmented.groupBy(*SEG).agg(F.first("operator").alias("operator"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count("*").alias("event_count"), apps.alias("applications"))
    return out.select(F.concat_ws("::exec", "session_id", F.col("seg_no").cast("string")).alias("execution_id"), *SEG, "operator", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "event_count", "applications")


def _most_common(rows: DataFrame, value: str) -> DataFrame:
    """The most frequent value of each segment, the first seen on a tie."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*SEG, value).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*SEG).orderBy(F.desc("n"), "first"))
    return counted.withColumn("r", rank).where("r = 1").select(*SEG, value)


def dominant_context(segmented: DataFrame, suffixes: Mapping[str, str], transient: Sequence[str] = ()) -> DataFrame:
    """Most frequent system of each segment (filled forward inside it), refined by the most frequent document where it is an
    application; ``unknown`` without any."""
    filled = fill_forward(segmented, "system", "filled", SEG)
    system = _most_common(filled, "filled")
    own = filled.join(system.withColumnRenamed("filled", "dominant"), list(SEG)).where(F.col("dominant") == F.concat(F.lit("app:"), F.col("application")))
    document = _most_common(own.withColumn("document", scalar.document_key(F.col("application"), F.col("window_title"), suffixes, transient)), "document")
    every = segmented.select(*SEG).distinct()
    return every.join(system, list(SEG), "left").join(document, list(SEG), "left").select(
        *SEG, F.coalesce(F.concat_ws("::", "filled", "document"), F.lit("")).alias("c")
    ).select(*SEG, F.when(F.col("c") == "", "unknown").otherwise(F.col("c")).alias("dominant_context"))


def steps(segmented: DataFrame) -> DataFrame:
    """Runs of equal (system, category) inside each segment: (segment, step_no, system, category, n_events, times)."""
    filled = fill_forward(segmented, "system", "filled", SEG)
    marked = with_runs(filled, F.struct("filled", "interaction_category"), "step_no", SEG)
    return marked.groupBy(*SEG, "step_no").agg(
        F.min("filled").alias("system"),
        F.min("interaction_category").alias("interaction_category"),
        F.count("*").alias("n_events"),
        F.min("timestamp_ms").alias("start_ms"),
        F.max("timestamp_ms").alias("end_ms"),
    )


def step_types(segmented: DataFrame, top: int) -> DataFrame:
    """The top event types of each step, by count and then first place."""
    filled = with_runs(fill_forward(segmented, "system", "filled", SEG), F.struct("filled", "interaction_category"), "step_no", SEG)
    counted = filled.groupBy(*SEG, "step_no", "event_type").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*SEG, "step_no").orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top).select(*SEG, "step_no", "rank", "event_type", "n")


def methods_compared(flags: DataFrame, events: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Per boundary method: cuts, segments, mean events and mean ms of a segment. flags: (session_id, idx, one column per method).
    The methods become rows, so one pass serves all."""
    w = Window.partitionBy("method", "session_id").orderBy("idx")
    rows = events.select("session_id", "idx", "timestamp_ms").join(flags, ["session_id", "idx"], "left")
    long = rows.unpivot(["session_id", "idx", "timestamp_ms"], list(methods), "method", "cut")
    numbered = long.withColumn("_b", F.coalesce(F.lag("cut").over(w), F.lit(False)).cast("long")).withColumn("seg_no", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("method", "session_id", "seg_no").agg(F.count("*").alias("n"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("ms"))
    return spans.groupBy("method").agg(
        F.count("*").alias("n_segments"), (F.count("*") - F.count_distinct("session_id")).alias("n_cuts"), F.avg("n").alias("mean_events"), F.avg("ms").alias("mean_ms"), F.max("n").alias("max_events")
    )


def coherence(segmented: DataFrame) -> DataFrame:
    """Per cut between neighbouring segments: sizes, durations, event rates, their ratio, and Jaccards of types and applications."""
    each = segmented.groupBy(*SEG).agg(
        F.count("*").alias("n"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("ms"), F.collect_set("event_type").alias("types"), F.collect_set("application").alias("apps")
    )
    w = ordered("session_id", by="seg_no")
    nxt = {f"next_{c}": F.lead(c).over(w) for c in ("n", "ms", "types", "apps")}
    rate = lambda n, ms: F.when(F.col(ms) > 0, F.col(n) * 1000 / F.col(ms))
    out = each.withColumns(nxt).where("next_n IS NOT NULL").withColumns({"rate": rate("n", "ms"), "next_rate": rate("next_n", "next_ms")})
    return out.select(
        *SEG, "n", "ms", "next_n", "next_ms",
        (F.least("rate", "next_rate") / F.greatest("rate", "next_rate")).alias("rate_ratio"),
        scalar.jaccard(F.col("types"), F.col("next_types")).alias("types_jaccard"),
        scalar.jaccard(F.col("apps"), F.col("next_apps")).alias("apps_jaccard"),
    )


def costs(segmented: DataFrame) -> DataFrame:
    """Per segment: entropy of the event types, switch rate, coefficient of variation of the log gaps."""
    w = ordered(*SEG)
    gap = F.log1p(F.col("timestamp_ms") - F.lag("timestamp_ms").over(w))
    rows = segmented.select(*SEG, "idx", "event_type", gap.alias("g"), (F.lag("event_type").over(w) != F.col("event_type")).cast("double").alias("switch"))
    flow = rows.groupBy(*SEG).agg(F.count("*").alias("n"), F.avg("switch").alias("switch_rate"), F.when(F.avg("g") > 0, F.stddev_pop("g") / F.avg("g")).alias("gap_cv"))
    share = rows.groupBy(*SEG, "event_type").agg(F.count("*").alias("c")).withColumn("q", F.col("c") / F.sum("c").over(Window.partitionBy(*SEG)))
    entropy = share.groupBy(*SEG).agg((-F.sum(F.col("q") * F.log2("q"))).alias("type_entropy"))
    return flow.join(entropy, list(SEG)).select(*SEG, "n", F.coalesce("switch_rate", F.lit(0.0)).alias("switch_rate"), "gap_cv", (F.col("type_entropy") + F.lit(0.0)).alias("type_entropy"))


def purity(segmented: DataFrame, labelled: DataFrame) -> DataFrame:
    """Whether a segment holds a true boundary strictly inside: between two of its events."""
    last = segmented.withColumn("_last", F.lead("idx").over(ordered(*SEG)).isNull())
    return last.join(labelled.select("session_id", "idx", "is_boundary"), ["session_id", "idx"], "left").groupBy(*SEG).agg(F.coalesce(F.bool_or(F.col("is_boundary") & ~F.col("_last")), F.lit(False)).alias("is_mixed"))


def interruption_profile(inner: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Per execution over the transitions inside it: largest gap and where, gaps over each threshold, changes, densities."""
    return inner.groupBy("session_id", "case_id").agg(
        F.count("*").alias("n"),
        F.max("delta_t_ms").alias("max_gap_ms"),
        F.max_by("idx", F.struct(F.col("delta_t_ms"), -F.col("idx"))).alias("max_gap_idx"),
        *(F.count_if(F.col("delta_t_ms") >= t).alias(f"gaps_{i}") for i, t in enumerate(thresholds)),
        F.count_if("application_changed").alias("app_changes"),
        F.count_if("browser_domain_changed").alias("domain_changes"),
        F.avg("density_before").alias("mean_density"),
    )


def returns_inside(events: DataFrame, column: str) -> DataFrame:
    """Return patterns inside executions (session_id, case_id): with the time away."""
    from worktrace.operators.sequence import return_patterns

    keys = ("session_id", "case_id")
    found = return_patterns(runs(events, column, keys), keys)
    at = lambda c: events.select("session_id", "case_id", F.col("idx").alias(c), F.col("timestamp_ms").alias(f"{c}_ms"))
    return found.join(at("left_end_idx"), [*keys, "left_end_idx"]).join(at("return_start_idx"), [*keys, "return_start_idx"]).select(
        *keys, "value", "left_end_idx", "return_start_idx", "is_immediate", "away_events", (F.col("return_start_idx_ms") - F.col("left_end_idx_ms")).alias("away_ms")
    )


def executions_of(events: DataFrame, cuts: DataFrame, noise_apps: Sequence[str], suffixes: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(executions with dominant_context, segmented events)."""
    segmented = segments(events, cuts)
    return executions(segmented, noise_apps).join(dominant_context(segmented, suffixes), list(SEG)), segmented


def with_neighbour(segmented: DataFrame) -> DataFrame:
    """Events of each segment and the next one as one merged segment, by the first one's seg_no: an event counts in two."""
    last = F.max("seg_no").over(Window.partitionBy("session_id"))
    both = segmented.withColumn("_last", last).withColumn("seg_no", F.explode(F.array(F.col("seg_no") - 1, F.col("seg_no"))))
    return both.where("seg_no >= 0 AND seg_no < _last").drop("_last")


def split_gaps(segmented: DataFrame, parts: Sequence[str] = ("switch_rate", "gap_cv", "type_entropy")) -> DataFrame:
    """For each cut between a segment and the next: cost of the merged segment less the costs of both, where a cost is the sum of
    its parts' z-values over all segments (a missing part is average)."""
    own = costs(segmented)
    stats = own.agg(*(x for c in parts for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"d_{c}"))))

    def z(df: DataFrame) -> DataFrame:
        total = sum((F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"d_{c}")), F.lit(0.0)) for c in parts), F.lit(0.0))
        return df.crossJoin(F.broadcast(stats)).select(*SEG, total.alias("z"))  # one row

    after = Window.partitionBy("session_id").orderBy("seg_no")
    halves = z(own).select(*SEG, (F.col("z") + F.lead("z").over(after)).alias("split_z")).where("split_z IS NOT NULL")
    return z(costs(with_neighbour(segmented))).withColumnRenamed("z", "merged_z").join(halves, list(SEG)).withColumn("gap", F.col("merged_z") - F.col("split_z"))


def around_points(points: DataFrame, executions_: DataFrame) -> DataFrame:
    """Each point (point_id, session_id, at_ms) with the execution that holds it, the last one that ended before it and the first one
    that starts after it; points are a sample of a stated size, so they are what is broadcast."""
    both = executions_.join(F.broadcast(points.select("point_id", "session_id", "at_ms")), "session_id")
    holds = F.col("at_ms").between(F.col("start_ms"), F.col("end_ms"))
    pick = lambda f, c, name: f(F.when(c, F.col("execution_id")), F.when(c, F.col("start_ms"))).alias(name)
    found = both.groupBy("point_id").agg(pick(F.min_by, holds, "inside_id"), pick(F.max_by, F.col("end_ms") < F.col("at_ms"), "before_id"), pick(F.min_by, F.col("start_ms") > F.col("at_ms"), "after_id"))
    return points.join(found, "point_id", "left")
