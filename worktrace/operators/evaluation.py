"""Evaluation of cuts and segments against ground truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrace.operators.sequence import running_sums
from worktrace.operators.tables import written


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def boundary_metrics(rows: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, zero-safe; per key and pooled (null keys) in one pass."""
    t, p = F.col(truth), F.col(predicted)
    counts = [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")]
    out = rows.rollup(*by).agg(*counts) if by else rows.agg(*counts)
    return out.withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def execution_metrics(segments: DataFrame, spans: DataFrame, overlap: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Missed, over- and under-segmentation, pure noise and fragmentation. Over-segmentation is weighted by executions,
    under-segmentation by overlapping segments; fragmented counts distinct cases."""
    keys = list(by)
    per_case = overlap.groupBy("session_id", "case_id").agg(F.count("*").alias("c"))
    per_seg = overlap.groupBy("session_id", "seg_no").agg(F.count("*").alias("c"))
    cases = spans.join(per_case, ["session_id", "case_id"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    segs = segments.join(per_seg, ["session_id", "seg_no"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    a = cases.groupBy(*keys).agg(
        F.count("*").alias("n_executions"), F.count_if(F.col("c") == 0).alias("n_missed"), F.sum(F.greatest(F.col("c") - 1, F.lit(0))).alias("over"), F.count_distinct(F.when(F.col("c") > 1, F.col("case_id"))).alias("n_fragmented")
    )
    b = segs.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.count_if(F.col("c") == 0).alias("n_noise"), F.count_if(F.col("c") > 0).alias("touching"), F.sum(F.greatest(F.col("c") - 1, F.lit(0))).alias("under"))
    both = a.join(b, keys, "full") if keys else a.crossJoin(b)  # one row each
    return both.withColumns(
        {
            "over_rate": F.coalesce(F.try_divide("over", "n_executions"), F.lit(0.0)),
            "under_rate": F.coalesce(F.try_divide("under", "touching"), F.lit(0.0)),
            "pct_fragmented": F.coalesce(100 * F.try_divide("n_fragmented", "n_executions"), F.lit(0.0)),
        }
    )


def threshold_grid(scored: DataFrame, score: str, parts: Sequence[float], fixed: Sequence[float] = ()) -> DataFrame:
    """Distinct exact percentiles of a score, rounded to four places, and fixed points beside them."""
    grid = scored.agg(F.percentile(score, F.array(*map(F.lit, parts))).alias("g"))
    rounded = F.transform("g", lambda x: F.round(x, 4))
    points = F.array_union(rounded, F.array(*map(F.lit, fixed))) if fixed else F.array_distinct(rounded)
    return grid.select(F.explode(points).alias("threshold"))


def swept_metrics(rows: DataFrame, truth: str, flags: Mapping[tuple[int, str], Column]) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each flag, by its (tau, rule), from one pass over the rows."""
    t, cells, keys = F.col(truth), [], list(flags)
    for i, key in enumerate(keys):
        cells += [F.count_if(t & flags[key]).alias(f"tp_{i}"), F.count_if(~t & flags[key]).alias(f"fp_{i}"), F.count_if(t & ~flags[key]).alias(f"fn_{i}")]
    each = F.array(*(F.struct(F.lit(tau).cast("long").alias("tau"), F.lit(rule).alias("rule"), *(F.col(f"{c}_{i}").alias(c) for c in ("tp", "fp", "fn"))) for i, (tau, rule) in enumerate(keys)))
    return rows.agg(*cells).select(F.explode(each).alias("x")).select("x.*").withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def score_curve(scored: DataFrame, truth: str, score: str) -> DataFrame:
    """tp, fp, fn and f1 at each distinct score taken as threshold (score >= threshold): cumulative counts over the
    aggregated scores."""
    each = scored.groupBy(F.col(score).alias("threshold")).agg(F.count_if(truth).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    total = each.agg(F.sum("pos").alias("all_pos"))
    summed = running_sums(each, (), "threshold", {"tp": "pos", "fp": "neg"}, descending=True)
    out = summed.crossJoin(F.broadcast(total)).select("threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"))  # one row
    return out.withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def at_thresholds(scored: DataFrame, truth: str, score: str, grid: DataFrame) -> DataFrame:
    """Boundary counts at each threshold of a small grid, without multiplying the rows: a row counts into the grid step
    that its score reaches, and the steps are added up."""
    steps = F.array_sort(F.collect_list("threshold"))
    table = grid.agg(steps.alias("steps"))
    place = scored.crossJoin(F.broadcast(table)).select(F.col(truth).alias("t"), F.size(F.filter("steps", lambda x: x <= F.col(score))).alias("k"))  # one row of steps
    each = place.groupBy("k").agg(F.count_if("t").alias("pos"), F.count_if(~F.col("t")).alias("neg"))
    numbered = grid.withColumn("k", F.row_number().over(Window.orderBy("threshold")))
    joined = numbered.join(each.withColumnRenamed("k", "j"), F.col("j") >= F.col("k"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    return joined


def best_f1(curve: DataFrame, least_recall: float = 0.0) -> DataFrame:
    return curve.where(F.col("recall") >= least_recall).agg(F.max_by("threshold", F.struct("f1", "threshold")).alias("threshold"), F.max("f1").alias("f1"))


def auc(values: DataFrame, value: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC of a raw value by Mann-Whitney on distinct values; null if one side is empty or the value constant."""
    known = values.where(F.col(value).isNotNull())
    each = known.groupBy(*by, value).agg(F.count_if(truth).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    each = written(each, "values")  # read for the steps and for the values in them
    wins = running_sums(each, by, value, {"below": "neg"}, own=False).withColumn("wins", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    out = wins.groupBy(*by).agg(F.sum("wins").alias("w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.count("*").alias("k"))
    return out.withColumn("auc", F.when(F.col("k") > 1, F.try_divide("w", F.col("n_pos") * F.col("n_neg")))).drop("w", "k")


def direction_consistency(values: DataFrame, value: str, truth: str) -> DataFrame:
    """Sessions whose difference of means has the sign of the pooled difference."""
    diff = F.avg(F.when(F.col(truth), F.col(value))) - F.avg(F.when(~F.col(truth), F.col(value)))
    per = values.groupBy("session_id").agg(diff.alias("own")).where("own IS NOT NULL")
    pooled = values.agg(diff.alias("pooled"))
    return per.crossJoin(F.broadcast(pooled)).agg(F.count("*").alias("n_sessions"), F.count_if(F.signum("own") == F.signum("pooled")).alias("n_agree"))  # one row


def nearest_rank(rows: DataFrame, value: str, parts: Sequence[float], by: Sequence[str]) -> DataFrame:
    """n, mean, population deviation, minimum, maximum and nearest-rank percentiles sorted[min(int(n p), n - 1)] of each key."""
    known = rows.where(F.col(value).isNotNull())
    each = known.groupBy(*by, value).agg(F.count("*").alias("_c"))
    whole = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("low"), F.max(value).alias("high"))
    placed = running_sums(each, by, value, {"_r": "_c"}).join(whole.select(*by, "n"), list(by))
    at = lambda p: F.min(F.when(F.col("_r") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value)))
    return whole.join(placed.groupBy(*by).agg(*(at(p).alias(f"p{round(100 * p)}") for p in parts)), list(by))


def compared(base: DataFrame, candidate: DataFrame, metric: str, margin: float) -> DataFrame:
    """Sessions where a candidate improves, degrades or leaves a metric."""
    both = base.select("session_id", F.col(metric).alias("a")).join(candidate.select("session_id", F.col(metric).alias("b")), "session_id")
    kind = F.when(F.col("b") - F.col("a") > margin, "improved").when(F.col("a") - F.col("b") > margin, "degraded").otherwise("unchanged")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.avg(F.col("b") - F.col("a")).alias("mean_change"))


def co_occurrence(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Pairwise Jaccard of boolean signals, from one pass of sums."""
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    one = rows.agg(*(F.count_if(F.col(a) & F.col(b)).alias(f"both_{i}") for i, (a, b) in enumerate(pairs)), *(F.count_if(F.col(a) | F.col(b)).alias(f"any_{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"both_{i}").alias("n_both"), F.col(f"any_{i}").alias("n_any")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(cells).alias("x")).select("x.*").withColumn("jaccard", F.try_divide("n_both", "n_any"))


def held_out_choice(counts: DataFrame) -> DataFrame:
    """For each session the parameter with the best F1 on all the other sessions: total less own. counts: (session_id, param,
    tp, fp, fn); the least parameter wins ties."""
    w = Window.partitionBy("param")
    rest = counts.select("session_id", "param", *((F.sum(c).over(w) - F.col(c)).alias(c) for c in ("tp", "fp", "fn"))).withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn")))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(F.round("f1", 12)), "param"))
    return rest.withColumn("_r", rank).where("_r = 1").select("session_id", "param", "f1")


def extremes(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k sessions with the highest and the k with the lowest value: (side, session_id, value, place). Each end is a top-k, so
    partitions send k rows each."""
    parts = []
    for side, order in (("best", F.desc(value)), ("worst", F.asc(value))):
        top = rows.orderBy(order, "session_id").limit(k)
        parts.append(top.select(F.lit(side).alias("side"), "session_id", value, F.row_number().over(Window.orderBy(order, "session_id")).alias("place")))  # k rows
    return parts[0].unionByName(parts[1])


def gain_survival(gains: DataFrame, top: int, margin: float = 0.01) -> DataFrame:
    """gains(session_id, operator, gain): the mean gain, without the ``top`` sessions that gain most, over the sessions of all operators
    but the one whose mean gain is largest, and the part of sessions that lose more than the margin."""
    first = gains.orderBy(F.desc(F.round("gain", 9)), "session_id").limit(top).agg(F.sum("gain").alias("top_sum"), F.count("*").alias("top_n"))
    whole = gains.agg(F.count("*").alias("n_sessions"), F.sum("gain").alias("total"), F.avg((F.col("gain") < -margin).cast("double")).alias("degraded"))
    people = gains.groupBy("operator").agg(F.avg("gain").alias("g"))
    best = people.orderBy(F.desc(F.round("g", 9)), "operator").limit(1).select(F.col("operator").alias("best"))
    others = gains.join(F.broadcast(best), F.col("operator").eqNullSafe(F.col("best")), "left_anti").agg(F.avg("gain").alias("without_best_operator"))  # one row
    one = whole.crossJoin(first).crossJoin(others)  # one row each
    return one.select("n_sessions", F.try_divide("total", "n_sessions").alias("mean_gain"), F.try_divide(F.col("total") - F.col("top_sum"), F.col("n_sessions") - F.col("top_n")).alias("without_top_three"), "without_best_operator", "degraded")


def gates(one: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """The eight promotion gates g1 .. g8 of one row of figures, and whether all hold. Gates 3 to 5 bound what the candidate may
    lose against the detector in use; a fixed cap is a ``more`` or ``times`` made from the figure in use."""
    checks = {
        "g1": F.col("new_f1") - F.col("old_f1") >= caps["least_gain"],
        "g2": F.col("new_recall") >= caps["least_recall"],
        "g3": F.col("new_pct_fragmented") <= F.col("old_pct_fragmented") + caps["more_fragmented"],
        "g4": F.col("new_under_rate") <= F.col("old_under_rate") * caps["times_under"],
        "g5": F.col("new_over_rate") <= F.col("old_over_rate") * caps["times_over"],
        "g6": F.col("degraded") <= caps["most_degraded"],
        "g7": F.col("without_top_three") > 0,
        "g8": F.col("without_best_operator") > 0,
    }
    every = F.lit(True)
    for c in checks:
        every = every & F.col(c)
    return one.select(*(c.alias(n) for n, c in checks.items())).withColumn("promoted", every)


def unpivoted(rows: DataFrame, keys: Sequence[str], signals: Sequence[str]) -> DataFrame:
    """(keys, signal, v): one row a signal, its value as a double; flags as 0 and 1, so that their mean is a rate."""
    each = F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("v")) for c in signals))
    return rows.withColumn("_s", F.explode(each)).select(*keys, "_s.signal", "_s.v")


def rates(rows: DataFrame, of: Sequence[str], values: Sequence[str]) -> DataFrame:
    """n and rate of each combination of ``values`` among the rows of its ``of``."""
    counted = rows.groupBy(*of, *values).agg(F.count("*").alias("n"))
    return counted.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(*of)))


def most_common(rows: DataFrame, of: Sequence[str], value: str, among: DataFrame, share_of: str, k: int = 15) -> DataFrame:
    """The k most common values of each ``of`` with n and their rate among all rows of ``share_of`` in ``among``; the lesser value
    on a tie."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*of, value).agg(F.count("*").alias("n"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("n"), value))).where(F.col("place") <= k)
    whole = among.groupBy(share_of).agg(F.count("*").alias("_all"))
    return first.join(whole, share_of).withColumn("rate", F.col("n") / F.col("_all")).drop("_all")


def concentration(rows: DataFrame, of: str, by: str, top: int = 3) -> DataFrame:
    """Per ``of``: n, number of ``by``, the share of the largest one and of the ``top`` largest, and the sum of squared shares."""
    each = rows.groupBy(of, by).agg(F.count("*").alias("c"))
    whole = each.groupBy(of).agg(F.sum("c").alias("n"), F.count("*").alias("n_groups"), F.max("c").alias("most"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    largest = each.withColumn("place", F.row_number().over(Window.partitionBy(of).orderBy(F.desc("c"), by))).where(F.col("place") <= top)
    n = F.col("n")
    return whole.join(largest.groupBy(of).agg(F.sum("c").alias("head")), of).select(
        of, "n", "n_groups", (F.col("most") / n).alias("largest_share"), (F.col("head") / n).alias("top_share"), (F.col("squares") / n / n).alias("herfindahl")
    )


def average_precision(values: DataFrame, value: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision at each distinct value taken as threshold, from the highest down, weighted by the share of true rows at it."""
    each = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(truth).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    summed = running_sums(each, by, value, {"tp": "pos", "fp": "neg"}, descending=True)
    part = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return summed.groupBy(*by).agg(F.try_divide(part, F.sum("pos")).alias("average_precision"))


def boundary_forensics(judged: DataFrame, cases: DataFrame, changes: Sequence[str]) -> DataFrame:
    """What kinds of hits and errors look like: per kind (true, missed, quiet, false_inside an execution, false_noise) its number, the executions
    that it occurs in, the most in one execution, the share of each change and the mean log pause.

    judged: transitions with is_boundary, predicted, delta_t_ms and the changes; cases: (session_id, idx, case_id) of the events. A
    transition is inside an execution if the events on both sides are of it. Two aggregates, the second over executions.
    """
    w = Window.partitionBy("session_id").orderBy("idx")
    inside = cases.select("session_id", "idx", F.when(F.col("case_id") == F.lead("case_id").over(w), F.col("case_id")).alias("case_id"))
    false = F.when(F.col("case_id").isNotNull(), "false_inside").otherwise("false_noise")
    kind = F.when(F.col("predicted"), F.when(F.col("is_boundary"), "true").otherwise(false)).otherwise(F.when(F.col("is_boundary"), "missed").otherwise("quiet"))
    rows = judged.join(inside, ["session_id", "idx"], "left").withColumn("kind", kind)
    each = rows.groupBy("kind", "case_id").agg(F.count("*").alias("n"), F.sum(F.log1p(F.greatest("delta_t_ms", F.lit(0)))).alias("pause"), *(F.count_if(c).alias(c) for c in changes))
    own = F.when(F.col("case_id").isNotNull(), F.col("n"))
    return each.groupBy("kind").agg(
        F.sum("n").alias("n_"), F.count("case_id").alias("n_executions"), F.coalesce(F.max(own), F.lit(0)).alias("most_in_one"), (F.sum("pause") / F.sum("n")).alias("mean_log_pause"), *((F.sum(c) / F.sum("n")).alias(f"share_{c}") for c in changes)
    ).withColumnRenamed("n_", "n")
