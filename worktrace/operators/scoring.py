"""Scoring, ranking and robustness of processes. Tables here have one row per process (and scenario)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(value: str, over: Sequence[str] = ()) -> Column:
    """0 to 1 over all rows (or within the keys); 0.5 where all are equal."""
    w = Window.partitionBy(*over)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 0.5).otherwise((F.col(value) - low) / (high - low))


def entropies(variants: DataFrame) -> DataFrame:
    """Entropy in bits of each process's variants, and its part of the possible one (0 for one variant)."""
    q = F.col("frequency") / F.sum("frequency").over(Window.partitionBy("process_id"))
    out = variants.withColumn("q", q).groupBy("process_id").agg((-F.sum(F.col("q") * F.log2("q"))).alias("h"), F.count("*").alias("k"))
    return out.select("process_id", F.when(F.col("k") > 1, F.col("h")).otherwise(0.0).alias("entropy"), F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(0.0).alias("norm_entropy"))


PARTS = {"impact": (("nf", 1), ("nt", 1), ("nm", 1)), "feasibility": (("nd", 1), ("ne", -1), ("ns", 1), ("nc", -1))}


def normalised(profile: DataFrame) -> DataFrame:
    """The seven components, each between 0 and 1. profile: frequency_share, time_share, manual_share, dominant_share,
    norm_entropy, surface, systems."""
    names = {"nf": "frequency_share", "nt": "time_share", "nm": "manual_share", "nd": "dominant_share", "ne": "norm_entropy", "ns": "surface", "nc": "systems"}
    return profile.select("process_id", *(min_max(c).alias(n) for n, c in names.items()))


def scores(parts: DataFrame, weights: DataFrame | None = None, round_to: int | None = 9) -> DataFrame:
    """impact, feasibility and their product. weights: (scenario, one column per component); equal ones unless given.
    A component that harms counts as 1 - value."""
    rows = parts if weights is None else parts.crossJoin(F.broadcast(weights))  # few scenarios x processes
    weight = lambda n: F.lit(1.0) if weights is None else F.col(f"w_{n}")

    def part(which: str) -> Column:
        total = sum((weight(n) * (F.col(n) if sign > 0 else 1 - F.col(n)) for n, sign in PARTS[which]), F.lit(0.0))
        mean = total / sum((weight(n) for n, _ in PARTS[which]), F.lit(0.0))
        return F.round(mean, round_to) if round_to is not None else mean

    keys = ["process_id"] if weights is None else ["scenario", "process_id"]
    return rows.select(*keys, part("impact").alias("impact"), part("feasibility").alias("feasibility")).withColumn("opportunity", F.col("impact") * F.col("feasibility"))


def ranks(scored: DataFrame, score: str = "opportunity", over: Sequence[str] = ()) -> DataFrame:
    """Rank by score, ties by id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*over).orderBy(F.desc(score), "process_id")))


def pareto(scored: DataFrame) -> DataFrame:
    """Adds on_frontier. Dominated: some row is at least as good in both and better in one. By a skyline pass over distinct
    impacts, not by pairs."""
    best = scored.groupBy("impact").agg(F.max("feasibility").alias("best"))
    above = F.max("best").over(Window.orderBy(F.desc("impact")).rowsBetween(Window.unboundedPreceding, -1))
    sky = best.withColumn("above", above)
    dominated = (F.coalesce(F.col("above") >= F.col("feasibility"), F.lit(False))) | (F.col("best") > F.col("feasibility"))
    return scored.join(sky, "impact").withColumn("on_frontier", ~dominated).drop("above", "best")


def dominated_by(scored: DataFrame) -> DataFrame:
    """(process_id, number of processes that dominate it): the report form, on one row per process."""
    a, b = scored.alias("a"), scored.select(F.col("impact").alias("i"), F.col("feasibility").alias("f"))
    better = (F.col("i") >= F.col("a.impact")) & (F.col("f") >= F.col("a.feasibility")) & ((F.col("i") > F.col("a.impact")) | (F.col("f") > F.col("a.feasibility")))
    return a.join(F.broadcast(b), better, "left").groupBy("process_id").agg(F.count("i").alias("n_dominating"))


def spearman(ranked: DataFrame, default: DataFrame) -> DataFrame:
    """Rank correlation of each scenario with the default ranking; 1 where it is not defined."""
    both = ranked.select("scenario", "process_id", "rank").join(default.select("process_id", F.col("rank").alias("base")), "process_id")
    return both.groupBy("scenario").agg(F.coalesce(F.corr("rank", "base"), F.lit(1.0)).alias("rho"))


def kendall(ranked: DataFrame, default: DataFrame) -> DataFrame:
    """Tau-a of each scenario against the default scores; a tie in one only is discordant."""
    both = ranked.select("scenario", "process_id", F.col("opportunity").alias("x")).join(default.select("process_id", F.col("opportunity").alias("y")), "process_id")
    other = both.select("scenario", F.col("process_id").alias("p2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = both.join(other, "scenario").where("process_id < p2")
    agree = F.signum(F.col("x") - F.col("x2")) == F.signum(F.col("y") - F.col("y2"))
    return pairs.groupBy("scenario").agg((F.sum(F.when(agree, 1).otherwise(-1)) / F.count("*")).alias("tau"))


def winsorised(rows: DataFrame, value: str, limit: float) -> DataFrame:
    """Values beyond the floor(n x limit)-th from either end take that one's value; fewer than three stay."""
    ordered = rows.withColumns({"_r": F.row_number().over(Window.orderBy(value, "process_id")) - 1, "_n": F.count("*").over(Window.partitionBy())})
    k = F.floor(F.col("_n") * limit)
    low = F.max(F.when(F.col("_r") == k, F.col(value))).over(Window.partitionBy())
    high = F.max(F.when(F.col("_r") == F.col("_n") - 1 - k, F.col(value))).over(Window.partitionBy())
    return ordered.withColumn(value, F.when(F.col("_n") < 3, F.col(value)).otherwise(F.least(F.greatest(F.col(value), low), high))).drop("_r", "_n")


def rank_robustness(ranked: DataFrame) -> DataFrame:
    """Per process over scenarios: best, worst, range and upper median rank."""
    at = F.row_number().over(Window.partitionBy("process_id").orderBy("rank")) - 1
    n = F.count("*").over(Window.partitionBy("process_id"))
    rows = ranked.withColumns({"_i": at, "_n": n})
    return rows.groupBy("process_id").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"), (F.max("rank") - F.min("rank")).alias("range"), F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col("rank"))).alias("median"))


def priority(parts: DataFrame, plus: Sequence[str], minus: Sequence[str], weights: DataFrame) -> DataFrame:
    """Weighted sum of components less the penalties, under each weight set (weight_set, one column w_<component> each)."""
    rows = parts.crossJoin(F.broadcast(weights))
    total = sum((F.col(f"w_{c}") * F.col(c) for c in plus), F.lit(0.0)) - sum((F.col(f"w_{c}") * F.col(c) for c in minus), F.lit(0.0))
    return rows.select("weight_set", "process_id", F.round(total, 9).alias("score"))


def top_names(k: int) -> Column:
    """Aggregate: the first k processes by rank, joined by >."""
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "process_id"))))
    return F.concat_ws(">", F.transform(first, lambda x: x["process_id"]))


def top_and_stable(ranked: DataFrame, over: str, k: int) -> DataFrame:
    """Per weight set the first k processes, and whether one process wins them all."""
    winners = ranked.where("rank = 1").agg((F.count_distinct("process_id") == 1).alias("winner_stable"))
    return ranked.groupBy(over).agg(top_names(k).alias("top_three")).crossJoin(F.broadcast(winners))  # one row


def stability(ranked: DataFrame, n: int) -> DataFrame:
    """(k, process_id, rank) at n thresholds: best and worst rank and the class of each process."""
    moved = F.max("rank") - F.min("rank")
    kind = F.when(F.count("*") < n, "absent").when(moved <= 1, "stable").when(moved <= 3, "shifting").otherwise("unstable")
    return ranked.groupBy("process_id").agg(F.count("*").alias("n_thresholds"), F.min("rank").alias("best"), F.max("rank").alias("worst"), F.max(F.when(F.col("k") == 5, F.col("rank"))).alias("rank_at_5"), kind.alias("stability"))


def checked(expected: DataFrame, metrics: DataFrame, tolerance: float) -> DataFrame:
    """Expected (name, value) beside the actual value; holds is null where the metrics lack the name."""
    both = expected.join(metrics.withColumnRenamed("value", "actual"), "name", "left")
    return both.withColumn("holds", F.abs(F.col("actual") - F.col("value")) <= tolerance)


def expectations(expected: DataFrame, metrics: DataFrame, tolerance: float) -> DataFrame:
    """Expected (name, value) that the metrics table lacks or differs from."""
    return checked(expected, metrics, tolerance).where("holds IS NULL OR NOT holds").drop("holds")
