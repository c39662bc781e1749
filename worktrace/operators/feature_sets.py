"""Feature sets with added evidence: baselines of operators from training folds only, scores of the sets, thresholds and a gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.operators import evaluation as ev
from worktrace.operators import regression as rg
from worktrace.operators import supervised as sv
from worktrace.operators.sequence import running_sums
from worktrace.operators.tables import written


def weighted_medians(rows: DataFrame, by: Sequence[str], value: str, count: str) -> DataFrame:
    """(by, median, n): the exact median of a number that stands for ``count`` rows each, from running counts over its order: no task holds a key's values."""
    summed = running_sums(rows.select(*by, value, count), by, value, {"_upto": count})
    totals = rows.groupBy(*by).agg(F.sum(count).alias("n"))
    keys = [f"_t_{k}" for k in by]
    same = F.lit(True)
    for k, other in zip(by, keys, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(other))
    known = summed.join(F.broadcast(totals.withColumnsRenamed(dict(zip(by, keys, strict=True)))), same)  # one row a key
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col(value)))
    return known.groupBy(*by).agg(((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).alias("median"), F.first("n").alias("n"))


def fold_baselines(gaps: DataFrame, folds: int, least: int, group: str = "session_id") -> DataFrame:
    """(fold, operator, n, centre, spread, source): median and median absolute deviation (1e-6 at least) of log1p_delta_t_ms of an operator over the
    groups of the other folds; those of all operators together where it has fewer than ``least`` gaps there. A null operator is the row
    of all. gaps: group, operator, log1p_delta_t_ms. Every gap counts for folds - 1 baselines, once for its operator and once for all."""
    g = F.col("g")
    own = sv.group_fold(F.col(group), folds)
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != own)
    each = gaps.select("operator", F.col("log1p_delta_t_ms").alias("g"), F.explode(others).alias("fold")).where("g IS NOT NULL")
    both = written(each.where("operator IS NOT NULL").unionByName(each.withColumn("operator", F.lit(None).cast("string"))).groupBy("fold", "operator", "g").agg(F.count("*").alias("c")), "gaps")
    of = ["fold", "operator"]
    middle = weighted_medians(both, of, "g", "c").withColumnRenamed("median", "m")
    same = lambda a, b: (a["fold"] == b["fold"]) & a["operator"].eqNullSafe(b["operator"])
    medians = written(middle, "medians")
    apart = both.join(F.broadcast(medians.select(F.col("fold").alias("f"), F.col("operator").alias("o"), "m")), (F.col("fold") == F.col("f")) & F.col("operator").eqNullSafe(F.col("o")))  # folds x operators
    spread = weighted_medians(apart.select(*of, F.abs(g - F.col("m")).alias("a"), "c"), of, "a", "c").select(*of, F.col("median").alias("d"))
    known = medians.join(spread, same(medians, spread)).select(medians["fold"], medians["operator"], "n", "m", "d")
    every = known.where("operator IS NULL").select("fold", F.col("m").alias("gm"), F.col("d").alias("gd"))
    few = F.col("operator").isNull() | (F.col("n") < least)
    out = known.join(every, "fold")
    return out.select("fold", "operator", "n", F.when(few, F.col("gm")).otherwise(F.col("m")).alias("centre"), F.greatest(F.when(few, F.col("gd")).otherwise(F.col("d")), F.lit(1e-6)).alias("spread"), F.when(few, "all").otherwise("operator").alias("source"))


def with_z(rows: DataFrame, baselines: DataFrame, folds: int, group: str = "session_id") -> DataFrame:
    """Each row once for every fold's model (``at``), with its own ``fold`` and its gap's distance from the baseline that this model may know:
    z_log_gap in spreads. An operator that the other folds do not have is measured by all of them."""
    spread = rows.withColumns({"fold": sv.group_fold(F.col(group), folds), "at": F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))})
    per = baselines.where("operator IS NOT NULL").select(F.col("fold").alias("at"), "operator", F.col("centre").alias("oc"), F.col("spread").alias("os"))
    every = baselines.where("operator IS NULL").select(F.col("fold").alias("at"), F.col("centre").alias("gc"), F.col("spread").alias("gs"))
    joined = spread.join(F.broadcast(per), ["at", "operator"], "left").join(F.broadcast(every), "at", "left")  # folds x operators
    z = (F.col("log1p_delta_t_ms") - F.coalesce("oc", "gc")) / F.coalesce("os", "gs")
    return joined.withColumn("z_log_gap", F.coalesce(z, F.lit(0.0))).drop("oc", "os", "gc", "gs")


def with_fold_z(rows: DataFrame, baselines: DataFrame, folds: int, group: str = "session_id") -> DataFrame:
    """As ``with_z``, but each row once, with its ``fold`` and z_log_gap_k for the model of every fold k."""
    of = [F.col("fold").cast("int").alias("k"), F.struct("centre", "spread").alias("v")]
    held = lambda name: F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name)
    per = baselines.where("operator IS NOT NULL").select("operator", *of).groupBy("operator").agg(held("_own"))
    every = baselines.where("operator IS NULL").select(*of).agg(held("_all"))
    joined = rows.withColumn("fold", sv.group_fold(F.col(group), folds)).join(F.broadcast(per), "operator", "left").crossJoin(F.broadcast(every))  # operators, one row
    known = lambda k: F.coalesce(F.try_element_at("_own", F.lit(k)), F.try_element_at("_all", F.lit(k)))
    z = lambda k: F.coalesce((F.col("log1p_delta_t_ms") - known(k)["centre"]) / known(k)["spread"], F.lit(0.0))
    return joined.withColumns({f"z_log_gap_{k}": z(k) for k in range(folds)}).drop("_own", "_all")


def set_scores(rows: DataFrame, sets: Mapping[str, Sequence[str]], label: str, keys: Sequence[str], folds: int, by_fold: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(keys, truth, set, score) by balanced regressions, all sets and folds fitted in the same passes; rows as from with_z, or from with_fold_z and with the
    columns that stand for one in each fold's model (``by_fold``), so that a model's own baselines never saw what it scores."""
    fits = {name: [rg.Fit(tuple((by_fold or {}).get(c, [c] * folds)[k] for c in columns), k) for k in range(folds)] for name, columns in sets.items()}
    columns = sorted({c for fs in fits.values() for f in fs for c in f.columns})
    at = ["at"] if "at" in rows.columns else []
    filled = rows.where(F.col(label).isNotNull()).select(*keys, F.col(label).alias("truth"), F.col(label).cast("double").alias("_y"), "fold", *at, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    table = written(filled, "sets")
    own = table.where(F.col("at") == F.col("fold")) if at else table
    counts = {(r["fold"], r["_y"]): r["count"] for r in own.groupBy("fold", "_y").count().collect()}
    alone = [float(any(f != k and v == 1.0 for f, v in counts)) for k in range(folds)]
    found = iter(rg.fitted_together(table, [f for fs in fits.values() for f in fs]))
    scores = [F.struct(F.lit(name).alias("set"), rg.chance_by_fold(fs, [next(found) for _ in fs], alone).alias("score")) for name, fs in fits.items()]
    return written(own.select(*keys, "truth", F.explode(F.array(*scores)).alias("_s")).select(*keys, "truth", "_s.set", "_s.score"), "scores")


def compared_sets(first: DataFrame, second: DataFrame, keys: Sequence[str], base: str, locked: tuple[float, float], gain: float) -> DataFrame:
    """(set, protocol, first_at, second_at, tp, fp, fn, precision, recall, f1, gain, passed): a place is cut where either score reaches its
    threshold. ``matched`` takes each set's thresholds of best F1 of either score alone, ``locked`` the given ones; gain is over the set ``base``."""
    names = [r[0] for r in first.select("set").distinct().orderBy("set").collect()]
    at: list[tuple] = []
    for name in names:
        best = [ev.best_f1(ev.score_curve(t.where(F.col("set") == name), "truth", "score")).first()["threshold"] for t in (first, second)]
        at += [(name, "matched", *best), (name, "locked", *locked)]
    grid = first.sparkSession.createDataFrame(at, "set string, protocol string, first_at double, second_at double")
    both = first.join(second.select(*keys, "set", F.col("score").alias("other")), [*keys, "set"]).join(F.broadcast(grid), "set")  # sets x protocols
    cut = both.withColumn("predicted", (F.col("score") >= F.col("first_at")) | (F.col("other") >= F.col("second_at")))
    t, p = F.col("truth"), F.col("predicted")
    of = ["set", "protocol", "first_at", "second_at"]
    counts = cut.groupBy(*of).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    found = counts.withColumns(ev._prf(F.col("tp"), F.col("fp"), F.col("fn")))
    from_base = found.where(F.col("set") == base).select("protocol", F.col("f1").alias("base_f1"))
    return found.join(from_base, "protocol").select(*of, "tp", "fp", "fn", "precision", "recall", "f1", (F.col("f1") - F.col("base_f1")).alias("gain"), (F.col("f1") - F.col("base_f1") >= gain).alias("passed"))
