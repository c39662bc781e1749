"""Supervised models by group folds: vectors of executions and of pairs of events, predictions of rows that a model has not seen,
and reports over the predictions.

Rows and vectors are written once; the models are Spark's own and see them as a distributed table. What comes to the driver are
vocabularies (a few values a column), class counts and models. Reports are aggregates over the predictions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrace.operators import evaluation as ev
from worktrace.operators.tables import written


def group_fold(group: Column, folds: int) -> Column:
    """The fold of a group, from 28 bits of its MD5: rows of one group are never apart, and no table of groups is needed."""
    return F.pmod(F.conv(F.substring(F.md5(group), 1, 7), 16, 10).cast("long"), F.lit(folds)).cast("int")


# --- vectors ----------------------------------------------------------------------------------------------------------------


def top_values(rows: DataFrame, sizes: Mapping[str, int]) -> dict[str, list]:
    """The most common non-null values of each column, as many as it says; the lesser value on a tie."""
    return {c: [r[0] for r in rows.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(k).collect()] for c, k in sizes.items()}


def _named(prefix: str, values: Sequence) -> dict[str, object]:
    """A column name for each value; values that read alike are told apart by their place."""
    out: dict[str, object] = {}
    for i, v in enumerate(values):
        name = f"{prefix}_{re.sub(r'[^0-9A-Za-z]+', '_', str(v)).strip('_')}"
        out[name if name not in out else f"{name}_{i}"] = v
    return out


def execution_vectors(events: DataFrame, keys: Sequence[str], vocabulary: Mapping[str, Sequence], manual: Sequence[str], least: int = 2) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, behaviour columns, identity columns): one row per execution of ``least`` events or more.

    Behaviour is how it is worked: length, pace, shares of categories and event types, and numbers of distinct applications, titles
    and switches. Identity is where: shares of the applications and domains. Shares are of all the execution's events; values beyond
    the vocabulary count only there. One aggregation after one window, both by the execution."""
    w = Window.partitionBy(*keys).orderBy("idx")
    known = F.row_number().over(w) > 1
    marked = events.withColumn("_switch", known & ~F.lag("application").over(w).eqNullSafe(F.col("application")))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    shares = lambda prefix, column: {n: share(F.col(column) == v) for n, v in _named(prefix, vocabulary.get(column, ())).items()}
    # sets of few values: a distinct count would take every event once more for each column
    several = lambda c: F.size(F.collect_set(c))
    behaviour = {"n_events": F.count("*").cast("double"), "duration_ms": (F.max("timestamp_ms") - F.min("timestamp_ms")).cast("double")}
    behaviour |= shares("cat", "interaction_category") | {"n_categories": several("interaction_category").cast("double")}
    behaviour |= shares("type", "event_type") | {"n_types": several("event_type").cast("double")}
    behaviour |= {
        "manual_share": share(F.col("interaction_category").isin(*manual)),
        "text_share": share(F.col("has_extracted_text")),
        "n_applications": several("application").cast("double"),
        "n_switches": F.count_if("_switch").cast("double"),
        "n_titles": several("window_title").cast("double"),
    }
    identity = shares("app", "application") | shares("domain", "browser_domain")
    rows = marked.groupBy(*keys).agg(*(c.alias(n) for n, c in (behaviour | identity).items())).where(F.col("n_events") >= least)
    rows = rows.withColumns({"log1p_duration": F.log1p(F.greatest("duration_ms", F.lit(0.0))), "per_second": F.coalesce(F.try_divide(F.col("n_events"), F.col("duration_ms") / 1000), F.lit(0.0))})
    return rows, [*behaviour, "log1p_duration", "per_second"], list(identity)


#: The columns of a pair by what they tell: how far apart its ends are and what lies between, or what the ends have in common.
DISTANCE = ("log1p_delta_t_ms", "index_gap", "n_app_switches_between", "n_distinct_apps_between", "any_navigation_between", "any_clipboard_between")
LINKING = ("same_application", "same_window_title", "same_browser_domain", "both_domains_known", "same_tab_id", "both_tabs_known", "same_event_type", "same_chunk")


def pair_vectors(events: DataFrame, label: str, gaps: Sequence[int], navigation: Column, clipboard: Column, tab: Column) -> DataFrame:
    """(session_id, i, j, apart_ms, other_work, same, the 14 columns of DISTANCE and LINKING) of all pairs (i, i + gap) of labelled events.

    What lies between are differences of running counts carried by the ends. A value is among the places i .. i + gap if it has come in by the
    last and not gone out before the first, where it comes in at a place that is more than gap after its last one and goes out at a
    place that is more than gap before its next one; so distinct applications, and labels for other work, are differences of running counts
    as well. A pair takes its end from the session's order: one shuffle by session, and no pair's inside is ever listed."""
    w = Window.partitionBy("session_id").orderBy("idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long")).over(so_far)
    switch = (F.row_number().over(w) > 1) & ~F.lag("application").over(w).eqNullSafe(F.col("application"))
    own_of = lambda c: Window.partitionBy("session_id", c).orderBy("idx")
    flagged = events.select("session_id", "idx", "timestamp_ms", "application", "window_title", "browser_domain", tab.alias("tab"), "event_type", "chunk_id", F.col(label).alias("label"), switch.alias("sw"), navigation.alias("nav"), clipboard.alias("clip"))
    valued = {"a": "application", "l": "label"}
    flagged = flagged.withColumns({f"{p}_last": F.col("idx") - F.lag("idx").over(own_of(c)) for p, c in valued.items()} | {f"{p}_next": F.lead("idx").over(own_of(c)) - F.col("idx") for p, c in valued.items()})
    beyond = lambda p, c, side, g: F.col(c).isNotNull() & F.coalesce(F.col(f"{p}_{side}") > g, F.lit(True))
    come = {f"{p}_in_{g}": count(beyond(p, c, "last", g)) for p, c in valued.items() for g in gaps}
    gone = {f"{p}_out_{g}": count(beyond(p, c, "next", g)) - beyond(p, c, "next", g).cast("long") for p, c in valued.items() for g in gaps}
    ends = flagged.withColumns({"s": count(F.col("sw")), "v": count(F.col("nav")), "c": count(F.col("clip"))} | come | gone)
    side = ["timestamp_ms", "application", "window_title", "browser_domain", "tab", "event_type", "chunk_id", "label", "s", "v", "c"]
    at = {f"at_{g}": F.first(F.when(F.col("label").isNotNull(), F.struct(*side, *(F.col(f"{p}_in_{g}").alias(f"{p}_in") for p in valued)))).over(w.rangeBetween(g, g)) for g in gaps}
    each = ends.withColumns(at).where("label IS NOT NULL")
    found = F.filter(F.array(*(F.struct(F.lit(g).alias("gap"), F.col(f"at_{g}").alias("j"), *(F.col(f"{p}_out_{g}").alias(f"{p}_out") for p in valued)) for g in gaps)), lambda x: x["j"].isNotNull())
    pairs = each.select("session_id", "idx", *side, "sw", "nav", "clip", F.explode(found).alias("p"))
    other = lambda x: F.col(f"p.j.{x}")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    alike = lambda x: one(F.col(x) == other(x))
    both = lambda x: one(F.col(x).isNotNull() & other(x).isNotNull())
    inside = lambda x, flag: other(x) - F.col(x) + F.coalesce(F.col(flag), F.lit(False)).cast("long")  # noqa: E731  a pair's first event is inside it
    distinct = lambda p: other(f"{p}_in") - F.col(f"p.{p}_out")
    apart = other("timestamp_ms") - F.col("timestamp_ms")
    same = F.col("label") == other("label")
    # the ends are among the places, so what is more than their own labels is other work
    works = distinct("l") > F.when(same, 1).otherwise(2)
    return pairs.select(
        "session_id", F.col("idx").alias("i"), (F.col("idx") + F.col("p.gap")).alias("j"), apart.alias("apart_ms"), works.alias("other_work"), same.alias("same"),
        F.log1p(F.greatest(apart, F.lit(0)).cast("double")).alias("log1p_delta_t_ms"), F.col("p.gap").cast("double").alias("index_gap"),
        alike("application").alias("same_application"), alike("window_title").alias("same_window_title"), alike("browser_domain").alias("same_browser_domain"), both("browser_domain").alias("both_domains_known"),
        alike("tab").alias("same_tab_id"), both("tab").alias("both_tabs_known"), alike("event_type").alias("same_event_type"), alike("chunk_id").alias("same_chunk"),
        inside("s", "sw").cast("double").alias("n_app_switches_between"), one(inside("v", "nav") > 0).alias("any_navigation_between"), one(inside("c", "clip") > 0).alias("any_clipboard_between"), distinct("a").cast("double").alias("n_distinct_apps_between"),
    ).select("session_id", "i", "j", "apart_ms", "other_work", "same", *DISTANCE, *LINKING)


# --- predictions ------------------------------------------------------------------------------------------------------------


def baseline_predictions(rows: DataFrame, label: str, fold: str, key: Column) -> DataFrame:
    """Rows (all columns) by model: ``majority`` predicts the commonest label of the other folds (ties: the least), ``stratified``
    draws one by its share in them, by 28 bits of the MD5 of a key. From the counts by fold and label, total less own."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(fold).alias("_f"), F.col(label).alias("_l")).agg(F.count("*").alias("n"))
    folds, labels = counts.select("_f").distinct(), counts.groupBy("_l").agg(F.sum("n").alias("all"))
    rest = folds.crossJoin(labels).join(counts, ["_f", "_l"], "left").select("_f", "_l", (F.col("all") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")  # folds x labels
    w = Window.partitionBy("_f").orderBy("_l")
    spans = rest.select("_f", "_l", "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("lo"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hi"), F.sum("n").over(Window.partitionBy("_f")).alias("t"))
    first = rest.withColumn("r", F.row_number().over(Window.partitionBy("_f").orderBy(F.desc("n"), "_l"))).where("r = 1").select("_f", F.col("_l").alias("predicted"))
    most = rows.join(F.broadcast(first), rows[fold] == first["_f"], "left").drop("_f").withColumn("model", F.lit("majority"))  # one row a fold
    drawn = rows.withColumn("_u", F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long") / (1 << 28))
    at = F.col("_u") * F.col("t")
    by_share = drawn.join(F.broadcast(spans), (drawn[fold] == spans["_f"]) & (at >= F.coalesce("lo", F.lit(0))) & (at < F.col("hi")), "left")  # folds x labels
    by_share = by_share.select(*rows.columns, F.col("_l").alias("predicted"), F.lit("stratified").alias("model"))
    return most.select(*rows.columns, "predicted", "model").unionByName(by_share)


def _balanced(counts: Mapping, column: str) -> Column:
    """The weight of a row's class: all rows over classes times its own."""
    total, out = sum(counts.values()), F.lit(1.0)
    for value, n in counts.items():
        out = F.when(F.col(column) == value, F.lit(total / (len(counts) * n))).otherwise(out)
    return out


def logistic(balanced: bool = False, cost: float = 1.0, rounds: int = 200) -> Callable:
    """Logistic regression with a penalty of 1 / (2 cost) on the coefficients of the standardised columns."""

    def fit(train: DataFrame, counts: Mapping):
        from pyspark.ml.classification import LogisticRegression

        weighted = train.withColumn("_w", _balanced(counts, "_y") if balanced else F.lit(1.0))
        return LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r", regParam=1 / (cost * max(1, sum(counts.values()))), standardization=True, maxIter=rounds).fit(weighted)

    return fit


#: Rows of a cell that a forest's draws take one by one; those of larger cells are drawn as this many pieces of equal weight.
PIECES = 8


def forest(balanced: bool = False, trees: int = 100, depth: int = 10, seed: int = 0) -> Callable:
    """A forest over rows, or over cells of ``n`` rows each (see ``alike``)."""

    def fit(train: DataFrame, counts: Mapping):
        from pyspark.ml.classification import RandomForestClassifier

        weight = _balanced(counts, "_y") if balanced else F.lit(1.0)
        if "n" in train.columns:
            train = train.groupBy("_x", "_y").agg(F.sum("n").alias("n"))  # cells of several folds or strata
            pieces = F.least("n", F.lit(PIECES))
            train = train.withColumns({"_each": F.col("n") / pieces, "_piece": F.explode(F.sequence(F.lit(1).cast("long"), pieces))})
            weight = weight * F.col("_each")
        weighted = train.withColumn("_w", weight)
        return RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r", numTrees=trees, maxDepth=depth, seed=seed).fit(weighted)

    return fit


def _number(table: DataFrame) -> Column:
    """How many rows each row of the table stands for."""
    return F.sum("n") if "n" in table.columns else F.count("*")


def alike(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], steps: Mapping[str, float] | None = None) -> DataFrame:
    """(keys, columns, n): one row, a cell, for all rows with the same keys and columns; a null column is 0. Columns in ``steps`` are first put in the middle of their
    step: a forest sees a column only in bins (32 of Spark's), so steps about as fine as its bins leave it about what it had. Cells grow with the
    combinations of values that occur, not with rows."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    value |= {c: (F.floor(value[c] / step) + 0.5) * step for c, step in (steps or {}).items() if c in value}
    return rows.groupBy(*keys, *(v.alias(c) for c, v in value.items())).agg(_number(rows).alias("n"))


def cells(rows: DataFrame, columns: Sequence[str], label: str, keys: Sequence[str]) -> tuple[DataFrame, list]:
    """As ``ready``, of cells: (written table: keys, _x, _label, _y, fold, n; labels). rows: as from ``alike``, with label, fold and keys among its keys; cells that are one in these columns are put together."""
    from pyspark.ml.feature import VectorAssembler

    same = alike(rows.where(F.col(label).isNotNull()), columns, list(dict.fromkeys(["fold", label, *keys])))
    named = same.select(*keys, F.col(label).alias("_label"), "fold", "n", *(F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)))
    return _numbered_labels(written(VectorAssembler(inputCols=[f"_c{i}" for i in range(len(columns))], outputCol="_x").transform(named).select(*keys, "_label", "fold", "n", "_x"), "cells"))


def _numbered_labels(table: DataFrame) -> tuple[DataFrame, list]:
    labels = sorted(r[0] for r in table.select("_label").distinct().collect())
    number = F.lit(None).cast("double")
    for i, v in enumerate(labels):
        number = F.when(F.col("_label") == F.lit(v), float(i)).otherwise(number)
    return table.withColumn("_y", number), labels


def ready(rows: DataFrame, columns: Sequence[str], label: str, group: str, folds: int, keys: Sequence[str]) -> tuple[DataFrame, list]:
    """(written table: keys, _x, _label, _y, fold; labels in the order of their numbers). Rows without a label are left out; a null
    column counts as 0. As many labels come to the driver as there are classes."""
    from pyspark.ml.feature import VectorAssembler

    filled = rows.where(F.col(label).isNotNull()).select(*keys, F.col(label).alias("_label"), group_fold(F.col(group).cast("string"), folds).alias("fold"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_c{i}") for i, c in enumerate(columns)))
    vectors = VectorAssembler(inputCols=[f"_c{i}" for i in range(len(columns))], outputCol="_x").transform(filled).select(*keys, "_label", "fold", "_x")
    return _numbered_labels(written(vectors, "vectors"))


def predictions(table: DataFrame, labels: Sequence, models: Mapping[str, Callable], folds: int, keys: Sequence[str], parallel: int = 4) -> DataFrame:
    """(keys, fold, truth, model, predicted, score) of every row, by models that have not seen its fold. score is the chance of the
    last label. Where the other folds hold one label, it is predicted; where they hold none, the prediction is null. Cells (see ``cells``) keep their n."""
    from pyspark.ml.functions import vector_to_array

    counts = {(r["fold"], r["_y"]): r["k"] for r in table.groupBy("fold", "_y").agg(_number(table).alias("k")).collect()}
    own_n = ["n"] if "n" in table.columns else []
    names = F.array(*map(F.lit, labels)) if labels else None

    def one(job: tuple[str, int]) -> DataFrame:
        model, k = job
        own, train = table.where(F.col("fold") == k), table.where(F.col("fold") != k)
        seen = {y: sum(n for (f, v), n in counts.items() if v == y and f != k) for y in range(len(labels))}
        seen = {float(y): n for y, n in seen.items() if n}
        base = [*keys, *own_n, "fold", F.col("_label").alias("truth"), F.lit(model).alias("model")]
        if len(seen) < 2:
            only = next(iter(seen), None)
            told = F.lit(labels[int(only)] if only is not None else None).cast(table.schema["_label"].dataType)
            return own.select(*base, told.alias("predicted"), F.lit(None if only is None else float(only == len(labels) - 1)).cast("double").alias("score"))
        found = models[model](train, seen).transform(own)
        chance = vector_to_array("_q")
        last = F.when(F.size(chance) == len(labels), F.element_at(chance, -1)).otherwise(F.lit(0.0))
        return found.select(*base, F.element_at(names, F.col("_p").cast("int") + 1).alias("predicted"), last.alias("score"))

    jobs = [(m, k) for m in models for k in range(folds) if any(f == k for f, _ in counts)]
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(one, jobs))
    if not parts:
        return table.select(*keys, *own_n, "fold", F.col("_label").alias("truth"), F.lit("").alias("model"), F.col("_label").alias("predicted"), F.lit(0.0).alias("score")).where("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importances(table: DataFrame, columns: Sequence[str], trees: int = 100, depth: int = 10, balanced: bool = False, seed: int = 0) -> DataFrame:
    """(feature, importance, rank) of a forest over all rows or cells."""
    counts = {r["_y"]: r["k"] for r in table.groupBy("_y").agg(_number(table).alias("k")).collect()}
    values = [float(x) for x in forest(balanced, trees, depth, seed)(table, counts).featureImportances.toArray()] if len(counts) > 1 else [0.0] * len(columns)
    order = sorted(range(len(columns)), key=lambda i: (-values[i], columns[i]))
    return table.sparkSession.createDataFrame([(columns[i], values[i], k + 1) for k, i in enumerate(order)], "feature string, importance double, rank int")


# --- reports ----------------------------------------------------------------------------------------------------------------


def class_report(predicted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, label, precision, recall, f1, support): zero where there is nothing to divide by. Labels that are only predicted have support 0.
    One pass: each row counts for its truth and, where wrong, for what was predicted."""
    hit = F.col("truth").eqNullSafe(F.col("predicted"))
    sides = F.array(F.struct(F.col("truth").alias("label"), hit.alias("tp"), F.lit(False).alias("fp"), (~hit).alias("fn")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("tp"), F.lit(True).alias("fp"), F.lit(False).alias("fn")))
    each = predicted.select(*by, F.explode(F.when(hit, F.slice(sides, 1, 1)).otherwise(sides)).alias("x")).where("x.label IS NOT NULL")
    counts = each.groupBy(*by, F.col("x.label").alias("label")).agg(*(F.count_if(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.select(*by, "label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"), "tp")


def overall(report: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, accuracy, macro_f1, weighted_f1) from a class report."""
    n = F.sum("support")
    return report.groupBy(*by).agg(n.alias("n"), F.try_divide(F.sum("tp"), n).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"))


def confusion(predicted: DataFrame, by: Sequence[str]) -> DataFrame:
    return predicted.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))


def link_report(scored: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(by, n, positive_rate, roc_auc, pr_auc, precision, recall, f1) of scored pairs: columns truth (boolean) and score, and n where a row stands for
    that many pairs. All from the counts at each distinct score, summed once from the highest down."""
    t, n = F.col("truth"), F.col("n") if "n" in scored.columns else F.lit(1)
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    each = scored.groupBy(*by, "score").agg(F.sum(n).cast("long").alias("k"), count(t).alias("pos"), count(~t).alias("neg"))
    said = F.col("score") >= threshold
    base = each.groupBy(*by).agg(F.sum("k").alias("n"), F.try_divide(F.sum("pos"), F.sum("pos") + F.sum("neg")).alias("positive_rate"), *(F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).alias(k) for k, c, v in (("tp", said, "pos"), ("fp", said, "neg"), ("fn", ~said, "pos"))))
    base = base.withColumns(ev._prf(F.col("tp"), F.col("fp"), F.col("fn")))
    summed = ev.running_sums(each.where("score IS NOT NULL"), by, "score", {"_tp": "pos", "_fp": "neg"}, descending=True)
    above = F.sum(F.col("pos") * (F.col("_fp") - F.col("neg") / 2))
    part = F.sum(F.col("pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp")))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    curves = summed.groupBy(*by).agg(F.when(F.count("*") > 1, F.try_divide(pairs - above, pairs)).alias("roc_auc"), F.try_divide(part, F.sum("pos")).alias("pr_auc"))
    return base.join(curves, list(by), "left").select(*by, "n", "positive_rate", "roc_auc", "pr_auc", "precision", "recall", "f1")
