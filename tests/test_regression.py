"""Regressions that are fitted together: each equal to Spark's own, one pass a step for all."""

import random

import pytest
from pyspark.sql import functions as F

from worktrace.operators import feature_sets as fs
from worktrace.operators import regression as rg
from worktrace.operators import supervised as sv


def _rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        y = float(rng.random() < 0.2)
        rows.append((i, i % 3, y, rng.gauss(5 + y, 2), 1e4 * rng.gauss(0.3 * y, 1), 7.0))
    return spark.createDataFrame(rows, "id long, fold int, _y double, a double, b double, flat double").repartition(4)


def test_each_fit_equals_sparks(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    table = _rows(spark)
    fits = [rg.Fit(c, k) for c in (("a",), ("a", "b", "flat")) for k in (0, 1, None)]
    for f, (coefficients, intercept) in zip(fits, rg.fitted_together(table, fits), strict=True):
        train = table if f.fold is None else table.where(F.col("fold") != f.fold)
        n = {r["_y"]: r["count"] for r in train.groupBy("_y").count().collect()}
        ready = VectorAssembler(inputCols=list(f.columns), outputCol="x").transform(train.withColumn("w", sv._balanced(n, "_y")))
        want = LogisticRegression(featuresCol="x", labelCol="_y", weightCol="w", regParam=1 / sum(n.values()), maxIter=500, tol=1e-12).fit(ready)
        assert list(coefficients) == pytest.approx(list(want.coefficients), rel=1e-4, abs=1e-9) and intercept == pytest.approx(want.intercept, rel=1e-4)


def test_passes_do_not_grow_with_fits(spark, monkeypatch):
    """Failed before: every set and fold was a fit of its own, with a pass for each of its steps."""
    passes, real = [], rg._sums
    monkeypatch.setattr(rg, "_sums", lambda *a: passes.append(len(a[3])) or real(*a))
    table = _rows(spark).withColumns({"session_id": F.col("id").cast("string"), "y": F.col("_y") == 1})
    scores = fs.set_scores(table, {"one": ["a"], "two": ["a", "b"], "same": ["b"]}, "y", ["id"], 3)
    assert scores.count() == 3600 and passes[0] == 9 and len(passes) < 15


def test_one_label_has_no_model(spark):
    assert rg.fitted_together(_rows(spark).where("_y = 0 OR fold = 1"), [rg.Fit(("a",), 1), rg.Fit(("a",), 0)])[0] is None


def test_a_row_once_equals_a_row_for_every_fold(spark):
    rng = random.Random(6)
    rows = [(f"s{i % 14}", i, rng.choice(["p", "q"]) if i % 14 else "rare", rng.gauss(5, 2) if i % 31 else None, rng.random() < 0.3) for i in range(500)]
    table = spark.createDataFrame(rows, "session_id string, idx long, operator string, log1p_delta_t_ms double, y boolean").repartition(3)
    base, keys = fs.fold_baselines(table, 3, 60), ["session_id", "idx"]
    wide = fs.with_fold_z(table, base, 3)
    assert wide.count() == 500
    long = {(r.session_id, r.idx, r["at"]): r.z_log_gap for r in fs.with_z(table, base, 3).collect()}
    assert {(r.session_id, r.idx, k): r[f"z_log_gap_{k}"] for r in wide.collect() for k in range(3)} == pytest.approx(long)
    sets = {"M": ["log1p_delta_t_ms", "z_log_gap"]}
    score = lambda t: {(r.session_id, r.idx): r.score for r in t.collect()}
    many = score(fs.set_scores(fs.with_z(table, base, 3), sets, "y", keys, 3))
    assert score(fs.set_scores(wide, sets, "y", keys, 3, {"z_log_gap": [f"z_log_gap_{k}" for k in range(3)]})) == pytest.approx(many) and len(many) == 500
