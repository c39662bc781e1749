"""Regressions and forests of all sets and folds in common passes."""

import random

from pyspark.sql import functions as F

from worktrace.operators import classes as cl
from worktrace.operators import supervised as sv


def test_planted_classes_are_found_and_passes_do_not_grow_with_fits(spark, monkeypatch):
    """Failed before: every fit had passes of its own."""
    rng, passes, real = random.Random(8), [], cl._gradients
    monkeypatch.setattr(cl, "_gradients", lambda *a: passes.append(len(a[3])) or real(*a))
    data = [(i, f"g{i % 12}", y, rng.gauss("abc".index(y), 0.7), rng.gauss(0, 1) if i % 40 else None) for i in range(600) for y in [rng.choice("abc")]]
    rows = spark.createDataFrame(data, "id long, grp string, label string, x double, z double")
    got = cl.class_predictions(rows, {"one": ["x"], "two": ["x", "z"]}, "label", "grp", 3, ["id"], trees=9, depth=4).collect()
    assert len(got) == 2400 and len(passes) < 60 and max(passes) == 6
    hits = {(v, m): sum(r.predicted == r.truth for r in got if (r.variant, r.model) == (v, m)) for v in ("one", "two") for m in ("logistic_regression", "random_forest")}
    assert len(hits) == 4 and min(hits.values()) > 330
    held, labels = sv.ready(rows, ["x", "z"], "label", "grp", 3, ["id"])
    want = {r.id: r.score for r in sv.predictions(held, labels, {"lr": sv.logistic()}, 3, ["id"]).collect()}
    assert max(abs(want[r.id] - r.score) for r in got if (r.variant, r.model) == ("two", "logistic_regression")) < 2e-3


def test_one_label_is_predicted(spark):
    rows = spark.range(40).select("id", F.col("id").cast("string").alias("grp"), F.lit("a").alias("label"), F.rand(1).alias("x"))
    got = cl.class_predictions(rows, {"one": ["x"]}, "label", "grp", 3, ["id"], trees=2, depth=2).collect()
    assert len(got) == 80 and {(r.predicted, r.score) for r in got} == {("a", 1.0)}
