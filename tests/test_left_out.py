"""Models that leave out one group each, fitted together, against separate fits."""

import numpy as np
import pytest

from worktrace.operators.left_out import left_out_scores


def _alone(x, y, cost=1.0):
    """A balanced regression on standardised columns by Newton's steps."""
    mean, dev = x.mean(0), x.std(0)
    dev = np.where(dev > 1e-9, dev, 1)
    z = np.column_stack(((x - mean) / dev, np.ones(len(x))))
    w, beta, ridge = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum())), np.zeros(x.shape[1] + 1), np.diag([1 / cost] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    return lambda t: 1 / (1 + np.exp(-np.column_stack(((t - mean) / dev, np.ones(len(t)))) @ beta))


@pytest.mark.parametrize("at_once", [256, 3])
def test_scores_equal_separate_fits(spark, monkeypatch, at_once):
    monkeypatch.setattr("worktrace.operators.left_out.FOLDS_AT_ONCE", at_once)
    rng = np.random.default_rng(6)
    n = 700
    group = np.concatenate((rng.integers(0, 20, n - 250), np.full(250, 20)))  # one holds a third of all rows
    x = rng.normal(size=(n, 3)) * [1, 40, 0.01] + [0, 300, 1] + 0.3 * rng.normal(size=(21, 3))[group]
    x[:, 2] = np.where(group == 7, x[:, 2], 1.0)  # constant where group 7 is left out
    y = rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.04 * (x[:, 1] - 300) + (group == 20))))
    data = [(f"u{g}", i, *map(float, r), bool(t)) for i, (g, r, t) in enumerate(zip(group, x, y, strict=True))]
    rows = spark.createDataFrame(data, "session_id string, idx long, a double, b double, c double, is_boundary boolean").repartition(5)
    got = {r.idx: r.score for r in left_out_scores(rows, ["a", "b", "c"], "is_boundary", "session_id").collect()}
    assert len(got) == n
    for g in range(21):
        own = np.flatnonzero(group == g)
        want = _alone(x[group != g], y[group != g])(x[own])
        assert [got[i] for i in own] == pytest.approx(want, abs=1e-6)


def test_small_groups_are_fitted_where_their_rows_are(spark, monkeypatch):
    """Of 600 groups none needs a pass over all rows, whatever rows a task takes at once, and each equals a separate fit; a group of half the rows does."""
    from worktrace.operators import left_out

    asked = []
    models = left_out._models
    monkeypatch.setattr(left_out, "_models", lambda labelled, names, groups, *more: asked.append(groups) or models(labelled, names, groups, *more))
    monkeypatch.setattr(left_out, "ROWS_AT_ONCE", 1000)
    rng = np.random.default_rng(11)
    group = np.repeat(np.arange(600), 20)
    x = rng.normal(size=(len(group), 2)) * [1, 40] + 0.2 * rng.normal(size=(600, 2))[group]
    y = rng.random(len(group)) < 1 / (1 + np.exp(-(x[:, 0] - 0.02 * x[:, 1] - 1)))
    data = [(f"u{g}", i, *map(float, r), bool(t)) for i, (g, r, t) in enumerate(zip(group, x, y, strict=True))]
    schema = "session_id string, idx long, a double, b double, is_boundary boolean"
    got = {r.idx: r.score for r in left_out_scores(spark.createDataFrame(data, schema).repartition(5), ["a", "b"], "is_boundary", "session_id").collect()}
    assert asked == [[]] and len(got) == len(group)
    for g in range(0, 600, 40):
        own = np.flatnonzero(group == g)
        assert [got[i] for i in own] == pytest.approx(_alone(x[group != g], y[group != g])(x[own]), abs=1e-6)
    asked.clear()
    data = [("half" if i % 2 else u, i, a, b, t) for u, i, a, b, t in data]
    assert left_out_scores(spark.createDataFrame(data, schema).repartition(5), ["a", "b"], "is_boundary", "session_id").count() == len(group)
    assert "half" in asked[-1] and len(asked[-1]) < 30


def test_few_labels(spark):
    rows = [("u1", 1, 0.5, True), ("u1", 2, None, None), ("u2", 3, 0.1, True), ("u2", 4, 0.2, None), (None, 5, 0.3, True)]
    table = spark.createDataFrame(rows, "session_id string, idx long, a double, y boolean")
    got = left_out_scores(table, ["a"], "y", "session_id").collect()
    assert {r.idx: r.score for r in got} == {i: 1.0 for i in range(1, 6)}
    alone = left_out_scores(table.where("session_id = 'u1'"), ["a"], "y", "session_id").collect()
    assert [r.score for r in alone] == [None, None]
    assert left_out_scores(table.where("false"), ["a"], "y", "session_id").count() == 0
