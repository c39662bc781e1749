"""Learning operators without SQL, against brute force and numpy on small rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktrace.operators import learning


def _rows(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 2, 1]
    y = rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - 0.4 * x[:, 1])))
    data = [(f"u{i % 11}", i, *map(float, r), bool(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "session_id string, idx long, a double, b double, c double, is_boundary boolean"), x, y


def test_coefficients_equal_newton_steps(spark):
    rows, x, y = _rows(spark)
    z = (x - x.mean(0)) / x.std(0)
    z1 = np.column_stack((z, np.ones(len(z))))
    w = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    beta, ridge = np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z1 @ beta))
        beta -= np.linalg.solve((z1 * (w * p * (1 - p))[:, None]).T @ z1 + ridge, z1.T @ (w * (p - y)) + ridge @ beta)
    got = {r.feature: (r.coefficient, r["rank"]) for r in learning.importance(rows, ["a", "b", "c"], "is_boundary").collect()}
    assert {f: c for f, (c, _) in got.items()} == pytest.approx(dict(zip("abc", beta, strict=False)), abs=2e-3)
    assert [f for f, _ in sorted(got.items(), key=lambda t: t[1][1])] == sorted("abc", key=lambda f: -abs(got[f][0]))
    parts = {r.idx: (r.part_a, r.part_b, r.part_c) for r in learning.contributions(rows, ["a", "b", "c"], "is_boundary", ["idx"]).collect()}
    for i in (0, 7, 399):
        assert parts[i] == pytest.approx([z[i, k] * got[f][0] for k, f in enumerate("abc")])


def test_scores_do_not_see_the_own_group(spark):
    rows, _, _ = _rows(spark)
    score = lambda r: {x.idx: (x.fold, x.score) for x in learning.held_out_scores(r, ["a", "b", "c"], "is_boundary", "session_id").collect()}
    first = score(rows)
    turned = score(rows.withColumn("is_boundary", F.when(F.col("session_id") == "u3", ~F.col("is_boundary")).otherwise(F.col("is_boundary"))))
    own = first[3][0]
    assert len(first) == 400
    assert all(turned[i][1] == pytest.approx(s, abs=1e-9) for i, (fold, s) in first.items() if fold == own)
    assert any(abs(turned[i][1] - s) > 1e-3 for i, (fold, s) in first.items() if fold != own)


def test_best_cuts_equal_brute_force(spark):
    rng = random.Random(3)
    table, want = [], {}
    for k in range(6):
        values = [rng.choice([0, 0, 5]) + rng.random() for _ in range(24)]
        places = sorted(rng.sample(range(1, 23), 7)) + [23]
        s = q = 0.0
        sums = [(0.0, 0.0, 0)]
        for i, v in enumerate(values):
            s, q = s + v, q + v * v
            if i in places:
                table.append((f"u{k}", i, s, q, i + 1))
                sums.append((s, q, i + 1))
        best = (np.inf, ())
        for m in range(8):
            for inner in itertools.combinations(range(1, len(sums) - 1), m):
                at = [0, *inner, len(sums) - 1]
                cost = sum(sums[j][1] - sums[i][1] - (sums[j][0] - sums[i][0]) ** 2 / (sums[j][2] - sums[i][2]) + 2.0 for i, j in itertools.pairwise(at))
                best = min(best, (cost, tuple(places[i - 1] for i in at[1:])))
        want[f"u{k}"] = best[1]
    got = {}
    for r in learning.best_cuts(spark.createDataFrame(table, "session_id string, place long, s double, q double, n long"), 2.0).collect():
        got.setdefault(r.session_id, []).append(r.place)
    assert {k: tuple(sorted(v)) for k, v in got.items()} == want


def test_hmm_cuts_where_the_regime_changes(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 0.3, 60), rng.normal(6, 0.3, 50), rng.normal(0, 0.3, 40)))
    rows = spark.createDataFrame([(s, i, float(v)) for s in ("u1", "u2") for i, v in enumerate(x)], "session_id string, idx long, gap double")
    got = learning.hmm_boundaries(rows, ["gap"], [2]).where("boundary").collect()
    assert sorted((r.session_id, r.idx) for r in got) == [("u1", 60), ("u1", 110), ("u2", 60), ("u2", 110)]


def test_clusters_find_separate_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(0, 0.05, 2) + [(0, 0), (1, 0), (0, 1)][i % 3])) for i in range(90)]
    got = learning.clusters(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], [3], ["id"]).collect()
    assert len({(r.id % 3, r.cluster) for r in got}) == 3 and all(r.k == 3 for r in got)


def test_sums_over_steps_and_places_equal_plain_ones(spark):
    from worktrace.operators.sequence import numbered, running_sums

    rng = random.Random(5)
    values = sorted({rng.choice([rng.randint(-50, 50), rng.randint(0, 10**9), rng.random()]) for _ in range(300)})
    data = [(k, float(v), rng.randint(0, 9)) for k in "pq" for v in values]
    rows = spark.createDataFrame(data, "k string, v double, n long").repartition(5)
    for down in (False, True):
        for own in (False, True):
            got = {(r.k, r.v): r.s for r in running_sums(rows, ["k"], "v", {"s": "n"}, descending=down, own=own).collect()}
            for k, v, n in data[::17]:
                before = sum(m for kk, w, m in data if kk == k and (w > v if down else w < v))
                assert got[k, v] == before + own * n
    keys = [(rng.choice(["a", "ab", "abcd1", "abcd2", "zzzz"]), i) for i in range(200)]
    placed = numbered(spark.createDataFrame(keys, "key string, i long").repartition(4), "key", ["i"], "place").collect()
    assert [(r.key, r.i) for r in sorted(placed, key=lambda r: r.place)] == sorted(keys)
    assert sorted(r.place for r in placed) == list(range(1, 201))


def _changing(spark, n=300, seed=4):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(3 * (k % 3), 1.0, n // 10) for k in range(10)])
    y = rng.normal(0, 1, n)
    return spark.createDataFrame([(s, 2 * i, float(x[i] + j), float(y[i])) for j, s in enumerate(("u1", "u2")) for i in range(n - 7 * j)], "session_id string, idx long, gap double, pace double").repartition(5)


@pytest.mark.parametrize("most", [37, 100, 150])
def test_a_session_in_pieces_has_the_states_of_one_piece(spark, most):
    rows = _changing(spark)
    whole, pieces = ({(r.session_id, r.k, r.idx): r.boundary for r in learning.hmm_boundaries(rows, ["gap", "pace"], [2, 3], rounds=12, most=m).collect()} for m in (10_000, most))
    assert len(whole) == 2 * (300 + 293) and whole == pieces
    assert 10 < sum(whole.values()) < 200


def test_cuts_of_sessions_solved_together_are_their_own(spark):
    rng = np.random.default_rng(9)
    xs = [rng.normal(rng.integers(0, 4, n), 1.0) for n in [1, 2, 300, *rng.integers(1, 60, 50)]]
    sessions = [(np.cumsum(x), np.cumsum(x * x), np.arange(1.0, len(x) + 1)) for x in xs]
    want = [[learning._cuts(*(np.append(0.0, v) for v in x), p) for p in (0.5, 2.0, 50.0)] for x in sessions]
    assert learning._cuts_together(sessions, [0.5, 2.0, 50.0]) == want
    table = [(f"u{i}", 3 * k, float(s), float(q), int(n)) for i, x in enumerate(sessions) for k, (s, q, n) in enumerate(zip(*x, strict=True))]
    rows = spark.createDataFrame(table, "session_id string, place long, s double, q double, n long").repartition(3)
    for few, at_once in ((256, 100_000), (10, 1)):
        got = learning.best_cuts(rows, [0.5, 2.0, 50.0], few=few, places_at_once=at_once).collect()
        flat = {(f"u{i}", p, 3 * (c - 1)) for i, by in enumerate(want) for p, cuts in zip((0.5, 2.0, 50.0), by, strict=True) for c in cuts}
        assert {tuple(r) for r in got} == flat and len(got) == len(flat)


def test_counts_of_pieces_add_up():
    """Expected counts and likelihood of two halves, with messages over the border, are those of the whole."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2))
    m = learning._Hmm.first(x[:3], x.var(axis=0), 1)
    want, likelihood = m.counts(x, None, np.ones(3))
    b, _ = m.emission(x)
    a = m.start * b[0]
    for t in range(1, 20):
        a = a / a.sum() @ m.step * b[t]
    one, l1 = m.counts(x[:20], None, m.carried(x[20:]) @ np.ones(3))
    two, l2 = m.counts(x[20:], a / a.sum(), np.ones(3))
    assert one + two == pytest.approx(want) and l1 + l2 == pytest.approx(likelihood)
    assert (learning._gaussian_hmm(x, 3, 5, 1) == learning._gaussian_hmm(x, 3, 5, 1)).all()


def test_sessions_fitted_together_have_the_states_of_their_own(spark):
    """Many sessions of many lengths, in step, against one after the other by the model of a single one."""
    rng = np.random.default_rng(8)
    xs = [np.column_stack((rng.normal(3 * (np.arange(n) // 9 % 3), 1.0), rng.normal(size=n))) for n in [1, 5, 6, 7, 400, *rng.integers(1, 90, 60)]]
    want = []
    for x in xs:
        model, last = learning._Hmm.first(x[np.linspace(0, len(x) - 1, 3).astype(int)], x.var(axis=0), 7), -np.inf
        for _ in range(12 if len(x) >= 6 else 0):
            counts, likelihood = model.counts(x, None, np.ones(3))
            model = model.estimated(counts)
            if learning._stands_still(likelihood, last):
                break
            last = likelihood
        want.append(model.states(x, None, None) if len(x) >= 6 else np.zeros(len(x), dtype=int))
    for at_once in (1, 500, 32768):
        got = learning._hmm_states(xs, 3, 12, 7, at_once)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))

    rows = _changing(spark, 300)
    few, many = ({(r.session_id, r.k, r.idx): r.boundary for r in learning.hmm_boundaries(rows, ["gap", "pace"], [2, 3], rounds=12, places_at_once=m).collect()} for m in (1, 10_000))
    assert few == many and len(few) == 2 * (300 + 293)


@pytest.mark.parametrize("most", [5, 25, 1000])
def test_cuts_of_long_sessions_are_those_of_the_whole(spark, most):
    rng = np.random.default_rng(8)
    table, want = [], set()
    for name, n in (("u", 84), ("v", 12), ("w", 1)):
        x = np.concatenate([rng.normal(5 * rng.integers(0, 2), 0.5, 7) for _ in range(12)])[:n]
        s, q = np.cumsum(x), np.cumsum(x * x)
        table += [(name, 3 * i, float(s[i]), float(q[i]), i + 1) for i in range(n)]
        for penalty in (0.5, 2.0, 50.0):
            best = [(0.0, ())]
            for j in range(1, n + 1):
                best.append(min((best[i][0] + ((x[i:j] - x[i:j].mean()) ** 2).sum() + penalty, (*best[i][1], 3 * (j - 1))) for i in range(j)))
            want |= {(name, penalty, p) for p in best[-1][1]}
    rows = spark.createDataFrame(table, "session_id string, place long, s double, q double, n long").repartition(4)
    got = learning.best_cuts(rows, [0.5, 2.0, 50.0], most=most).collect()
    assert len(got) == len(want) and {(r.session_id, r.penalty, r.place) for r in got} == want
    alone = learning.best_cuts(rows, 2.0, most=most).collect()
    assert {(r.session_id, r.place) for r in alone} == {(n, p) for n, c, p in want if c == 2.0}
