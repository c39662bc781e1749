"""Feature sets: baselines from the other folds, against plain Python, and a set that helps."""

import hashlib
import random
import statistics

import pytest

from worktrace.operators import feature_sets as fs


def _fold(s, folds):
    return int(hashlib.md5(s.encode()).hexdigest()[:7], 16) % folds


def test_baselines_come_from_other_folds(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 14}", rng.choice(["p", "q"]) if i % 14 else "rare", round(rng.gauss(5, 2), 1) if i % 31 else None) for i in range(400)]
    table = spark.createDataFrame(rows, "session_id string, operator string, log1p_delta_t_ms double").repartition(3)
    got = fs.fold_baselines(table, 3, 60)
    found = {(r.fold, r.operator): r for r in got.collect()}
    want = {}
    for k in range(3):
        rest = [(o, g) for s, o, g in rows if g is not None and _fold(s, 3) != k]
        med = lambda v: (statistics.median(v), statistics.median([abs(x - statistics.median(v)) for x in v]))
        every = med([g for _, g in rest])
        for o in {o for o, _ in rest} | {None}:
            own = [g for p, g in rest if o in (None, p)]
            few = o is None or len(own) < 60
            want[k, o] = (len(own), *(every if few else med(own)), "all" if few else "operator")
    assert found.keys() == want.keys() and {v[3] for v in want.values()} == {"all", "operator"}
    for key, w in want.items():
        r = found[key]
        assert (r.n, r.centre, r.spread, r.source) == pytest.approx(w)
    placed = fs.with_z(table, got, 3).collect()
    assert len(placed) == 1200
    for r in placed:
        n, m, d, _ = want.get((r["at"], r.operator)) or want[r["at"], None]
        assert r.fold == _fold(r.session_id, 3)
        assert r.z_log_gap == pytest.approx(0.0 if r.log1p_delta_t_ms is None else (r.log1p_delta_t_ms - m) / d)


def test_a_column_that_tells_passes_the_gate(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        y = rng.random() < 0.25
        rows.append((f"s{i % 23}", i, rng.choice("pq"), rng.gauss(3, 1), rng.gauss(0.3 * y, 1), rng.gauss(3.0 * y, 0.6), y))
    table = spark.createDataFrame(rows, "session_id string, idx long, operator string, log1p_delta_t_ms double, weak double, telling double, y boolean").repartition(4)
    spread = fs.with_z(table, fs.fold_baselines(table, 3, 10), 3)
    sets = {"M1": ["weak"], "M2": ["weak", "telling"]}
    scores = fs.set_scores(spread, sets, "y", ["session_id", "idx"], 3)
    assert scores.groupBy("set").count().select("count").distinct().collect()[0][0] == 900
    found = {(r["set"], r.protocol): r for r in fs.compared_sets(scores, scores, ["session_id", "idx"], "M1", (0.5, 0.5), 0.02).collect()}
    assert len(found) == 4
    assert all(found["M2", p].passed and found["M2", p].f1 > 0.9 for p in ("matched", "locked"))
    assert not any(found["M1", p].passed or found["M1", p].gain for p in ("matched", "locked"))
    one = found["M2", "locked"]
    score = {(r.session_id, r.idx): r.score for r in scores.where("set = 'M2'").collect()}
    said = {(s, i): score[s, i] >= 0.5 for s, i, *_ in rows}
    assert one.tp == sum(said[s, i] and y for s, i, *_, y in rows) and one.fp == sum(said[s, i] and not y for s, i, *_, y in rows)


def test_medians_by_running_counts_hold_no_keys_values(spark, monkeypatch):
    """Exact medians of rows that stand for several, null keys too; neither query plan merges the values of a key in one task."""
    import random
    import statistics

    from worktrace.operators import feature_sets as fs

    rng = random.Random(2)
    rows = [(f, o, round(rng.uniform(0, 9), rng.choice([0, 5])), rng.randint(1, 4)) for f in (0, 1) for o in ("a", None) for _ in range(rng.choice([40, 41]))] + [(2, "one", 3.5, 2), (2, "two", 0.0, 1), (2, "two", 1.0, 1)]
    got = fs.weighted_medians(spark.createDataFrame(rows, "fold int, operator string, g double, c long").repartition(3), ["fold", "operator"], "g", "c")
    want: dict = {}
    for f, o, g, c in rows:
        want.setdefault((f, o), []).extend([g] * c)
    assert {(r.fold, r.operator): (r.median, r.n) for r in got.collect()} == {k: (statistics.median(v), len(v)) for k, v in want.items()}
    gaps = spark.createDataFrame([(f"s{i % 9}", f"op{i % 2}", float(i % 7)) for i in range(90)], "session_id string, operator string, log1p_delta_t_ms double")
    plans, written = [], fs.written
    monkeypatch.setattr(fs, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, name))
    plans.append(fs.fold_baselines(gaps, 3, 5)._jdf.queryExecution().optimizedPlan().toString())
    assert plans and not any("percentile" in p for p in plans)
