"""Supervised models by group folds: vectors, predictions of unseen groups, reports, against plain Python and planted signals."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from worktrace.operators import supervised as sv


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for s, n in (("long", 160), ("short", 4), ("one", 1)):
        for i in range(n):
            pick = lambda *v: rng.choice([*v, None])
            rows.append((s, i, 1000 * i + rng.randrange(900), pick("A", "B"), pick("t1", "t2", "t3"), pick("d1"), pick("x", "y"), rng.choice(["view", "click", "purchase"]), f"c{i // 50}", pick("p", "q", "r")))
    cols = "session_id string, idx long, timestamp_ms long, application string, window_title string, browser_domain string, tab string, event_type string, chunk_id string, case_id string"
    names = [c.split()[0] for c in cols.split(", ")]
    at = {(r[0], r[1]): dict(zip(names, r, strict=True)) for r in rows}
    gaps, want = [1, 2, 7, 30], {}
    for (s, i), a in at.items():
        for g in gaps:
            b = at.get((s, i + g))
            if not b or a["case_id"] is None or b["case_id"] is None:
                continue
            inside = [at[s, k] for k in range(i, i + g + 1)]
            same = lambda c: float(a[c] is not None and a[c] == b[c])  # noqa: B023, E731
            both = lambda c: float(a[c] is not None and b[c] is not None)  # noqa: B023, E731
            switched = sum(at[s, k]["application"] != at[s, k - 1]["application"] for k in range(max(i, 1), i + g + 1))
            apart = b["timestamp_ms"] - a["timestamp_ms"]
            want[s, i, i + g] = {
                "apart_ms": apart, "other_work": bool({x["case_id"] for x in inside} - {a["case_id"], b["case_id"], None}), "same": a["case_id"] == b["case_id"],
                "log1p_delta_t_ms": math.log1p(apart), "index_gap": g, "n_app_switches_between": switched, "n_distinct_apps_between": len({x["application"] for x in inside} - {None}),
                "any_navigation_between": float(any(x["event_type"] == "view" for x in inside)), "any_clipboard_between": float(any(x["event_type"] == "purchase" for x in inside)),
                "same_application": same("application"), "same_window_title": same("window_title"), "same_browser_domain": same("browser_domain"), "both_domains_known": both("browser_domain"),
                "same_tab_id": same("tab"), "both_tabs_known": both("tab"), "same_event_type": same("event_type"), "same_chunk": same("chunk_id"),
            }
    table = spark.createDataFrame(rows, cols).repartition(4)
    got = {(r.session_id, r.i, r.j): r.asDict() for r in sv.pair_vectors(table, "case_id", gaps, F.col("event_type") == "view", F.col("event_type") == "purchase", F.col("tab")).collect()}
    assert got.keys() == want.keys() and len(got) > 150
    assert any(w["other_work"] for w in want.values())
    for key, w in want.items():
        assert {c: got[key][c] for c in w} == pytest.approx(w)


def _planted(spark, n=600):
    """Class from two columns, a third that says nothing; 12 groups."""
    rng = random.Random(8)
    rows = []
    for i in range(n):
        label = rng.choice("abc")
        rows.append((i, f"g{i % 12}", label, rng.gauss("abc".index(label) * 3, 0.5), rng.gauss(0, 1), (rng.gauss(0, 1) if i % 40 else None)))
    return spark.createDataFrame(rows, "id long, grp string, label string, x double, y double, z double")


def test_models_find_a_planted_class_and_do_not_see_the_own_group(spark):
    rows = _planted(spark)
    models = {"lr": sv.logistic(), "rf": sv.forest(trees=15, depth=5)}

    def run(table):
        held, labels = sv.ready(table, ["x", "y", "z"], "label", "grp", 4, ["id", "grp"])
        assert labels == ["a", "b", "c"]
        return sv.predictions(held, labels, models, 4, ["id", "grp"]).collect(), held

    first, held = run(rows)
    assert Counter(r.model for r in first) == {"lr": 600, "rf": 600}
    assert all(sum(r.predicted == r.truth for r in first if r.model == m) > 570 for m in models)
    assert len({(r.grp, r.fold) for r in first}) == 12
    own = next(r.fold for r in first if r.grp == "g3")
    turned, _ = run(rows.withColumn("label", F.when(F.col("grp") == "g3", F.lit("a")).otherwise(F.col("label"))))
    score = lambda rs: {(r.id, r.model): r.score for r in rs if r.fold == own and r.model == "lr"}  # noqa: E731  a forest's draws depend on the order of rows
    assert score(turned) == pytest.approx(score(first), abs=1e-6)
    best = sv.importances(held, ["x", "y", "z"], trees=15, depth=5).collect()
    assert [r.feature for r in best if r["rank"] == 1] == ["x"] and sum(r.importance for r in best) == pytest.approx(1)


def test_one_class_or_no_rows(spark):
    rows = _planted(spark, 60).withColumn("label", F.lit("a"))
    held, labels = sv.ready(rows, ["x"], "label", "grp", 3, ["id"])
    got = sv.predictions(held, labels, {"lr": sv.logistic()}, 3, ["id"]).collect()
    assert len(got) == 60 and {(r.predicted, r.score) for r in got} == {("a", 1.0)}
    none, labels = sv.ready(rows.where("false"), ["x"], "label", "grp", 3, ["id"])
    assert labels == [] and sv.predictions(none, labels, {"lr": sv.logistic()}, 3, ["id"]).count() == 0


def test_reports_equal_plain_counts(spark):
    rng = random.Random(1)
    data = [("m", rng.choice("abc"), rng.choice(["a", "b", "d", None])) for _ in range(300)]
    rows = spark.createDataFrame(data, "model string, truth string, predicted string").repartition(3)
    report = {r.label: r for r in sv.class_report(rows, ["model"]).collect()}
    assert report.keys() == set("abcd")
    f1s = {}
    for k, r in report.items():
        tp = sum(t == k == p for _, t, p in data)
        said, true = sum(p == k for _, _, p in data), sum(t == k for _, t, _ in data)
        f1s[k] = 2 * tp / (said + true)
        assert (r.precision, r.recall, r.f1, r.support) == pytest.approx((tp / said if said else 0, tp / true if true else 0, f1s[k], true))
    one = sv.overall(sv.class_report(rows, ["model"]), ["model"]).first()
    hits = sum(t == p for _, t, p in data)
    assert (one.n, one.accuracy, one.macro_f1) == pytest.approx((300, hits / 300, sum(f1s.values()) / 4))
    assert one.weighted_f1 == pytest.approx(sum(f1s[k] * sum(t == k for _, t, _ in data) for k in f1s) / 300)
    table = {(r.truth, r.predicted): r.n for r in sv.confusion(rows, ["model"]).collect()}
    assert table == Counter((t, p) for _, t, p in data)


def test_link_report_equals_plain_counts(spark):
    rng = random.Random(2)
    data = [("m", rng.random() < 0.3, round(rng.random(), 2)) for _ in range(200)]
    r = sv.link_report(spark.createDataFrame(data, "model string, truth boolean, score double"), ["model"]).first()
    pos, neg = [s for _, t, s in data if t], [s for _, t, s in data if not t]
    assert r.roc_auc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
    ap = sum(sum(p == c for p in pos) * sum(p >= c for p in pos) / sum(s >= c for _, _, s in data) for c in {s for _, _, s in data}) / len(pos)
    tp, fp = sum(p >= 0.5 for p in pos), sum(q >= 0.5 for q in neg)
    assert (r.n, r.positive_rate, r.pr_auc, r.precision, r.recall) == pytest.approx((200, len(pos) / 200, ap, tp / (tp + fp), tp / len(pos)))


def test_baselines_by_hand(spark):
    rows = spark.createDataFrame([(i, "abbbc"[i % 5], i % 3) for i in range(60)], "id long, truth string, fold int")
    got = sv.baseline_predictions(rows, "truth", "fold", F.col("id").cast("string")).collect()
    assert {r.predicted for r in got if r.model == "majority"} == {"b"}
    drawn = Counter(r.predicted for r in got if r.model == "stratified")
    assert sum(drawn.values()) == 60 and drawn["b"] > drawn["a"] and drawn.keys() <= set("abc")


def test_pairs_take_one_shuffle_and_hold_where_places_are_missing(spark):
    import random

    from pyspark.sql import functions as F

    from worktrace.operators import supervised

    rng = random.Random(3)
    schema = "session_id string, idx long, timestamp_ms long, application string, window_title string, browser_domain string, url string, event_type string, chunk_id string, case_id string"
    data = [(u, i, 1000 * i, rng.choice(["a", "b", "c", None]), "t", None, None, rng.choice(["view", "purchase"]), "d", rng.choice(["x", "y", "z", None])) for u in ("u1", "u2") for i in range(60) if rng.random() < 0.8]
    events = spark.createDataFrame(data, schema)
    df = supervised.pair_vectors(events, "case_id", [1, 2, 5, 10], F.col("event_type") == "view", F.col("event_type") == "purchase", F.col("url"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.session_id, r.i, r.j): (r.n_distinct_apps_between, r.other_work, r.same) for r in df.collect()}
    want = {}
    for u, i, *_, case in data:
        for v, j, *_, other in data:
            if u == v and j - i in (1, 2, 5, 10) and case and other:
                between = [r for r in data if r[0] == u and i <= r[1] <= j]
                want[u, i, j] = (float(len({r[3] for r in between} - {None})), bool({r[9] for r in between} - {None, case, other}), case == other)
    assert got == want and len(want) > 100


def test_cells_give_the_forest_what_the_rows_give(spark):
    rng = random.Random(12)
    data = [(i, f"g{i % 12}", y, float(int(rng.gauss(2 * y, 1) * 2)), float(rng.randrange(3))) for i in range(1500) for y in [rng.random() < 0.4]]
    rows = spark.createDataFrame(data, "id long, grp string, label boolean, x double, z double").withColumn("fold", sv.group_fold(F.col("grp"), 3))
    held, labels = sv.cells(sv.alike(rows, ["x", "z"], ["fold", "label"], {"x": 0.5}), ["x", "z"], "label", [])
    assert held.agg(F.sum("n")).first()[0] == 1500 and held.count() < 200  # each pair was a row of every forest
    got = sv.predictions(held, labels, {"rf": sv.forest(balanced=True, trees=15, depth=5)}, 3, [])
    plain, labels = sv.ready(rows, ["x", "z"], "label", "grp", 3, ["id"])
    want = sv.predictions(plain, labels, {"rf": sv.forest(balanced=True, trees=15, depth=5)}, 3, ["id"])
    a, b = (sv.link_report(p, ["model"]).first() for p in (got, want))
    assert (a.n, a.positive_rate) == pytest.approx((b.n, b.positive_rate)) and a.n == 1500
    assert (a.roc_auc, a.pr_auc, a.f1) == pytest.approx((b.roc_auc, b.pr_auc, b.f1), abs=0.03)
    assert a.roc_auc > 0.8
    once = sv.link_report(got.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n", "copy"), ["model"]).first()
    assert list(once)[1:] == pytest.approx(list(a)[1:])
    best = sv.importances(held, ["x", "z"], trees=15, depth=5, balanced=True).collect()
    assert [r.feature for r in best] == ["x", "z"]
