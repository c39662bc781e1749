"""Trace similarity with many activities, against plain Python."""

import pytest
from pyspark.sql import functions as F

from worktrace.operators import discovery


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_a_thousand_activities(spark):
    import random

    rng = random.Random(2)
    names = [f"activity {i}" for i in range(1000)]
    traces = sorted({">".join(rng.choice(names[:k]) for _ in range(rng.randint(1, 9))) for k in (3, 30, 1000) for _ in range(12)} | {"activity 3", "activity 259", "activity 515"} | {">".join(names[i : i + 3]) for i in range(0, 999, 3)})
    groups = spark.createDataFrame([("p", t, "dominant" if len(t) < 20 else "other", 1 + i % 3) for i, t in enumerate(traces)], "process_id string, signature string, path_class string, frequency long")
    rows = discovery.similar_pairs(groups).where(F.col("a").isin(traces[::7])).collect()
    assert len(rows) == sum(a <= b for a in traces[::7] for b in traces)
    for r in rows:
        a, b = r.a.split(">"), r.b.split(">")
        assert r.levenshtein == pytest.approx(1 - _edits(a, b) / max(len(a), len(b)))
        assert r.lcs == pytest.approx(2 * _common(a, b) / (len(a) + len(b)))
        assert r.jaccard == pytest.approx(len({*a} & {*b}) / len({*a} | {*b}))


def test_means_count_ordered_pairs_of_executions(spark):
    groups = spark.createDataFrame([("p", "x>y", "dominant", 3), ("p", "x>z", "other", 2), ("q", "x", "dominant", 1)], "process_id string, signature string, path_class string, frequency long")
    got = {(r.process_id, r.class_a, r.class_b): (r.pairs, r.mean_levenshtein) for r in discovery.mean_similarities(discovery.similar_pairs(groups)).collect()}
    assert got == {("p", "dominant", "dominant"): (6, 1.0), ("p", "other", "other"): (2, 1.0), ("p", "dominant", "other"): (12, 0.5), ("q", "dominant", "dominant"): (0, None)}


def test_common_length_of_long_traces():
    import random
    import time

    rng = random.Random(4)
    make = lambda n: "".join(chr(0x100 + rng.randrange(12)) for _ in range(n))
    for n, m in ((0, 5), (1, 1), (63, 64), (65, 130), (500, 480)):
        a, b = make(n), make(m)
        assert discovery.common_length(a, b) == _common(a, b) == discovery.common_length(b, a)
    traces, began = [make(500) for _ in range(40)], time.process_time()
    assert all(discovery.common_length(t, t) == 500 for t in traces)
    assert time.process_time() - began < 1
