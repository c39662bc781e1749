"""Whole jobs: no cap, no shortened grid."""

import inspect
import os
import random

import numpy as np
import pytest

from worktrace.operators import joins, learning
from worktrace.plans import registry, sequences

D = "/root/testdata/sf0.001"


def test_offset_pairs_without_a_cap_equal_brute_force(spark):
    rng = random.Random(3)
    sessions = {"long": 900, "short": 3, "one": 1}
    rows = [(s, i, rng.choice(["p", "q", None]), rng.choice(["A", "B", "C", "D", None])) for s, n in sessions.items() for i in range(n)]
    events = spark.createDataFrame(rows, "session_id string, idx long, case_id string, application string")
    at = {(s, i): (c, a) for s, i, c, a in rows}
    want = {}
    for (s, i), (c, _) in at.items():
        for g in sequences.GAPS:
            if c and at.get((s, i + g), (None,))[0]:
                inside = {at[s, k][1] for k in range(i, i + g + 1)} - {None}
                want[s, i, i + g] = (g, c == at[s, i + g][0], len(inside))
    assert len(sequences.GAPS) == 22 and sequences.GAPS[-1] == 600 and len(want) > 6000
    pairs = joins.offset_pairs(events, "case_id", sequences.GAPS)
    assert {(r.session_id, r.i, r.j): (r.gap, r.same) for r in pairs.collect()} == {k: v[:2] for k, v in want.items()}
    found = learning.distinct_at_gaps(pairs, events, "application", sequences.GAPS).collect()
    assert len(found) == len(want) and {(r.session_id, r.i, r.j): r.n_distinct for r in found} == {k: v[2] for k, v in want.items()}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["j10_offset_pairs_all", "w16_between_counts_all", "m12_distinct_between_all", "v23_stratified_pairs_all"])
def test_whole_pairs_equal_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{D}/events.parquet'")
    df, want = registry.QUERIES[name](spark, D), duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_distinct_between_lists_no_places_of_pairs(spark):
    """Places between the ends of pairs are counted by steps, not listed and shuffled; rows as in SQL."""
    import duckdb

    df = registry.QUERIES["m12_distinct_between"](spark, D)
    assert "sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{D}/events.parquet'")
    want = duck.sql(registry.ORACLE["m12_distinct_between"])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_distinct_of_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    at = {("s", i): (rng.choice(["p", "q", None]), rng.choice(["A", "B", "C", "D", None])) for i in range(400)} | {("t", i): ("p", None) for i in range(3)}
    events = spark.createDataFrame([(*k, *v) for k, v in at.items()], "session_id string, idx long, case_id string, application string").repartition(3)
    want = {(s, i, i + g): len({at[s, k][1] for k in range(i, i + g + 1)} - {None}) for (s, i), (c, _) in at.items() for g in sequences.LINKED if c and at.get((s, i + g), (None,))[0]}
    found = learning.distinct_of_pairs(events, "case_id", "application", sequences.LINKED).collect()
    assert len(found) == len(want) > 2000 and {(r.session_id, r.i, r.j): r.n_distinct for r in found} == want


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_distinct_between_drops_no_pair(spark, monkeypatch):
    """A session with more than 200 pairs has all of them, at every gap of the grid and of the capped queries."""
    from worktrace.plans import models

    events = spark.range(300).selectExpr("'s' AS session_id", "id AS idx", "'c' AS case_id", "concat('a', id % 3) AS application")
    monkeypatch.setattr(sequences, "cased", lambda s, d: events)
    monkeypatch.setattr(sequences, "canon", lambda s, d: events)
    found = models.QUERIES["m12_distinct_between"](spark, "").collect()
    assert {(r.i, r.j) for r in found} == {(i, i + g) for g in {*sequences.GAPS, 1, 2, 5, 10, 25} for i in range(300 - g)}
    assert "<= 200" not in models.ORACLE["m12_distinct_between"]


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_hmm_is_swept_over_all_states(spark):
    found = registry.QUERIES["b17_hmm_boundaries"](spark, D).groupBy("k").count().collect()
    assert sorted(r["k"] for r in found) == [2, 3, 4, 5, 6, 8] and len({r["count"] for r in found}) == 1
    assert inspect.signature(learning.hmm_boundaries).parameters["rounds"].default == 30


def test_best_cuts_equal_every_choice_without_comparing_all(spark):
    rng = np.random.default_rng(6)
    for _ in range(200):
        x = np.concatenate([rng.normal(rng.integers(0, 6), 1, rng.integers(1, 5)) for _ in range(3)])
        s, q, n = np.cumsum([0, *x]), np.cumsum([0, *(x * x)]), np.arange(len(x) + 1.0)
        price = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (n[b] - n[a]) + 2.0
        choices = [[k + 1 for k in range(len(x) - 1) if bits >> k & 1] + [len(x)] for bits in range(1 << (len(x) - 1))]
        least = min(choices, key=lambda c: sum(price(a, b) for a, b in zip([0, *c[:-1]], c)))
        assert learning._cuts(s, q, n, 2.0) == least
