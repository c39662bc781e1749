"""Registered plans against their DuckDB SQL on the smallest tables (FAST: those that take seconds; the driver compares all); invariants."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from worktrace.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def _plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return int(x) if float(x).is_integer() else float(f"{x:.8g}")
    return str(x)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


FAST = [n for n in registry.ORACLE if n[0] in "fwjbelkax" or n in ("v14_eight_gates", "v24_split_gaps", "v18_protected_by_source", "v19_aucs", "v19_composition", "v21_cluster_comparison", "v22_protection_sweep", "v23_strata", "p18_trace_similarity", "m07_motifs", "p03_follows", "p05_variants", "s04_opportunity", "s05_pareto", "v01_boundary_metrics", "v02_execution_metrics", "v08_auc", "g01_executions_from_log", "g04_continuity_labels", "q01_missingness", "q16_cleaning", "q20_health", "q_whole_audit", "v04_signals", "v17_forensics", "q17_session_profiles", "m06_held_out_choice", "m14_agreement")]


@pytest.mark.parametrize("name", FAST)
def test_plan_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_results_do_not_depend_on_partitions(spark):
    from worktrace import fixtures as fx
    from worktrace.operators import boundary, sequence

    events = fx.canonical(spark, D)
    once = None
    for n in (1, 7):
        cuts = boundary.merge_leave_and_return(events.repartition(n, F.rand(3)), boundary.system_change(events.repartition(n)), 2)
        rows = sorted(map(tuple, sequence.segments(events, cuts).select("session_id", "idx", "seg_no").collect()))
        once = once or rows
        assert rows == once


def test_registry_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLE) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
