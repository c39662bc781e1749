"""Queries that parse or count the events once, whatever the number of their sections and figures."""

import os

import pytest

from worktrace.plans import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.mark.parametrize("name", ["q_whole_audit", "v09_feature_aucs"])
def test_events_are_read_before_the_figures(spark, name):
    """Failed before: each section and the totals parsed the lines again, and the steps of the values counted all features again."""
    assert not [f for f in registry.QUERIES[name](spark, D).inputFiles() if "events.parquet" in f]
