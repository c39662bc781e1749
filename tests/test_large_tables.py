"""Steps that several queries share are made once, and files and tasks follow the rows."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from worktrace.plans import registry, streams
from worktrace.plans import supervised as plans
from worktrace.sources import sinks

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.mark.parametrize("name", ["v23_strata", "s07_spearman", "s14_merge_sensitivity"])
def test_events_are_not_read_again_for_each_figure(spark, name):
    assert not [f for f in registry.QUERIES[name](spark, D).inputFiles() if "events.parquet" in f]


def test_execution_vectors_do_not_multiply_the_events(spark):
    rows = plans.executions(spark, D)[0]
    assert "Expand" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_views_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("s"), (F.col("id") % 40).cast("string")).alias("session_id"), "id")
    sinks.write_views(rows, str(tmp_path / "views"), ["id"])
    files = glob.glob(str(tmp_path / "views" / "*" / "part-*"))
    assert len(files) == 40
    assert len({os.path.basename(f).split("-")[1] for f in files}) > 1


def test_views_on_a_mounted_folder_are_put_without_hadoops_commit(spark, tmp_path):
    """A file a session that reads back in order, odd names and nulls too, without checksums and staged copies for each."""
    names = ["u1", "a/b", "x=1%", "q'*", "[é]", None]
    rows = spark.createDataFrame([(names[i % 6], i, None if i % 5 else f"ü\n{i}") for i in range(600)], "session_id string, id long, note string").repartition(5)
    path = str(tmp_path / "views")
    sinks.write_views(rows, path, ["id"])
    found = glob.glob(f"{glob.escape(path)}/*/*") + glob.glob(f"{glob.escape(path)}/*/.*")
    assert len(found) == 6 and not [f for f in found if f.endswith(".crc")]
    back = spark.read.schema(rows.schema).json(path).withColumn("file", F.col("_metadata.file_path")).collect()
    assert sorted((str(r.session_id), r.id, r.note) for r in back) == sorted((str(r.session_id), r.id, r.note) for r in rows.collect())
    assert len({(r.session_id, r.file) for r in back}) == 6
    for f in found:
        ids = [int(line.split('"id":')[1].split(",")[0].rstrip("}")) for line in open(f, encoding="utf-8").read().splitlines()]
        assert ids == sorted(ids) and len(ids) == 100


def test_files_of_a_wave_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(streams, "LINES", 10)
    root, _, files = streams.feed(spark, D)
    n = spark.read.text(root).count() - 1
    assert files == -(-n // (streams.WAVES * 10)) > streams.FILES
    assert len(glob.glob(root.removeprefix("file://") + "/part-*")) > streams.WAVES * streams.FILES
