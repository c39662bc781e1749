"""Streams over files: shuffled arrival, late rows, repeats, broken lines, and going on from a checkpoint."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from worktrace.operators import boundary
from worktrace.streaming import cuts, ingest, sessions

DAY = 86_400_000


def _put(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))
    time.sleep(0.05)  # files are read in order of their times


def _record(i, session, at, app, chunk="c"):
    return {"event_id": f"e{i}", "session_id": session, "timestamp_ms": at, "event_type": "x", "context": {"active_app": {"app_name": app}}, "correlation": {"sequence_number": i, "chunk_id": chunk}}


END = {"event_id": "end", "timestamp_ms": 1000 * DAY}


@pytest.fixture(scope="module")
def waves():
    rng = random.Random(4)
    apps = ["a", "b", None]
    rows = [_record(i, f"s{rng.randrange(3)}", DAY + i // 3 * 60_000, apps[rng.randrange(3)]) for i in range(240)]
    parts = [rows[:80], rows[80:160], rows[160:]]
    for p in parts:
        rng.shuffle(p)
    return rows, parts


def test_cuts_do_not_depend_on_arrival(spark, tmp_path, waves):
    rows, parts = waves
    for i, p in enumerate(parts):
        _put(tmp_path / "in", f"{i}.jsonl", p + p[:7] + ['{"event_id": "x', "", '{"event_id": "untimed"}'])
    _put(tmp_path / "in", "end.jsonl", [END])
    events = ingest.events(ingest.lines(spark, str(tmp_path / "in"), 1), "40 minutes").withColumn("system", F.col("application"))
    found, n = ingest.run(cuts.system_cuts(events), "cuts")
    flat = [(r["session_id"], r["timestamp_ms"], r["correlation"]["sequence_number"], r["context"]["active_app"]["app_name"]) for r in rows]
    whole = spark.createDataFrame(flat, "session_id string, timestamp_ms long, sequence_number long, system string")
    whole = whole.withColumn("idx", (F.row_number().over(boundary.Window.partitionBy("session_id").orderBy("timestamp_ms", "sequence_number")) - 1).cast("long"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, boundary.system_change(whole).select("session_id", "idx", "boundary").collect()))
    assert (n.n_lines, n.n_bad, n.n_late) == (240 + 21 + 6 + 1, 6, 0)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    _put(tmp_path / "in", "0.jsonl", [_record(0, "s", 10 * DAY, "a"), _record(1, "s", 10 * DAY + 1000, "b")])
    _put(tmp_path / "in", "1.jsonl", [_record(5, "s", 10 * DAY + 3000, "b")])  # rows are held against the watermark of the batch before
    _put(tmp_path / "in", "2.jsonl", [_record(2, "s", 10 * DAY + 5000, "b"), _record(3, "s", 9 * DAY, "c"), _record(4, "t", 8 * DAY, "c")])
    _put(tmp_path / "in", "3.jsonl", [END])
    events = ingest.events(ingest.lines(spark, str(tmp_path / "in"), 1), "1 hour")
    found, n = ingest.run(sessions.gap_segments(events, "at", "1 hour"), "segments")
    assert [(r.session_id, r.n_events) for r in found.where("session_id IS NOT NULL").collect()] == [("s", 4)]
    assert n.n_late == 2 and n.n_bad == 0


def test_a_later_run_goes_on(spark, tmp_path):
    """State waits in the checkpoint: rows of a second run continue the session of the first, and its repeats are known."""
    table = str(tmp_path / "table")

    def go():
        events = ingest.events(ingest.lines(spark, str(tmp_path / "in"), 5), "1 hour").withColumn("system", F.col("application"))
        return ingest.run(cuts.system_cuts(events), "cuts", table)

    _put(tmp_path / "in", "0.jsonl", [_record(0, "s", DAY, "a"), _record(1, "s", DAY + 5, "b")])
    found, _ = go()
    assert found.count() == 0
    _put(tmp_path / "in", "1.jsonl", [_record(1, "s", DAY + 5, "b"), _record(2, "s", DAY + 9, None), _record(3, "s", DAY + 3, "b"), END])
    found, n = go()
    assert sorted(map(tuple, found.collect())) == [("s", 0, True), ("s", 1, False), ("s", 2, False)]
    assert n.n_late == 0
