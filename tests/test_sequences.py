"""Literal sequences and brute force for the rewrites that differ most in form from a loop."""

import random
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from worktrace.operators import boundary, joins, labels, scoring, sequence
from worktrace.functions import scalar


def _events(spark, sessions):
    rows = [(s, i, i * 10, v, v) for s, values in sessions.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "session_id string, idx long, timestamp_ms long, application string, system string")


def test_leave_and_return_is_merged_by_length(spark):
    events = _events(spark, {"a": list("AAABBAAA")})
    cuts = boundary.system_change(events)
    of = lambda df: sorted(r.idx for r in df.where("boundary").collect())
    assert of(cuts) == [2, 4]
    assert of(boundary.merge_leave_and_return(events, cuts, 2)) == []
    assert of(boundary.merge_leave_and_return(events, cuts, 1)) == [2, 4]


def test_immediate_returns_use_the_most_recent_departure(spark):
    found = sequence.return_patterns(sequence.runs(_events(spark, {"a": list("ABABA")}), "system"))
    assert sorted((r.value, r.left_run, r.returned_run) for r in found.where("is_immediate").collect()) == [("A", 0, 2), ("A", 2, 4), ("B", 1, 3)]


def test_fill_forward_keeps_leading_nulls(spark):
    events = _events(spark, {"a": [None, None, "A", None, "B"]})
    assert [r.f for r in sequence.fill_forward(events, "system", "f").orderBy("idx").collect()] == [None, None, "A", "A", "B"]
    assert [r.idx for r in boundary.system_change(events).where("boundary").collect()] == [3]


def _edges(values, reach):
    out = {}
    n = len(values)
    for i in range(n - 1):
        v = values[i]
        if v is not None:
            later = [j for j in range(i + 1, n) if values[j] is not None]
            same = [j for j in later if values[j] == v]
            if later and values[later[0]] != v and same and same[0] <= i + reach:
                out.setdefault(i, [None, None])[0] = same[0] - 1
        v = values[i + 1]
        if v is not None:
            before = [j for j in range(i + 1) if values[j] is not None]
            same = [j for j in before if values[j] == v]
            if before and values[before[-1]] != v and same and same[-1] >= i + 1 - reach:
                out.setdefault(i, [None, None])[1] = same[-1]
    return {i: (a is not None, b is not None, b if b is not None else a) for i, (a, b) in out.items()}


def test_return_edges_equal_brute_force(spark):
    rng = random.Random(9)
    sessions = {f"s{k}": [rng.choice(["A", "B", "C", None]) for _ in range(rng.randint(2, 40))] for k in range(60)}
    got = sequence.return_edges(_events(spark, sessions), "application", 6).collect()
    want = {(s, i): x for s, values in sessions.items() for i, x in _edges(values, 6).items()}
    assert {(r.session_id, r.idx): (r.is_leave, r.is_return, r.pair) for r in got} == want


def test_boundary_labels_at_the_edges(spark):
    events = spark.createDataFrame([("a", i, t, "x", "x", "x", "x", False, "c", i) for i, t in enumerate([0, 10, 20, 20, 30])], "session_id string, idx long, timestamp_ms long, application string, window_title string, browser_domain string, interaction_category string, has_extracted_text boolean, chunk_id string, event_id long")
    points = spark.createDataFrame([("a", t, False) for t in (-5, 5, 20, 30, 99)], "session_id string, at_ms long, is_resume boolean")
    t = sequence.transitions(events, 10)
    assert [r.is_boundary for r in joins.boundary_labels(t, points).orderBy("idx").collect()] == [True, False, False, True]
    assert [r.density_before for r in t.orderBy("idx").collect()] == [1, 1, 2, 2]


def test_set_functions(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    row = spark.range(1).select(scalar.jaccard(a(), a()).alias("x"), scalar.jaccard(a("p"), a()).alias("y"), scalar.content_drift(a("p"), a()).alias("z"), scalar.tokens(F.lit("人事給与 HR hr a_1")).alias("t")).first()
    assert row.x is None and row.y == 0 and tuple(row.z) == (0.0, False) and row.t == ["人事給与", "hr", "a_1"]


def test_pareto_equals_pairs(spark):
    rng = random.Random(2)
    rows = [(f"p{i}", rng.randint(0, 6) / 6, rng.randint(0, 6) / 6) for i in range(60)]
    got = {r.process_id: r.on_frontier for r in scoring.pareto(spark.createDataFrame(rows, "process_id string, impact double, feasibility double")).collect()}
    better = lambda a, b: a[1] >= b[1] and a[2] >= b[2] and (a[1] > b[1] or a[2] > b[2])
    assert got == {b[0]: not any(better(a, b) for a in rows) for b in rows}


def test_scores_at_the_limits(spark):
    same = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "process_id string, v double")
    assert [r.x for r in same.select(scoring.min_max("v").alias("x")).collect()] == [0.5, 0.5]
    kinds = spark.createDataFrame([("one", "s", 4), ("two", "s", 2), ("two", "t", 2)], "process_id string, signature string, frequency long")
    assert {r.process_id: r.entropy for r in scoring.entropies(kinds).collect()} == {"one": 0.0, "two": 1.0}
    five = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate([100, 1, 2, 3, 4])], "process_id string, v double")
    assert sorted(r.v for r in scoring.winsorised(five, "v", 0.2).collect()) == [2, 2, 3, 4, 4]


def _log_brute(records, ended):
    out, last = [], {}
    for n, (event, code) in enumerate(records):
        runs = [x for x in out if x["code"] == code]
        if event == "process_resumed" or (event == "process_started" and last.get(code) != "process_started"):
            out.append({"code": code, "start": n, "sus": None, "sw": None})
        elif runs and event == "process_suspended":
            runs[-1]["sus"] = n
        elif runs and event == "process_switched_out" and runs[-1]["sw"] is None:
            runs[-1]["sw"] = n
        last[code] = event
    newest = {x["code"]: i for i, x in enumerate(out)}
    return sorted((x["code"], x["start"], x["sus"] if x["sus"] is not None else x["sw"] if x["sw"] is not None else (ended if newest[x["code"]] == i else None)) for i, x in enumerate(out))


def test_executions_from_log_equal_brute_force(spark):
    rng = random.Random(4)
    kinds = ["process_started", "process_suspended", "process_switched_out", "process_resumed"]
    logs = {f"s{k}": [(rng.choice(kinds), rng.choice("PQ")) for _ in range(rng.randint(1, 14))] for k in range(80)}
    rows = [(s, n, n, e, c, str(n), "x") for s, records in logs.items() for n, (e, c) in enumerate(records)] + [(s, 99, 99, "session_ended", None, None, None) for s in logs]
    got = labels.executions_from_log(spark.createDataFrame(rows, "session_id string, rec_no long, at_ms long, event string, process_code string, case_id string, split_id string")).collect()
    for s, records in logs.items():
        assert sorted(((r.process_code, r.start_ms, r.end_ms) for r in got if r.session_id == s), key=repr) == sorted(_log_brute(records, 99), key=repr)


def test_sweep_line(spark):
    spans = spark.createDataFrame([("touch", "a", 0, 10), ("touch", "b", 10, 20), ("nest", "a", 0, 30), ("nest", "b", 5, 10)], "session_id string, case_id string, start_ms long, end_ms long")
    assert {r.session_id: r.max_alive for r in labels.concurrency(spans).collect()} == {"touch": 1, "nest": 2}


def test_streams(spark, tmp_path):
    from worktrace.streaming import sessions

    rows = [(1, "a", 0, "x", None), (1, "a", 0, "x", None), (2, "a", 30, None, "d"), (3, "a", 4000, "x", "d"), (4, "b", 10, "x", None)]
    table = spark.createDataFrame(rows, "event_id long, session_id string, sec long, application string, browser_domain string").withColumn("ts", F.timestamp_seconds("sec"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    out = sessions.gap_segments(sessions.deduplicated(sessions.watermarked(stream, "ts", "1 hour")), "ts", "10 minutes")
    query = out.writeStream.format("memory").queryName("segments").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    batch = sessions.gap_segments(table.dropDuplicates(["event_id"]), "ts", "10 minutes")
    assert sorted((r.session_id, r.n_events) for r in batch.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sessions.quality_counters(table, "ts", "1 hour").agg(F.sum("n")).first()[0] == 5


def test_sources(spark, tmp_path):
    from worktrace.sources import logs, sinks

    chunk = tmp_path / "ses_1" / "chunk_0900"
    chunk.mkdir(parents=True)
    (chunk / "events.jsonl").write_text('{"event_id":"e2","session_id":"s","timestamp_ms":5,"event_type":"x","context":{"active_app":{"app_name":"Word"}}}\n\n{broken\n{"event_id":"e1","session_id":"s","timestamp_ms":1,"event_type":"y"}\n')
    (chunk / "manifest.json").write_text('{"chunk_id":"c","session_id":"s","previous_chunk_id":null,"time_range":{"start_ms":1,"end_ms":5}}')
    (tmp_path / "ses_1" / "gt").mkdir()
    (tmp_path / "ses_1" / "gt" / "gt_manifest.json").write_text('{"processes":[{"code":"P","executions":[{"case_id":"k","start_ts":"2024-01-01T00:00:00Z","end_ts":"2024-01-01T00:00:01Z","apps":["a"],"split_id":"q"}]}]}')
    good, bad = logs.events(spark, str(tmp_path))
    assert bad.count() == 1 and [r.event_id for r in logs.merged(logs.typed(good)).orderBy("idx").collect()] == ["e1", "e2"]
    assert logs.discover(spark, str(tmp_path)).first().chunk_dir == "chunk_0900"
    assert logs.manifests(spark, str(tmp_path)).first().time_range.end_ms == 5
    assert logs.ground_truth(spark, str(tmp_path)).select("process_code", "suspended").first() == ("P", True)
    rows = spark.createDataFrame([("s", 5, 5, "l")], "session_id string, start_ms long, end_ms long, label string")
    sinks.write_segments(rows, "label", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().end == "1970-01-01T00:00:00.006Z"


def test_the_rest_imports_without_the_optional_parts(tmp_path):
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "worktrace", tmp_path / "worktrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_the_best_operator_goes_with_all_its_sessions(spark):
    """Operators of unequal size: the mean over the other sessions has another sign than the mean over the other operators."""
    from worktrace.operators.evaluation import gain_survival

    rows = [("a1", "a", 0.9), ("b1", "b", 0.5), *((f"c{i}", "c", -0.1) for i in range(10))]
    one = gain_survival(spark.createDataFrame(rows, "session_id string, operator string, gain double"), 1).first()
    assert abs(one.without_best_operator - (0.5 - 1.0) / 11) < 1e-12
    assert abs(one.without_top_three - (0.5 - 1.0) / 11) < 1e-12 and one.n_sessions == 12
