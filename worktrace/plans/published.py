"""Plans that write the delivered files and views, and read them back: what is compared is what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.operators import discovery as dc
from worktrace.operators import scoring as sc
from worktrace.operators.tables import new_folder, written
from worktrace.plans import processes
from worktrace.plans import sequences as base
from worktrace.plans.oracle import sql
from worktrace.sources import sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def plan(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle)
        return f

    return add


def _ground_truth(s: SparkSession, d: str) -> DataFrame:
    from worktrace import fixtures as fx

    events = base.cased(s, d).where("case_id IS NOT NULL").groupBy("case_id").agg(F.array_sort(F.collect_set("application")).alias("apps"), F.count("*").alias("n_events"))
    return fx.ground_truth(s, d).join(events, "case_id", "left")


@plan("a10_segments_file", "SELECT session_id, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS start, strftime(make_timestamp(CASE WHEN start_ms >= end_ms THEN start_ms + 1 ELSE end_ms END * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS \"end\", dominant_context AS label FROM exec")
def _(s, d):
    path = new_folder(s, "segments")
    sinks.write_segments(processes.rows(s, d), "process_id", path)
    return s.read.schema("session_id string, start string, `end` string, label string").json(path)


@plan("a11_ground_truth_csv", "SELECT session_id, case_id, process_code, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS start, strftime(make_timestamp(end_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS \"end\", n, apps FROM gt LEFT JOIN (SELECT case_id, count(*) AS n, string_agg(DISTINCT application, '|' ORDER BY application) AS apps FROM cased WHERE case_id IS NOT NULL GROUP BY 1) USING (case_id)")
def _(s, d):
    path = new_folder(s, "ground-truth")
    sinks.write_executions_csv(_ground_truth(s, d), path)
    return s.read.schema("session_id string, case_id string, process_code string, start string, `end` string, n long, apps string").option("header", True).csv(path)


@plan("a12_transition_files", "SELECT * REPLACE (round(log1p_delta_t_ms, 9) AS log1p_delta_t_ms) FROM trans")
def _(s, d):
    path = new_folder(s, "transitions")
    sinks.write_transitions(base.trans(s, d), path, 16)
    return s.read.parquet(path).drop("bucket").withColumn("log1p_delta_t_ms", F.round("log1p_delta_t_ms", 9))


_INDEX = "SELECT execution_id, session_id, dominant_context AS process_id, start_ms, end_ms, duration_ms, event_count FROM exec"


@plan("a13_execution_index", _INDEX)
def _(s, d):
    path = new_folder(s, "index")
    index = processes.rows(s, d).select("execution_id", "session_id", "process_id", "start_ms", "end_ms", "duration_ms", "event_count")
    sinks.write_views(index, path, ["start_ms", "execution_id"])
    return s.read.schema(index.schema).json(path)


@plan("a13_session_files", f"SELECT session_id, count(*) AS n_rows, 1 AS n_files, bool_and(ok) AS in_order FROM (SELECT session_id, true AS ok FROM ({_INDEX})) GROUP BY 1")
def _(s, d):
    """Of each session's published file: its rows, that it is one file, and that it is in the order of time."""
    path = new_folder(s, "sessions")
    index = processes.rows(s, d).select("execution_id", "session_id", "process_id", "start_ms", "end_ms")
    sinks.write_views(index, path, ["start_ms", "execution_id"])
    back = s.read.schema(index.schema).json(path).withColumns({"file": F.col("_metadata.file_path"), "line": F.monotonically_increasing_id()})
    by_line = F.transform(F.array_sort(F.collect_list(F.struct("line", "start_ms"))), lambda x: x["start_ms"])
    return back.groupBy("session_id").agg(F.count("*").alias("n_rows"), F.count_distinct("file").cast("int").alias("n_files"), (by_line == F.array_sort(F.collect_list("start_ms"))).alias("in_order"))


@plan("a13_variants_flat", f"SELECT process_id, signature, frequency, round(mean_ms, 3) AS mean_ms, round(share, 9) AS share, row_number() OVER (PARTITION BY process_id ORDER BY frequency DESC, signature) AS place FROM ({processes.VAR})")
def _(s, d):
    from pyspark.sql import Window

    path = new_folder(s, "variants")
    place = F.row_number().over(Window.partitionBy("process_id").orderBy(F.desc("frequency"), "signature"))
    flat = dc.variants(processes.rows(s, d)).select("process_id", "signature", "frequency", F.round("mean_ms", 3).alias("mean_ms"), F.round("share", 9).alias("share"), place.alias("place"))
    flat.write.json(path)
    return s.read.schema(flat.schema).json(path)


@plan("a13_ranking")
def _(s, d):
    """Ranking with its robustness, one row a process."""
    path = new_folder(s, "ranking")
    own = written(processes.parts(s, d), "parts")
    default = processes._r(sc.ranks(sc.scores(own)), "opportunity")
    both = default.join(sc.rank_robustness(processes.scenario_ranks(s, d, own)), "process_id", "left")
    both.write.json(path)
    return s.read.schema(both.schema).json(path)


ORACLE["a13_ranking"] = f"SELECT * FROM ({processes.ORACLE['s04_opportunity']}) LEFT JOIN ({processes.ORACLE['s13_rank_robustness']}) USING (process_id)"
