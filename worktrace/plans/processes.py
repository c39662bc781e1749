"""Plans for process discovery, scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktrace import fixtures as fx
from worktrace.operators import boundary as b
from worktrace.operators import discovery as dc
from worktrace.operators import evaluation as ev
from worktrace.operators import executions as ex
from worktrace.operators import joins as jn
from worktrace.operators import learning as ln
from worktrace.operators import scoring as sc
from worktrace.operators import sequence as sq
from worktrace.operators.tables import written
from worktrace.plans import sequences as base
from worktrace.plans.oracle import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def plan(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle)
        return f

    return add


def _r(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def rows(s: SparkSession, d: str) -> DataFrame:
    return rows_of(base.segmented(s, d))


def rows_of(seg: DataFrame) -> DataFrame:
    """Executions with process_id, signature, manual share and number of systems. The segments are read five times, so they are written once."""
    seg = written(seg, "segmented")
    step_rows = ex.steps(seg)
    keys = ["session_id", "seg_no"]
    sig = dc.signatures(dc.trace_steps(step_rows, F.col("system")))
    manual = seg.groupBy(*keys).agg((F.count_if(F.col("interaction_category").isin(*fx.MANUAL)) / F.count("*")).alias("manual_share"), F.count_distinct("interaction_category").alias("n_categories"))
    touched = step_rows.groupBy(*keys).agg(F.count_distinct("system").alias("n_systems"))
    out = ex.executions(seg, fx.NOISE_APPS).join(ex.dominant_context(seg, fx.SUFFIXES), keys).join(sig, keys, "left").join(manual, keys).join(touched, keys)
    return out.withColumn("signature", F.coalesce("signature", F.lit(""))).withColumnRenamed("dominant_context", "process_id")


def step_rows(s: SparkSession, d: str) -> DataFrame:
    return ex.steps(base.segmented(s, d))


TR = "SELECT session_id, seg_no, step_no, system AS activity FROM (SELECT *, lag(system) OVER (PARTITION BY session_id, seg_no ORDER BY step_no) AS p FROM step WHERE system IS NOT NULL) WHERE p IS DISTINCT FROM system"
EDGE = f"SELECT source, target, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS probability FROM (SELECT activity AS source, lead(activity) OVER (PARTITION BY session_id, seg_no ORDER BY step_no) AS target FROM ({TR})) WHERE target IS NOT NULL GROUP BY source, target"
VAR = "SELECT dominant_context AS process_id, signature, count(*) AS frequency, avg(duration_ms) AS mean_ms, count(*) / sum(count(*)) OVER (PARTITION BY dominant_context) AS share FROM ex GROUP BY 1, 2"
TOP = f"SELECT process_id, signature AS dominant, share AS pooled FROM ({VAR}) QUALIFY row_number() OVER (PARTITION BY process_id ORDER BY frequency DESC, signature) = 1"


@plan("p01_signatures", "SELECT session_id, seg_no, signature FROM sigs")
def _(s, d):
    return dc.signatures(dc.trace_steps(step_rows(s, d), F.col("system")))


@plan("p02_activity_traces", "SELECT session_id, seg_no, string_agg(a, '>' ORDER BY step_no) AS signature FROM (SELECT *, lag(a) OVER (PARTITION BY session_id, seg_no ORDER BY step_no) AS p FROM (SELECT *, system || '|' || interaction_category AS a FROM step) WHERE a IS NOT NULL) WHERE p IS DISTINCT FROM a GROUP BY ALL")
def _(s, d):
    return dc.signatures(dc.trace_steps(step_rows(s, d), F.concat("system", F.lit("|"), "interaction_category")))


@plan("p03_follows", EDGE)
def _(s, d):
    return _r(dc.follows(dc.trace_steps(step_rows(s, d), F.col("system"))), "probability")


@plan("p03_follows_lineitem", "SELECT source, target, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS probability FROM (SELECT concat(l_returnflag, l_linestatus) AS source, lead(concat(l_returnflag, l_linestatus)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS target FROM lineitem) WHERE target IS NOT NULL GROUP BY source, target")
def _(s, d):
    steps = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"), F.concat("l_returnflag", "l_linestatus").alias("activity"))
    return _r(dc.follows(steps, ("l_orderkey",), "place"), "probability")


@plan("p04_self_loops", "SELECT source, count(*) AS n FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY session_id ORDER BY idx) AS target FROM canon) WHERE source = target GROUP BY 1")
def _(s, d):
    events = base.canon(s, d).withColumnRenamed("event_type", "activity")
    return dc.self_loops(dc.follows(events, ("session_id",), "idx")).select("source", "n")


@plan("p04_trace_ends", f"SELECT kind, activity, count(*) AS n FROM (SELECT 'start' AS kind, arg_min(activity, step_no) AS activity FROM ({TR}) GROUP BY session_id, seg_no UNION ALL SELECT 'end', arg_max(activity, step_no) FROM ({TR}) GROUP BY session_id, seg_no) GROUP BY ALL")
def _(s, d):
    return dc.ends(dc.trace_steps(step_rows(s, d), F.col("system")))


@plan("p04_dominant_successors", f"SELECT * FROM ({EDGE}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, target) = 1")
def _(s, d):
    return _r(dc.dominant_successors(dc.follows(dc.trace_steps(step_rows(s, d), F.col("system")))), "probability")


@plan("p05_variants", f"SELECT process_id, signature, frequency, round(mean_ms, 3) AS mean_ms, round(share, 9) AS share FROM ({VAR})")
def _(s, d):
    return _r(_r(dc.variants(rows(s, d)), "share"), "mean_ms", places=3)


@plan("p06_profiles", "SELECT process_id, n, CAST(total_ms AS BIGINT) AS total_ms, round(manual_share, 9) AS manual_share, round(systems, 9) AS systems, operators, n_variants, round(dominant_share, 9) AS dominant_share FROM prof")
def _(s, d):
    return _r(dc.profiles(rows(s, d)), "manual_share", "systems", "dominant_share")


@plan("p07_step_time", "SELECT dominant_context AS process_id, system, interaction_category, count(*) AS n_steps, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(s.end_ms - s.start_ms) AS BIGINT) AS total_ms FROM step s JOIN ctx USING (session_id, seg_no) GROUP BY ALL")
def _(s, d):
    return dc.step_time(rows(s, d), step_rows(s, d))


@plan("p08_time_analysis", "SELECT dominant_context AS process_id, CAST(sum(duration_ms) AS BIGINT) AS total_ms, round(avg(duration_ms), 3) AS mean_ms, median(duration_ms) AS median_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms FROM ex GROUP BY 1")
def _(s, d):
    return _r(dc.time_analysis(rows(s, d)), "mean_ms", places=3)


@plan("p09_process_metrics", "SELECT process_id, round(n / sum(n) OVER (), 9) AS frequency_share, round(total_ms / sum(total_ms) OVER (), 9) AS time_share, round(dominant_share * manual_share, 9) AS surface FROM prof")
def _(s, d):
    return _r(dc.process_metrics(dc.profiles(rows(s, d))), "frequency_share", "time_share", "surface")


@plan("p10_effort", "SELECT process_id, n AS f, CAST(total_ms AS BIGINT) AS td, round(total_ms / n, 3) AS ad, round(total_ms / sum(total_ms) OVER (), 9) AS ts, true AS consistent FROM prof")
def _(s, d):
    return _r(_r(dc.effort(rows(s, d)), "ad", places=3), "ts")


@plan("p11_operator_variants", f"""SELECT process_id, operator, n, hits, round((p + z / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 9) AS low, round((p + z / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 9) AS high,
  round(CASE WHEN pooled > 0 AND pooled < 1 THEN (hits - n * pooled) ** 2 / (n * pooled * (1 - pooled)) END, 9) AS chi2_part
FROM (SELECT ex.dominant_context AS process_id, operator, pooled, count(*) AS n, count(*) FILTER (signature = dominant) AS hits, count(*) FILTER (signature = dominant) / count(*) AS p, 3.8416 AS z FROM ex JOIN ({TOP}) t ON t.process_id = ex.dominant_context GROUP BY 1, 2, 3)""")
def _(s, d):
    return _r(dc.operator_variants(rows(s, d)), "low", "high", "chi2_part")


@plan("p12_concentration", "SELECT process_id, round(max(sh), 9) AS largest, round(sum(sh * sh), 9) AS herfindahl FROM (SELECT dominant_context AS process_id, operator, count(*) / sum(count(*)) OVER (PARTITION BY dominant_context) AS sh FROM ex GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    return _r(dc.concentration(rows(s, d)), "largest", "herfindahl")


@plan("p13_path_classes", f"SELECT dominant_context AS process_id, CASE WHEN signature = dominant THEN 'dominant' WHEN list_has_all(string_split(signature, '>'), string_split(dominant, '>')) THEN 'detour' ELSE 'other' END AS path_class, count(*) AS n FROM ex JOIN ({TOP}) t ON t.process_id = ex.dominant_context GROUP BY ALL")
def _(s, d):
    return dc.classify(rows(s, d)).groupBy("process_id", "path_class").agg(F.count("*").alias("n"))


@plan("p14_path_event_types", f"SELECT path_class, event_type, count(*) AS n FROM seg JOIN (SELECT session_id, seg_no, CASE WHEN signature = dominant THEN 'dominant' WHEN list_has_all(string_split(signature, '>'), string_split(dominant, '>')) THEN 'detour' ELSE 'other' END AS path_class FROM ex JOIN ({TOP}) t ON t.process_id = ex.dominant_context) USING (session_id, seg_no) GROUP BY ALL")
def _(s, d):
    classes = dc.classify(rows(s, d)).select("session_id", "seg_no", "path_class")
    return base.segmented(s, d).join(classes, ["session_id", "seg_no"]).groupBy("path_class", "event_type").agg(F.count("*").alias("n"))


@plan("p15_routing", "SELECT CASE WHEN signature = '' THEN 'no_evidence' WHEN NOT list_has_all(['app:app0', 'app:app1', 'app:app2', 'browser:127.0.0.1:5130', 'browser:127.0.0.1:5131'], string_split(signature, '>')) THEN 'unknown_system' WHEN duration_ms > 432000000 THEN 'too_long' WHEN len(string_split(signature, '>')) > 3 THEN 'too_many_steps' ELSE 'eligible' END AS reason, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS ms FROM ex GROUP BY 1")
def _(s, d):
    return dc.route(rows(s, d), ["app:app0", "app:app1", "app:app2", "browser:127.0.0.1:5130", "browser:127.0.0.1:5131"], 120 * fx.HOUR)


@plan("p16_process_summaries", "SELECT process_id, string_agg(system, ',' ORDER BY r) AS top_systems FROM (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY n DESC, system) AS r FROM (SELECT dominant_context AS process_id, system, count(*) AS n FROM step JOIN ctx USING (session_id, seg_no) WHERE system IS NOT NULL GROUP BY ALL)) WHERE r <= 3 GROUP BY 1")
def _(s, d):
    return dc.summary(rows(s, d), step_rows(s, d), 3)


#: Names are coded by one letter each, so that an edit distance of letters counts steps.
LETTERS = "SELECT t, chr(CAST(32 + row_number() OVER (ORDER BY t) AS INTEGER)) AS c FROM (SELECT DISTINCT unnest(string_split(signature, '>')) AS t FROM sigs)"
PATHS = f"SELECT dominant_context AS process_id, signature, count(*) AS frequency, min(CASE WHEN signature = dominant THEN 'dominant' WHEN list_has_all(string_split(signature, '>'), string_split(dominant, '>')) THEN 'detour' ELSE 'other' END) AS path_class FROM ex JOIN ({TOP}) t ON t.process_id = ex.dominant_context WHERE signature <> '' GROUP BY 1, 2"
CODED = f"SELECT process_id, path_class, signature, frequency, string_agg(c, '' ORDER BY i) AS code FROM (SELECT process_id, path_class, signature, frequency, unnest(string_split(signature, '>')) AS t, unnest(range(len(string_split(signature, '>')))) AS i FROM ({PATHS})) JOIN ({LETTERS}) USING (t) GROUP BY ALL"
PAIRED = f"SELECT a.process_id, least(a.path_class, b.path_class) AS class_a, greatest(a.path_class, b.path_class) AS class_b, a.signature AS a, b.signature AS b, a.frequency AS fa, b.frequency AS fb, 1 - levenshtein(a.code, b.code) / greatest(length(a.code), length(b.code)) AS lev, len(list_intersect(string_split(a.signature, '>'), string_split(b.signature, '>'))) / len(list_distinct(list_concat(string_split(a.signature, '>'), string_split(b.signature, '>')))) AS jac FROM ({CODED}) a JOIN ({CODED}) b ON a.process_id = b.process_id AND a.signature <= b.signature"


LCS = "CAST(list_reduce(list_transform(string_split(a, '>'), lambda x: [x]), lambda acc, e: list_transform(range(1, len(string_split(b, '>')) + 1), lambda k: CAST(list_max(list_transform(range(1, k + 1), lambda j: CASE WHEN string_split(b, '>')[j] = e[1] THEN (CASE WHEN j > 1 THEN CAST(acc[j - 1] AS INTEGER) ELSE 0 END) + 1 ELSE CAST(acc[j] AS INTEGER) END)) AS VARCHAR)), list_transform(string_split(b, '>'), lambda x: '0'))[-1] AS INTEGER)"


def path_pairs(s: SparkSession, d: str) -> DataFrame:
    classed = dc.classify(rows(s, d)).where("signature <> ''")
    kinds = classed.groupBy("process_id", "signature", "path_class").agg(F.count("*").alias("frequency"))
    return dc.similar_pairs(kinds)


@plan("p17_pair_similarity", f"SELECT process_id, a, b, round(lev, 9) AS levenshtein, round(2 * {LCS} / (len(string_split(a, '>')) + len(string_split(b, '>'))), 9) AS lcs, round(jac, 9) AS jaccard FROM ({PAIRED}) WHERE a < b")
def _(s, d):
    return _r(path_pairs(s, d).where("a < b").select("process_id", "a", "b", "levenshtein", "lcs", "jaccard"), "levenshtein", "lcs", "jaccard")


@plan("p18_trace_similarity", f"SELECT process_id, class_a, class_b, round(sum(w * lev) / nullif(sum(w), 0), 9) AS mean_levenshtein, round(sum(w * 2 * {LCS} / (len(string_split(a, '>')) + len(string_split(b, '>')))) / nullif(sum(w), 0), 9) AS mean_lcs, round(sum(w * jac) / nullif(sum(w), 0), 9) AS mean_jaccard, CAST(sum(w) AS BIGINT) AS pairs FROM (SELECT *, CASE WHEN a = b THEN fa * (fa - 1) ELSE 2 * fa * fb END AS w FROM ({PAIRED})) GROUP BY 1, 2, 3")
def _(s, d):
    """Means within (class_a = class_b) and between the path classes of each process, over ordered pairs of executions."""
    return _r(dc.mean_similarities(path_pairs(s, d)), "mean_levenshtein", "mean_lcs", "mean_jaccard")


@plan("p19_correlation", "SELECT round(corr(n, total_ms), 9) AS correlation FROM prof")
def _(s, d):
    return _r(dc.profiles(rows(s, d)).agg(F.corr("n", "total_ms").alias("correlation")), "correlation")


def profile_of(base_rows: DataFrame) -> DataFrame:
    """One row a process. The executions and the profiles are read several times, so both are written once."""
    base_rows = written(base_rows.select("process_id", "signature", "operator", "duration_ms", "manual_share", "n_systems"), "executions")
    p = written(dc.profiles(base_rows), "profiles")
    return p.join(dc.process_metrics(p), "process_id").join(sc.entropies(dc.variants(base_rows)), "process_id")


def profile(s: SparkSession, d: str) -> DataFrame:
    return profile_of(rows(s, d))


def parts(s: SparkSession, d: str) -> DataFrame:
    return sc.normalised(profile(s, d))


def scored(s: SparkSession, d: str) -> DataFrame:
    return sc.scores(parts(s, d))


#: Weights of frequency, time, manual share; and of determinism, stability, surface, risk. Fixed values.
IMPACT_NAMED = {"default": (1.0, 1.0, 1.0), "frequency_heavy": (3.0, 1.0, 1.0), "time_heavy": (1.0, 3.0, 1.0), "manual_effort_heavy": (1.0, 1.0, 3.0), "volume_deemphasized": (0.3, 0.3, 3.0), "correlation_aware": (0.5, 0.5, 1.0)}
IMPACT_GRID = {"balanced": (1.0, 1.0, 1.0), "frequency_heavy": (3.0, 1.0, 1.0), "time_heavy": (1.0, 3.0, 1.0), "volume_deemphasized": (0.2, 0.2, 3.0)}
FEASIBILITY = {"balanced": (1.0, 1.0, 1.0, 1.0), "feasibility_heavy": (2.0, 2.0, 2.0, 1.0), "risk_averse": (3.0, 1.0, 1.0, 3.0)}
SCEN = (
    [(n, *w, *FEASIBILITY["balanced"]) for n, w in IMPACT_NAMED.items()]
    + [(f"feasibility_{n}", *IMPACT_NAMED["default"], *w) for n, w in FEASIBILITY.items() if n != "balanced"]
    + [(f"{a}|{b_}", *wa, *wb) for a, wa in IMPACT_GRID.items() for b_, wb in FEASIBILITY.items()]
)
SCEN_SQL = "(VALUES " + ", ".join("('" + r[0] + "', " + ", ".join(f"CAST({x} AS DOUBLE)" for x in r[1:]) + ")" for r in SCEN) + ") AS w(scenario, wf, wt, wm, wd, we, ws, wc)"
SSQL = f"SELECT *, impact * feasibility AS opportunity FROM (SELECT scenario, process_id, round((wf * nf + wt * nt + wm * nm) / (wf + wt + wm), 9) AS impact, round((wd * nd + we * (1 - ne) + ws * nsf + wc * (1 - nc)) / (wd + we + ws + wc), 9) AS feasibility FROM norm, {SCEN_SQL})"
SRANK = f"SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY opportunity DESC, process_id) AS rank FROM ({SSQL})"


def scenarios(s: SparkSession) -> DataFrame:
    return s.createDataFrame(SCEN, "scenario string, w_nf double, w_nt double, w_nm double, w_nd double, w_ne double, w_ns double, w_nc double")


def scenario_ranks(s: SparkSession, d: str, own: DataFrame | None = None) -> DataFrame:
    """Ranks in each scenario; ``own``: the parts, where they are there already."""
    return sc.ranks(sc.scores(parts(s, d) if own is None else own, scenarios(s)), over=["scenario"])


@plan("s01_min_max", "SELECT process_id, round(nf, 9) AS nf, round(nt, 9) AS nt, round(nm, 9) AS nm, round(nd, 9) AS nd, round(ne, 9) AS ne, round(nsf, 9) AS ns, round(nc, 9) AS nc FROM norm")
def _(s, d):
    return _r(parts(s, d), "nf", "nt", "nm", "nd", "ne", "ns", "nc")


#: Weight sets of the priority score: what differs from 1. Fixed values.
PRIORITY_SETS = {"equal": {}, "time_heavy": {"time_impact": 3.0}, "frequency_heavy": {"frequency": 3.0}, "risk_averse": {"risk": 3.0, "complexity": 2.0}, "no_business_impact_proxy": {"business_impact": 0.0}}
PRIORITY_PLUS, PRIORITY_MINUS = ("frequency", "time_impact", "manual_effort", "repetitiveness", "feasibility", "business_impact"), ("risk", "complexity")
#: Processes that count as core systems here.
CORE = "browser:"
FACTORS = """SELECT process_id, n AS frequency, total_ms AS time_impact, manual_share AS manual_effort, dominant_share AS repetitiveness, dominant_share AS feasibility, CASE WHEN starts_with(process_id, 'browser:') THEN 1.0 ELSE 0.6 END AS business_impact,
  CASE WHEN starts_with(process_id, 'browser:') THEN 1.0 ELSE 0.3 END + n_variants AS risk, systems + n_categories AS complexity
FROM prof JOIN (SELECT dominant_context AS process_id, count(DISTINCT interaction_category) AS n_categories FROM seg JOIN ctx USING (session_id, seg_no) GROUP BY 1) USING (process_id)"""
PRIORITY = f"SELECT k AS weight_set, process_id, round({' + '.join(f'w_{c} * {c}' for c in PRIORITY_PLUS)} - {' - '.join(f'w_{c} * {c}' for c in PRIORITY_MINUS)}, 9) AS score FROM (SELECT process_id, {', '.join(f'CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END AS {c}' for c in (*PRIORITY_PLUS, *PRIORITY_MINUS))} FROM ({FACTORS})), (VALUES {', '.join('(' + repr(k) + ', ' + ', '.join(str(w.get(c, 1.0)) for c in (*PRIORITY_PLUS, *PRIORITY_MINUS)) + ')' for k, w in PRIORITY_SETS.items())}) AS w(k, {', '.join(f'w_{c}' for c in (*PRIORITY_PLUS, *PRIORITY_MINUS))})"
PRIORITY = f"SELECT *, row_number() OVER (PARTITION BY weight_set ORDER BY score DESC, process_id) AS rank FROM ({PRIORITY})"


def priorities(s: SparkSession, d: str) -> DataFrame:
    """All processes under all weight sets, ranked."""
    base_rows = rows(s, d)
    categories = base.segmented(s, d).join(base_rows.select("session_id", "seg_no", "process_id"), ["session_id", "seg_no"]).groupBy("process_id").agg(F.count_distinct("interaction_category").alias("n_categories"))
    core = F.col("process_id").startswith(CORE)
    factors = dc.profiles(base_rows).join(categories, "process_id").select(
        "process_id",
        F.col("n").alias("frequency"),
        F.col("total_ms").alias("time_impact"),
        F.col("manual_share").alias("manual_effort"),
        F.col("dominant_share").alias("repetitiveness"),
        F.col("dominant_share").alias("feasibility"),
        F.when(core, 1.0).otherwise(0.6).alias("business_impact"),
        (F.when(core, 1.0).otherwise(0.3) + F.col("n_variants")).alias("risk"),
        (F.col("systems") + F.col("n_categories")).alias("complexity"),
    )
    every = (*PRIORITY_PLUS, *PRIORITY_MINUS)
    parts_ = factors.select("process_id", *(sc.min_max(c).alias(c) for c in every))
    table = [(k, *(w.get(c, 1.0) for c in every)) for k, w in PRIORITY_SETS.items()]
    weights = s.createDataFrame(table, "weight_set string, " + ", ".join(f"w_{c} double" for c in every))
    return sc.ranks(sc.priority(parts_, PRIORITY_PLUS, PRIORITY_MINUS, weights), "score", ["weight_set"])


@plan("s02_priority", f"SELECT weight_set, process_id, score, rank FROM ({PRIORITY})")
def _(s, d):
    return priorities(s, d)


@plan("s02_top_three", f"SELECT weight_set, top_three, (SELECT count(DISTINCT process_id) = 1 FROM ({PRIORITY}) WHERE rank = 1) AS winner_stable FROM (SELECT weight_set, string_agg(process_id, '>' ORDER BY rank) AS top_three FROM ({PRIORITY}) WHERE rank <= 3 GROUP BY 1)")
def _(s, d):
    return sc.top_and_stable(priorities(s, d), "weight_set", 3)


@plan("s03_entropies", "SELECT process_id, round(entropy, 9) AS entropy, round(norm_entropy, 9) AS norm_entropy FROM ent")
def _(s, d):
    return _r(sc.entropies(dc.variants(rows(s, d))), "entropy", "norm_entropy")


@plan("s04_opportunity", "SELECT process_id, impact, feasibility, round(opportunity, 9) AS opportunity, row_number() OVER (ORDER BY opportunity DESC, process_id) AS rank FROM scored")
def _(s, d):
    return _r(sc.ranks(scored(s, d)), "opportunity")


DOM = "SELECT a.process_id, count(b.process_id) AS n_dominating FROM scored a LEFT JOIN scored b ON b.impact >= a.impact AND b.feasibility >= a.feasibility AND (b.impact > a.impact OR b.feasibility > a.feasibility) GROUP BY 1"


@plan("s05_pareto", f"SELECT process_id, n_dominating = 0 AS on_frontier FROM ({DOM})")
def _(s, d):
    return sc.pareto(scored(s, d)).select("process_id", "on_frontier")


@plan("s05_dominated_by", DOM)
def _(s, d):
    return sc.dominated_by(scored(s, d))


@plan("s06_scenarios", f"SELECT scenario, process_id, round(opportunity, 9) AS opportunity, rank FROM ({SRANK})")
def _(s, d):
    return _r(scenario_ranks(s, d), "opportunity").select("scenario", "process_id", "opportunity", "rank")


@plan("s06_winners", f"SELECT a.scenario, a.top AS top_three, b.rank AS target_rank, a.first <> t.first AS winner_changed FROM (SELECT scenario, string_agg(process_id, '>' ORDER BY rank) AS top, min(process_id) FILTER (rank = 1) AS first FROM ({SRANK}) WHERE rank <= 3 GROUP BY 1) a, (SELECT process_id AS first FROM ({SRANK}) WHERE scenario = 'default' AND rank = 1) t JOIN ({SRANK}) b ON b.scenario = a.scenario AND b.process_id = t.first")
def _(s, d):
    ranked = scenario_ranks(s, d)
    target = ranked.where("scenario = 'default' AND rank = 1").select(F.col("process_id").alias("target"))  # one row
    first = F.max(F.when(F.col("rank") == 1, F.col("process_id")))
    out = ranked.crossJoin(F.broadcast(target)).groupBy("scenario").agg(sc.top_names(3).alias("top_three"), F.max(F.when(F.col("process_id") == F.col("target"), F.col("rank"))).alias("target_rank"), (first != F.max("target")).alias("winner_changed"))
    return out


@plan("s07_spearman", f"SELECT a.scenario, round(coalesce(corr(a.rank, b.rank), 1), 9) AS rho FROM ({SRANK}) a JOIN ({SRANK}) b ON b.scenario = 'default' AND a.process_id = b.process_id GROUP BY 1")
def _(s, d):
    own = written(parts(s, d), "parts")
    return _r(sc.spearman(scenario_ranks(s, d, own), sc.ranks(sc.scores(own))), "rho")


@plan("s08_kendall", f"SELECT scenario, round(sum(CASE WHEN sign(x1 - x2) = sign(y1 - y2) THEN 1 ELSE -1 END) / count(*), 9) AS tau FROM (SELECT a.scenario, a.opportunity AS x1, b.opportunity AS x2, c.opportunity AS y1, e.opportunity AS y2 FROM ({SSQL}) a JOIN ({SSQL}) b ON a.scenario = b.scenario AND a.process_id < b.process_id JOIN scored c ON c.process_id = a.process_id JOIN scored e ON e.process_id = b.process_id) GROUP BY 1")
def _(s, d):
    return _r(sc.kendall(scenario_ranks(s, d), scored(s, d)), "tau")


@plan("s09_winsorised", "SELECT process_id, CASE WHEN n < 3 THEN v ELSE least(greatest(v, max(CASE WHEN r = k THEN v END) OVER ()), max(CASE WHEN r = n - 1 - k THEN v END) OVER ()) END AS total_ms FROM (SELECT process_id, CAST(total_ms AS BIGINT) AS v, row_number() OVER (ORDER BY total_ms, process_id) - 1 AS r, count(*) OVER () AS n, CAST(floor(count(*) OVER () * 0.1) AS BIGINT) AS k FROM prof)")
def _(s, d):
    return sc.winsorised(dc.profiles(rows(s, d)), "total_ms", 0.1).select("process_id", "total_ms")


ABLATED = {
    "nf": ("(nt + nm) / 2", None), "nt": ("(nf + nm) / 2", None), "nm": ("(nf + nt) / 2", None),
    "nd": (None, "((1 - ne) + nsf + (1 - nc)) / 3"), "ne": (None, "(nd + nsf + (1 - nc)) / 3"), "ns": (None, "(nd + (1 - ne) + (1 - nc)) / 3"), "nc": (None, "(nd + (1 - ne) + nsf) / 3"),
}


@plan("s10_ablation", "SELECT out, process_id, row_number() OVER (PARTITION BY out ORDER BY round(v, 9) DESC, process_id) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS out, process_id, round({a or '(nf + nt + nm) / 3'}, 12) * round({e or '(nd + (1 - ne) + nsf + (1 - nc)) / 4'}, 12) AS v FROM norm" for c, (a, e) in ABLATED.items()) + ")")
def _(s, d):
    cols = ["nf", "nt", "nm", "nd", "ne", "ns", "nc"]
    table = [(out, *[0.0 if c == out else 1.0 for c in cols]) for out in ABLATED]
    weights = s.createDataFrame(table, "scenario string, " + ", ".join(f"w_{c} double" for c in cols))
    found = sc.scores(parts(s, d), weights, 12).withColumn("opportunity", F.round("opportunity", 9))
    return sc.ranks(found, over=["scenario"]).select(F.col("scenario").alias("out"), "process_id", "rank")


@plan("s13_rank_robustness", f"SELECT process_id, min(rank) AS best, max(rank) AS worst, max(rank) - min(rank) AS range, list_sort(list(rank))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median FROM ({SRANK}) GROUP BY 1")
def _(s, d):
    return sc.rank_robustness(scenario_ranks(s, d))


RANKED = "SELECT process_id, row_number() OVER (ORDER BY opportunity DESC, process_id) AS rank FROM scored"
GOOD = "SELECT session_id FROM canon GROUP BY 1 HAVING count(browser_domain) / count(*) >= 0.45"


def _only(body: str) -> str:
    """The SQL with executions of healthy sessions only."""
    found = sql(body)
    return found.replace("FROM exec e LEFT JOIN sigs s USING (session_id, seg_no)", f"FROM exec e LEFT JOIN sigs s USING (session_id, seg_no) WHERE e.session_id IN ({GOOD})")


@plan("s15_without_degraded")
def _(s, d):
    """Ranks by opportunity over all sessions and without the degraded ones."""
    good = base.canon(s, d).groupBy("session_id").agg((F.count("browser_domain") / F.count("*")).alias("c")).where("c >= 0.45")

    def ranked(rows_: DataFrame, name: str) -> DataFrame:
        return sc.ranks(sc.scores(sc.normalised(profile_of(rows_)))).select("process_id", F.col("rank").alias(name))

    every = rows(s, d)
    both = ranked(every, "all_rank").join(ranked(every.join(good, "session_id", "left_semi"), "healthy_rank"), "process_id", "full")
    return both.withColumn("delta", F.col("all_rank") - F.col("healthy_rank"))


ORACLE["s15_without_degraded"] = f"SELECT process_id, a.rank AS all_rank, b.rank AS healthy_rank, a.rank - b.rank AS delta FROM ({sql(RANKED)}) a FULL JOIN ({_only(RANKED)}) b USING (process_id)"


@plan("s16_expectations", "SELECT name, value, actual, value = actual AS holds FROM (SELECT 'events' AS name, (SELECT count(*) FROM events)::DOUBLE AS value, (SELECT sum(event_count) FROM exec)::DOUBLE AS actual UNION ALL SELECT 'executions', (SELECT count(*) FROM exec), (SELECT sum(n) FROM prof) UNION ALL SELECT 'recorded_ms', (SELECT sum(duration_ms) FROM exec), (SELECT sum(total_ms) FROM prof) UNION ALL SELECT 'processes', (SELECT count(DISTINCT dominant_context) FROM ctx), (SELECT count(*) FROM prof) UNION ALL SELECT 'sessions', (SELECT count(DISTINCT user_id) FROM events), (SELECT count(DISTINCT session_id) FROM exec) UNION ALL SELECT 'cut_sessions', (SELECT count(*) FROM cut WHERE boundary) + (SELECT count(DISTINCT session_id) FROM canon), (SELECT count(*) FROM exec))")
def _(s, d):
    """Do the figures of the published tables equal those of the tables that they come from?"""
    executions = rows(s, d)
    events, view, cut = s.read.parquet(f"{d}/events.parquet"), dc.profiles(executions), base.cuts(s, d)
    num = lambda c: c.cast("double")
    source = [
        events.agg(num(F.count("*")).alias("events"), num(F.count_distinct("user_id")).alias("sessions")),
        ex.segment_spans(base.segmented(s, d)).agg(num(F.count("*")).alias("executions"), num(F.sum(F.col("end_ms") - F.col("start_ms"))).alias("recorded_ms")),
        ex.dominant_context(base.segmented(s, d), fx.SUFFIXES).agg(num(F.count_distinct("dominant_context")).alias("processes")),
        cut.where("boundary").agg(num(F.count("*")).alias("cuts")).crossJoin(base.canon(s, d).agg(num(F.count_distinct("session_id")).alias("s"))).select((F.col("cuts") + F.col("s")).alias("cut_sessions")),  # one row each
    ]
    shown = [
        executions.agg(num(F.sum("event_count")).alias("events"), num(F.count_distinct("session_id")).alias("sessions"), num(F.count("*")).alias("cut_sessions")),
        view.agg(num(F.sum("n")).alias("executions"), num(F.sum("total_ms")).alias("recorded_ms"), num(F.count("*")).alias("processes")),
    ]

    def long(tables: list[DataFrame]) -> DataFrame:
        parts_ = [t.unpivot([], t.columns, "name", "value") for t in tables]
        out = parts_[0]
        for t in parts_[1:]:
            out = out.unionByName(t)
        return out

    return sc.checked(long(source), long(shown), 0.0)


# evaluation


def truth(s: SparkSession, d: str) -> DataFrame:
    return base.labelled(s, d).withColumn("predicted", b.pause_and_change(base.HALF_DAY))


PRED = "SELECT *, delta_t_ms > 43200000 AND (application_changed OR window_title_changed OR browser_domain_changed OR interaction_category_changed) AS predicted FROM labelled"
PRF = "coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r"


@plan("v01_boundary_metrics", f"SELECT session_id, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (SELECT *, {PRF} FROM (SELECT session_id, count(*) FILTER (is_boundary AND predicted) AS tp, count(*) FILTER (NOT is_boundary AND predicted) AS fp, count(*) FILTER (is_boundary AND NOT predicted) AS fn FROM ({PRED}) GROUP BY ROLLUP (session_id)))")
def _(s, d):
    return _r(ev.boundary_metrics(truth(s, d), "is_boundary", "predicted", ["session_id"]), "precision", "recall", "f1")


EM = """SELECT {k} count(*) AS n_executions, count(*) FILTER (c = 0) AS n_missed, CAST(sum(greatest(c - 1, 0)) AS BIGINT) AS over, count(DISTINCT case_id) FILTER (c > 1) AS n_fragmented FROM (SELECT g.session_id, g.case_id, coalesce(c, 0) AS c FROM gt g LEFT JOIN (SELECT session_id, case_id, count(*) AS c FROM over GROUP BY ALL) USING (session_id, case_id)) {g}"""
ES = """SELECT {k} count(*) AS n_segments, count(*) FILTER (c = 0) AS n_noise, count(*) FILTER (c > 0) AS touching, CAST(sum(greatest(c - 1, 0)) AS BIGINT) AS under FROM (SELECT s.session_id, s.seg_no, coalesce(c, 0) AS c FROM spans s LEFT JOIN (SELECT session_id, seg_no, count(*) AS c FROM over GROUP BY ALL) USING (session_id, seg_no)) {g}"""
RATES = "round(coalesce(over / nullif(n_executions, 0), 0), 9) AS over_rate, round(coalesce(under / nullif(touching, 0), 0), 9) AS under_rate, round(coalesce(100 * n_fragmented / nullif(n_executions, 0), 0), 9) AS pct_fragmented"


def _metrics(s, d, by):
    seg = ex.segment_spans(base.segmented(s, d))
    gt = fx.ground_truth(s, d)
    return _r(ev.execution_metrics(seg, gt, jn.overlaps(seg, gt, 30 * 24 * fx.HOUR), by), "over_rate", "under_rate", "pct_fragmented")


@plan("v02_execution_metrics", f"SELECT *, {RATES} FROM ({EM.format(k='session_id,', g='GROUP BY session_id')}) FULL JOIN ({ES.format(k='session_id,', g='GROUP BY session_id')}) USING (session_id)")
def _(s, d):
    return _metrics(s, d, ["session_id"])


@plan("v03_pooled_metrics", f"SELECT *, {RATES} FROM ({EM.format(k='', g='')}), ({ES.format(k='', g='')})")
def _(s, d):
    return _metrics(s, d, [])


#: The threshold grid: coarse and high points, and 40 percentiles of the upper quarter. Fixed values.
COARSE, HIGH = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], [0.8, 0.9, 0.95, 0.99, 0.999]
DENSE = [round((75 + k * 24.9 / 39) / 100, 12) for k in range(40)]


@plan("v05_threshold_grid", f"SELECT DISTINCT unnest(list_concat({COARSE}::DOUBLE[], list_concat(list_transform(quantile_cont(delta_t_ms / (delta_t_ms + 43200000), {DENSE}), lambda x: round(x, 4)), {HIGH}::DOUBLE[]))) AS threshold FROM trans")
def _(s, d):
    """The score is the gap's part of itself and half a day."""
    scored_ = base.trans(s, d).select((F.col("delta_t_ms") / (F.col("delta_t_ms") + base.HALF_DAY)).alias("score"))
    return ev.threshold_grid(scored_, "score", DENSE, [*COARSE, *HIGH])


@plan("v06_threshold_metrics", "SELECT t.threshold, count(*) FILTER (is_boundary AND density_before >= t.threshold) AS tp, count(*) FILTER (NOT is_boundary AND density_before >= t.threshold) AS fp FROM labelled, (VALUES (1), (2), (3), (5)) AS t(threshold) GROUP BY 1")
def _(s, d):
    grid = s.createDataFrame([(1,), (2,), (3,), (5,)], "threshold int")
    return ev.at_thresholds(base.labelled(s, d), "is_boundary", "density_before", grid)


CURVE = f"SELECT threshold, tp, fp, fn, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT *, {PRF} FROM (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () - sum(pos) OVER w AS fn FROM (SELECT density_before AS threshold, count(*) FILTER (is_boundary) AS pos, count(*) FILTER (NOT is_boundary) AS neg FROM labelled GROUP BY 1) WINDOW w AS (ORDER BY threshold DESC)))"


@plan("v07_score_curve", f"SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(f1, 9) AS f1 FROM ({CURVE})")
def _(s, d):
    return _r(ev.score_curve(base.labelled(s, d), "is_boundary", "density_before"), "f1").select("threshold", "tp", "fp", "fn", "f1")


@plan("v07_best_f1", f"SELECT arg_max(threshold, (f1, threshold)) AS threshold, round(max(f1), 9) AS f1 FROM ({CURVE}) WHERE r >= 0.2")
def _(s, d):
    return _r(ev.best_f1(ev.score_curve(base.labelled(s, d), "is_boundary", "density_before"), 0.2), "f1")


AUC = "SELECT {k} round(sum((v1 > v0)::INT + 0.5 * (v1 = v0)::INT) / count(*), 9) AS auc FROM (SELECT {a} b.v AS v1, n.v AS v0 FROM {src} b JOIN {src} n ON b.y AND NOT n.y {on}) {g}"


@plan("v08_auc", "SELECT n_pos, n_neg, round(u / (n_pos * n_neg), 9) AS auc FROM (SELECT sum(pos * (below + neg / 2)) AS u, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT delta_t_ms AS v, count(*) FILTER (is_boundary) AS pos, count(*) FILTER (NOT is_boundary) AS neg FROM labelled GROUP BY 1)))")
def _(s, d):
    return _r(ev.auc(base.labelled(s, d), "delta_t_ms", "is_boundary"), "auc").select("n_pos", "n_neg", "auc")


#: 35 features: nine of the transition, eight of the windows of 3, 5 and 10 events, two forms of the gap.
WINDOWED = ("types_jaccard", "apps_jaccard", "domains_jaccard", "duration_before", "duration_after", "text_before", "text_after", "before_share")
FEATS = (*ln.FIRST, *(f"{c}_{n}" for n in (3, 5, 10) for c in WINDOWED), "delta_t_ms", "gap_to_median")


def _win_sql(n: int) -> str:
    found = sql("SELECT session_id, idx, * EXCLUDE (session_id, idx), duration_before / nullif(duration_before + duration_after, 0) AS before_share FROM traj")
    return found.replace("4 FOLLOWING", f"{n - 1} FOLLOWING").replace("4 PRECEDING", f"{n - 1} PRECEDING")


FEAT_ROWS = "SELECT l.*, delta_t_ms / nullif(median(delta_t_ms) OVER (PARTITION BY l.session_id), 0) AS gap_to_median, " + ", ".join(f"w{n}.{c} AS {c}_{n}" for n in (3, 5, 10) for c in WINDOWED) + " FROM labelled l " + " ".join(f"JOIN ({_win_sql(n)}) w{n} ON w{n}.session_id = l.session_id AND w{n}.idx = l.idx" for n in (3, 5, 10))


@plan("v09_feature_aucs", "SELECT feature, n_pos, n_neg, CASE WHEN k > 1 THEN round(u / nullif(n_pos * n_neg, 0), 9) END AS auc FROM (SELECT feature, sum(pos * (below + neg / 2)) AS u, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, count(*) AS k FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT feature, v, count(*) FILTER (is_boundary) AS pos, count(*) FILTER (NOT is_boundary) AS neg FROM (SELECT is_boundary, unnest([" + ", ".join(f"{{'feature': '{f}', 'v': round(CAST({f} AS DOUBLE), 9)}}" for f in FEATS) + f"], recursive := true) FROM ({FEAT_ROWS})) WHERE v IS NOT NULL GROUP BY 1, 2)) GROUP BY 1)")
def _(s, d):
    events, t = base.canon(s, d), base.labelled(s, d)
    for n in (3, 5, 10):
        w = sq.trajectories(sq.windows(events, n)).withColumn("before_share", F.try_divide("duration_before", F.col("duration_before") + F.col("duration_after")))
        t = t.join(w.select("session_id", "idx", *(F.col(c).alias(f"{c}_{n}") for c in WINDOWED)), ["session_id", "idx"])
    t = t.withColumn("gap_to_median", F.try_divide("delta_t_ms", F.median("delta_t_ms").over(Window.partitionBy("session_id"))))
    long = t.select("is_boundary", *(F.round(F.col(f).cast("double"), 9).alias(f) for f in FEATS)).unpivot(["is_boundary"], list(FEATS), "feature", "v")
    return _r(ev.auc(long, "v", "is_boundary", ["feature"]), "auc").select("feature", "n_pos", "n_neg", "auc")


@plan("v10_direction_consistency", "SELECT count(*) AS n_sessions, count(*) FILTER (sign(own) = sign(pooled)) AS n_agree FROM (SELECT avg(delta_t_ms) FILTER (is_boundary) - avg(delta_t_ms) FILTER (NOT is_boundary) AS own FROM labelled GROUP BY session_id), (SELECT avg(delta_t_ms) FILTER (is_boundary) - avg(delta_t_ms) FILTER (NOT is_boundary) AS pooled FROM labelled) WHERE own IS NOT NULL")
def _(s, d):
    return ev.direction_consistency(base.labelled(s, d), "delta_t_ms", "is_boundary")


@plan("v11_gap_distributions", "SELECT is_boundary, n, round(mean, 3) AS mean, median, round(deviation, 3) AS deviation, low, high, l[CAST(least(floor(n * 0.25), n - 1) AS BIGINT) + 1] AS p25, l[CAST(least(floor(n * 0.9), n - 1) AS BIGINT) + 1] AS p90 FROM (SELECT is_boundary, count(*) AS n, avg(delta_t_ms) AS mean, median(delta_t_ms) AS median, stddev_pop(delta_t_ms) AS deviation, min(delta_t_ms) AS low, max(delta_t_ms) AS high, list_sort(list(delta_t_ms)) AS l FROM labelled GROUP BY 1)")
def _(s, d):
    return _r(ev.nearest_rank(base.labelled(s, d), "delta_t_ms", [0.25, 0.9], ["is_boundary"]), "mean", "deviation", places=3)


SF1 = "SELECT session_id, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT session_id, {prf} FROM (SELECT session_id, count(*) FILTER (is_boundary AND {x}) AS tp, count(*) FILTER (NOT is_boundary AND {x}) AS fp, count(*) FILTER (is_boundary AND NOT {x}) AS fn FROM labelled GROUP BY 1))"


@plan("v12_robustness", f"SELECT CASE WHEN b - a > 0.01 THEN 'improved' WHEN a - b > 0.01 THEN 'degraded' ELSE 'unchanged' END AS kind, count(*) AS n, round(avg(b - a), 9) AS mean_change FROM (SELECT x.f1 AS a, y.f1 AS b FROM ({SF1.format(prf=PRF, x='(delta_t_ms > 43200000)')}) x JOIN ({SF1.format(prf=PRF, x='application_changed')}) y USING (session_id)) GROUP BY 1")
def _(s, d):
    lab = base.labelled(s, d).withColumn("a", b.pause(base.HALF_DAY))
    per = lambda c: ev.boundary_metrics(lab, "is_boundary", c, ["session_id"]).where("session_id IS NOT NULL")
    return _r(ev.compared(per("a"), per("application_changed"), "f1", 0.01), "mean_change")


@plan("v15_complementarity", "SELECT delta_t_ms > 43200000 AS a, application_changed AS b, count(*) AS n FROM labelled WHERE is_boundary GROUP BY ALL")
def _(s, d):
    return base.labelled(s, d).where("is_boundary").groupBy(b.pause(base.HALF_DAY).alias("a"), F.col("application_changed").alias("b")).agg(F.count("*").alias("n"))


@plan("v18_rule_counts", f"SELECT rule, count(*) AS n, count(*) FILTER (NOT final) AS removed, count(*) FILTER (NOT final AND is_boundary) AS true_removed FROM ({base.FINAL}) r JOIN labelled USING (session_id, idx) WHERE candidate GROUP BY 1")
def _(s, d):
    done = b.reconstruct(base.evidence(s, d), 0.6).where("candidate").join(base.labelled(s, d).select("session_id", "idx", "is_boundary"), ["session_id", "idx"])
    return done.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.expr("NOT final")).alias("removed"), F.count_if(F.expr("NOT final AND is_boundary")).alias("true_removed"))


CO = ("application_changed", "window_title_changed", "browser_domain_changed")


@plan("v20_co_occurrence", " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, count(*) FILTER ({x} AND {y}) AS n_both, count(*) FILTER ({x} OR {y}) AS n_any, round(count(*) FILTER ({x} AND {y}) / nullif(count(*) FILTER ({x} OR {y}), 0), 9) AS jaccard FROM trans" for i, x in enumerate(CO) for y in CO[i + 1 :]))
def _(s, d):
    return _r(ev.co_occurrence(base.trans(s, d), CO), "jaccard")


#: 17 pauses, in hours: the reference's are in milliseconds, of denser logs.
PAUSES = (1, 2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 30, 36, 48, 60, 72, 96)
CHANGED = "(application_changed OR window_title_changed OR browser_domain_changed OR interaction_category_changed)"


@plan("v26_pause_sweep", "SELECT tau, rule, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (SELECT *, " + PRF + " FROM (" + " UNION ALL ".join(f"SELECT tau, '{n}' AS rule, count(*) FILTER (is_boundary AND {x}) AS tp, count(*) FILTER (NOT is_boundary AND {x}) AS fp, count(*) FILTER (is_boundary AND NOT {x}) AS fn FROM labelled, (SELECT unnest({[h * fx.HOUR for h in PAUSES]}) AS tau) GROUP BY 1" for n, x in (("pause", "(delta_t_ms > tau)"), ("pause_and_change", f"(delta_t_ms > tau AND {CHANGED})"), ("pause_or_change", f"(delta_t_ms > tau OR {CHANGED})"))) + "))")
def _(s, d):
    """Every rule at every pause from one pass of conditional counts; no row is multiplied."""
    rules = {"pause": b.pause, "pause_and_change": b.pause_and_change, "pause_or_change": b.pause_or_change}
    return _r(ev.swept_metrics(base.labelled(s, d), "is_boundary", {(h * fx.HOUR, n): f(h * fx.HOUR) for h in PAUSES for n, f in rules.items()}), "precision", "recall", "f1")


SWEEP = "SELECT session_id, param, count(*) FILTER (is_boundary AND delta_t_ms > param) AS tp, count(*) FILTER (NOT is_boundary AND delta_t_ms > param) AS fp, count(*) FILTER (is_boundary AND NOT delta_t_ms > param) AS fn FROM labelled, (VALUES (21600000), (43200000), (86400000)) AS t(param) GROUP BY ALL"


@plan("m06_held_out_choice", f"SELECT session_id, param, round(f1, 9) AS f1 FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT session_id, param, {PRF} FROM (SELECT session_id, param, sum(tp) OVER w - tp AS tp, sum(fp) OVER w - fp AS fp, sum(fn) OVER w - fn AS fn FROM ({SWEEP}) WINDOW w AS (PARTITION BY param)))) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round(f1, 12) DESC, param) = 1")
def _(s, d):
    params = F.explode(F.array(*(F.lit(h * fx.HOUR) for h in (6, 12, 24)))).alias("param")
    swept = base.labelled(s, d).select("session_id", "is_boundary", "delta_t_ms", params).withColumn("p", F.col("delta_t_ms") > F.col("param"))
    counts = swept.groupBy("session_id", "param").agg(F.count_if(F.expr("is_boundary AND p")).alias("tp"), F.count_if(F.expr("NOT is_boundary AND p")).alias("fp"), F.count_if(F.expr("is_boundary AND NOT p")).alias("fn"))
    return _r(ev.held_out_choice(counts), "f1")


IMPACTS = {"A_frequency_total": ("nf", "nt", "nm"), "B_frequency_average": ("nf", "na", "nm"), "C_total_average": ("nt", "na", "nm"), "D_frequency_manual": ("nf", "nm")}
AVERAGED = "SELECT norm.*, CASE WHEN max(total_ms / n) OVER () = min(total_ms / n) OVER () THEN 0.5 ELSE (total_ms / n - min(total_ms / n) OVER ()) / (max(total_ms / n) OVER () - min(total_ms / n) OVER ()) END AS na FROM norm JOIN (SELECT process_id, n, total_ms FROM prof) USING (process_id)"


@plan("s11_impact_variants", "SELECT variant, process_id, round(impact, 9) AS impact, row_number() OVER (PARTITION BY variant ORDER BY round(round(impact, 9) * feasibility, 9) DESC, process_id) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS variant, process_id, ({' + '.join(cs)}) / {len(cs)} AS impact FROM ({AVERAGED})" for k, cs in IMPACTS.items()) + ") JOIN (SELECT process_id, feasibility FROM scored) USING (process_id)")
def _(s, d):
    prof = profile(s, d).withColumn("average_ms", F.col("total_ms") / F.col("n"))
    every = sc.normalised(prof).join(prof.select("process_id", sc.min_max("average_ms").alias("na")), "process_id").join(sc.scores(sc.normalised(prof)).select("process_id", "feasibility"), "process_id")
    cells = F.array(*(F.struct(F.lit(k).alias("variant"), F.round(sum((F.col(c) for c in cs), F.lit(0.0)) / len(cs), 9).alias("impact")) for k, cs in IMPACTS.items()))
    long = every.select("process_id", "feasibility", F.explode(cells).alias("x")).select("process_id", "x.variant", "x.impact", F.round(F.col("x.impact") * F.col("feasibility"), 9).alias("opportunity"))
    return sc.ranks(long, over=["variant"]).select("variant", "process_id", "impact", "rank")


CLIPPED = "SELECT process_id, {v}, CASE WHEN n < 3 THEN {v} ELSE least(greatest({v}, max(CASE WHEN r = k THEN {v} END) OVER ()), max(CASE WHEN r = n - 1 - k THEN {v} END) OVER ()) END AS w FROM (SELECT process_id, {v}, row_number() OVER (ORDER BY {v}, process_id) - 1 AS r, count(*) OVER () AS n, CAST(floor(count(*) OVER () * 0.1) AS BIGINT) AS k FROM ({src}))"
SHARES = "SELECT process_id, n / sum(n) OVER () AS frequency_share, total_ms / sum(total_ms) OVER () AS time_share, manual_share FROM prof"
CLIPPED_NORM = "SELECT process_id, CASE WHEN max(w) OVER () = min(w) OVER () THEN 0.5 ELSE (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) END AS x FROM ({c})"


@plan("s12_winsorised_ranks", f"SELECT process_id, d.rank AS default_rank, row_number() OVER (ORDER BY round((a.x + b.x + c.x) / 3, 9) * feasibility DESC, process_id) AS winsorised_rank FROM ({CLIPPED_NORM.format(c=CLIPPED.format(v='frequency_share', src=SHARES))}) a JOIN ({CLIPPED_NORM.format(c=CLIPPED.format(v='time_share', src=SHARES))}) b USING (process_id) JOIN ({CLIPPED_NORM.format(c=CLIPPED.format(v='manual_share', src=SHARES))}) c USING (process_id) JOIN scored USING (process_id) JOIN (SELECT process_id, row_number() OVER (ORDER BY opportunity DESC, process_id) AS rank FROM scored) d USING (process_id)")
def _(s, d):
    """Ranks with the three parts of the impact winsorised, beside the default ones."""
    base_profile = profile(s, d)
    held = base_profile
    for c in ("frequency_share", "time_share", "manual_share"):
        held = sc.winsorised(held, c, 0.1)
    default = sc.ranks(sc.scores(sc.normalised(base_profile)))
    impact = sc.scores(sc.normalised(held)).select("process_id", F.col("impact").alias("held_impact"))
    both = default.join(impact, "process_id").withColumn("held", F.col("held_impact") * F.col("feasibility"))
    return sc.ranks(both.withColumnRenamed("rank", "default_rank"), "held").select("process_id", "default_rank", F.col("rank").alias("winsorised_rank"))


MERGES = (0, 5, 11, 36)
BY_MERGE = " UNION ALL ".join(f"SELECT {k} AS k, process_id, rank FROM ({sql(RANKED).replace('start_idx - left_end - 1 <= 2', f'start_idx - left_end - 1 <= {k}')})" for k in MERGES)


@plan("s14_merge_sensitivity")
def _(s, d):
    """Ranks by opportunity at each merge threshold, and each process's class: stable where its rank moves by one at most,
    absent where some threshold lacks it."""
    events = written(base.canon(s, d), "events")
    raw = written(b.system_change(events), "cuts")
    out = None
    for k in MERGES:
        seg = sq.segments(events, b.merge_leave_and_return(events, raw, k))
        ranked = sc.ranks(sc.scores(sc.normalised(profile_of(rows_of(seg))))).select(F.lit(k).alias("k"), "process_id", "rank")
        out = ranked if out is None else out.unionByName(ranked)
    return sc.stability(out, len(MERGES))


ORACLE["s14_merge_sensitivity"] = f"SELECT process_id, count(*) AS n_thresholds, min(rank) AS best, max(rank) AS worst, max(rank) FILTER (k = 5) AS rank_at_5, CASE WHEN count(*) < {len(MERGES)} THEN 'absent' WHEN max(rank) - min(rank) <= 1 THEN 'stable' WHEN max(rank) - min(rank) <= 3 THEN 'shifting' ELSE 'unstable' END AS stability FROM ({BY_MERGE}) GROUP BY 1"


@plan("v04_signal_evaluation", """SELECT count(*) AS n_points, count(*) FILTER (d <= 86400000) AS covered, round(avg(d), 3) AS mean_distance_ms FROM (SELECT p.session_id, p.at_ms, min(abs(c.timestamp_ms - p.at_ms)) AS d FROM points p JOIN canon c ON c.session_id = p.session_id AND c.event_type = 'error' GROUP BY ALL)""")
def _(s, d):
    near = jn.nearest(base.points(s, d), base.canon(s, d).where("event_type = 'error'"), "at_ms", "timestamp_ms").where("distance_ms IS NOT NULL")
    return near.agg(F.count("*").alias("n_points"), F.count_if(F.col("distance_ms") <= 24 * fx.HOUR).alias("covered"), F.round(F.avg("distance_ms"), 3).alias("mean_distance_ms"))


@plan("v17_false_boundaries", f"SELECT is_boundary, predicted, case_id IS NOT NULL AS inside, count(*) AS n FROM ({PRED}) l JOIN (SELECT session_id, idx, case_id FROM cased) USING (session_id, idx) GROUP BY ALL")
def _(s, d):
    both = truth(s, d).join(base.cased(s, d).select("session_id", "idx", "case_id"), ["session_id", "idx"])
    return both.groupBy("is_boundary", "predicted", F.col("case_id").isNotNull().alias("inside")).agg(F.count("*").alias("n"))


@plan("v21_flag_clusters", "SELECT case_id, count(*) AS n_clusters, max(l) AS longest FROM (SELECT case_id, g, count(*) AS l FROM (SELECT *, sum(CAST(NOT flag AS INTEGER)) OVER (PARTITION BY session_id, case_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT t.session_id, t.idx, g.case_id, application_changed AS flag FROM trans t JOIN gt g ON g.session_id = t.session_id AND g.start_ms <= t.timestamp_ms AND t.next_timestamp_ms <= g.end_ms)) WHERE flag GROUP BY ALL) GROUP BY 1")
def _(s, d):
    inner = jn.inside(base.trans(s, d), fx.ground_truth(s, d))
    runs = sq.runs(inner, "application_changed", ("session_id", "case_id")).where("value")
    return runs.groupBy("case_id").agg(F.count("*").alias("n_clusters"), F.max("length").alias("longest"))


@plan("v22_tempo_sweep", f"SELECT density_before AS threshold, count(*) AS n, count(*) FILTER (is_boundary) AS true_cuts FROM ({base.FINAL}) JOIN (SELECT session_id, idx, is_boundary FROM labelled) USING (session_id, idx) WHERE rule = 'rule_4_continuity' AND NOT final GROUP BY 1")
def _(s, d):
    demoted = b.reconstruct(base.evidence(s, d), 0.6).where("rule = 'rule_4_continuity' AND NOT final")
    both = demoted.join(base.labelled(s, d).select("session_id", "idx", "is_boundary"), ["session_id", "idx"])
    return both.groupBy(F.col("density_before").alias("threshold")).agg(F.count("*").alias("n"), F.count_if("is_boundary").alias("true_cuts"))


@plan("v23_stratified_pairs", f"SELECT gap, count(*) AS n, count(*) FILTER (same) AS n_same, CASE WHEN count(*) < 50 THEN 'few' ELSE '' END AS note FROM ({base.CAPPED}) GROUP BY 1")
def _(s, d):
    pairs = jn.offset_pairs(base.cased(s, d), "case_id", [1, 2, 5, 10, 25], 200)
    return pairs.groupBy("gap").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"), F.when(F.count("*") < 50, "few").otherwise("").alias("note"))


@plan("v23_stratified_pairs_all", f"SELECT gap, count(*) AS n, count(*) FILTER (same) AS n_same, CASE WHEN count(*) < 50 THEN 'few' ELSE '' END AS note FROM ({base.EVERY}) GROUP BY 1")
def _(s, d):
    pairs = jn.offset_pairs(base.cased(s, d), "case_id", base.GAPS)
    return pairs.groupBy("gap").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"), F.when(F.count("*") < 50, "few").otherwise("").alias("note"))


@plan("v25_review_checks", "SELECT kind, count(*) AS n FROM (SELECT case_id, CASE WHEN n_events = 1 THEN 'missing' WHEN n_events > 20 THEN 'invalid' END AS kind FROM gt) WHERE kind IS NOT NULL GROUP BY 1")
def _(s, d):
    n = base.cased(s, d).where("case_id IS NOT NULL").groupBy("case_id").agg(F.count("*").alias("n_events"))
    judged = n.where("n_events > 1").select("case_id", F.when(F.col("n_events") > 20, "bad").otherwise("ok").alias("label"))
    both = n.join(judged, "case_id", "full")
    kind = F.when(F.col("label").isNull(), "missing").when(~F.col("label").isin("ok", "not_ok"), "invalid")
    return both.select(kind.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))
