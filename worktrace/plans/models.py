"""Plans for learning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace import fixtures as fx
from worktrace.operators import boundary as b
from worktrace.operators import discovery as dc
from worktrace.operators import evaluation as ev
from worktrace.operators import joins as jn
from worktrace.operators import learning as ln
from worktrace.operators import sequence as sq
from worktrace.plans import processes
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


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@plan("m01_first_vectors", "SELECT session_id, idx, " + ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in ln.FIRST) + " FROM trans")
def _(s, d):
    return _r(ln.vectors(base.trans(s, d), ln.FIRST, ["session_id", "idx"]), *ln.FIRST)


def second(s: SparkSession, d: str) -> DataFrame:
    rows = base.labelled(s, d).join(sq.trajectories(sq.windows(base.canon(s, d), 5)), ["session_id", "idx"])
    return ln.vectors(rows, ln.SECOND, ["session_id", "idx", "is_boundary"])


@plan("m02_second_vectors", "SELECT session_id, idx, is_boundary, " + ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), 0), 9) AS {c}" for c in ln.SECOND) + " FROM labelled JOIN traj USING (session_id, idx)")
def _(s, d):
    return _r(second(s, d), *ln.SECOND)


@plan("m04_held_out_scores")
def _(s, d):
    return ln.held_out_scores(second(s, d), ln.SECOND, "is_boundary", "session_id").select("session_id", "idx", "is_boundary", "fold", "score")


@plan("m08_operator_baselines", "SELECT operator, n, round(CASE WHEN n < 2460 THEN gm ELSE m END, 9) AS centre, round(greatest(CASE WHEN n < 2460 THEN gd ELSE d END, 1e-6), 9) AS spread FROM (SELECT operator, m, count(*) AS n, median(abs(g - m)) AS d FROM (SELECT operator, log1p_delta_t_ms AS g, median(log1p_delta_t_ms) OVER (PARTITION BY operator) AS m FROM trans JOIN (SELECT DISTINCT session_id, operator FROM canon) USING (session_id)) GROUP BY 1, 2), (SELECT gm, median(abs(g - gm)) AS gd FROM (SELECT log1p_delta_t_ms AS g, median(log1p_delta_t_ms) OVER () AS gm FROM trans) GROUP BY 1)")
def _(s, d):
    who = base.canon(s, d).select("session_id", "operator").distinct()
    return _r(ln.operator_baselines(base.trans(s, d).join(who, "session_id"), 2460), "centre", "spread")


@plan("m10_execution_features", "SELECT session_id, case_id, count(*) AS n, " + ", ".join(f"round(avg(CAST(event_type = '{v}' AS INTEGER)), 9) AS share_{v}" for v in ("view", "click", "error")) + " FROM cased WHERE case_id IS NOT NULL GROUP BY ALL")
def _(s, d):
    out = ln.fractions(base.cased(s, d).where("case_id IS NOT NULL"), ["session_id", "case_id"], "event_type", ["view", "click", "error"])
    return _r(out, "share_view", "share_click", "share_error")


@plan("m11_vocabulary", "SELECT system AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, system) AS rank FROM canon WHERE system IS NOT NULL GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, system) <= 5")
def _(s, d):
    return ln.vocabulary(base.canon(s, d), "system", 5)


@plan("m12_distinct_between", f"SELECT a.session_id, a.idx AS i, b.idx AS j, count(DISTINCT c.application) AS n_distinct FROM cased a JOIN cased b ON a.session_id = b.session_id AND b.idx - a.idx IN ({', '.join(map(str, base.LINKED))}) JOIN canon c ON c.session_id = a.session_id AND c.idx BETWEEN a.idx AND b.idx WHERE a.case_id IS NOT NULL AND b.case_id IS NOT NULL GROUP BY ALL")
def _(s, d):
    return ln.distinct_of_pairs(base.cased(s, d), "case_id", "application", base.LINKED)


@plan("m12_distinct_between_all", f"SELECT p.session_id, i, j, count(DISTINCT application) AS n_distinct FROM ({base.EVERY}) p JOIN canon c ON c.session_id = p.session_id AND c.idx BETWEEN i AND j GROUP BY ALL")
def _(s, d):
    pairs = jn.offset_pairs(base.cased(s, d), "case_id", base.GAPS)
    return ln.distinct_at_gaps(pairs, base.canon(s, d), "application", base.GAPS)


@plan("m13_clusters")
def _(s, d):
    rows = ln.fractions(base.segmented(s, d), ["session_id", "seg_no"], "interaction_category", list(fx.CATEGORIES.values()))
    return ln.clusters(rows, [f"share_{c}" for c in fx.CATEGORIES.values()], [3, 5], ["session_id", "seg_no"])


@plan("m14_agreement", """SELECT round((cxy - cx * cy / (t * (t - 1) / 2)) / ((cx + cy) / 2 - cx * cy / (t * (t - 1) / 2)), 9) AS ari, round(2 * (hx + hy - hxy) / (hx + hy), 9) AS nmi FROM
(SELECT sum(n * (n - 1) / 2) AS cxy, -sum(p * ln(p)) AS hxy, sum(n) AS t FROM (SELECT count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM cased WHERE process_code IS NOT NULL AND application IS NOT NULL GROUP BY process_code, application)),
(SELECT sum(n * (n - 1) / 2) AS cx, -sum(p * ln(p)) AS hx FROM (SELECT count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM cased WHERE process_code IS NOT NULL AND application IS NOT NULL GROUP BY process_code)),
(SELECT sum(n * (n - 1) / 2) AS cy, -sum(p * ln(p)) AS hy FROM (SELECT count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM cased WHERE process_code IS NOT NULL AND application IS NOT NULL GROUP BY application))""")
def _(s, d):
    codes = fx.ground_truth(s, d).select("case_id", "process_code")
    return _r(ln.agreement(base.cased(s, d).join(codes, "case_id").where("application IS NOT NULL"), "process_code", "application"), "ari", "nmi")


@plan("b17_hmm_boundaries")
def _(s, d):
    return ln.hmm_boundaries(base.trans(s, d), ["log1p_delta_t_ms", "density_before"], [2, 3, 4, 5, 6, 8])


@plan("b18_best_cuts")
def _(s, d):
    t = base.trans(s, d)
    w = sq.ordered().rowsBetween(sq.Window.unboundedPreceding, 0)
    x = F.col("log1p_delta_t_ms")
    sums = t.select("session_id", F.col("idx").alias("place"), F.sum(x).over(w).alias("s"), F.sum(x * x).over(w).alias("q"), F.count("*").over(w).alias("n"), b.pause(12 * fx.HOUR).alias("c"), (F.lead("idx").over(sq.ordered()).isNull()).alias("last"))
    return ln.best_cuts(sums.where("c OR last").drop("c", "last"), 2.0)


@plan("b18_cut_sweep")
def _(s, d):
    """Cuts at each of seven penalties: how many, and in how many sessions."""
    t = base.trans(s, d)
    w = sq.ordered().rowsBetween(sq.Window.unboundedPreceding, 0)
    x = F.col("log1p_delta_t_ms")
    sums = t.select("session_id", F.col("idx").alias("place"), F.sum(x).over(w).alias("s"), F.sum(x * x).over(w).alias("q"), F.count("*").over(w).alias("n"), b.pause(12 * fx.HOUR).alias("c"), (F.lead("idx").over(sq.ordered()).isNull()).alias("last"))
    cuts = ln.best_cuts(sums.where("c OR last").drop("c", "last"), [0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0])
    return cuts.groupBy("penalty").agg(F.count("*").alias("n_cuts"), F.count_distinct("session_id").alias("n_sessions"))


@plan("p17_lcs", f"SELECT process_id, a, b, round(2 * {processes.LCS} / (len(string_split(a, '>')) + len(string_split(b, '>'))), 9) AS lcs FROM ({processes.PAIRED}) WHERE a < b")
def _(s, d):
    return _r(processes.path_pairs(s, d).where("a < b").select("process_id", "a", "b", "lcs"), "lcs")


@plan("v16_fragmentation_diff", "SELECT x.c > 1 AS first, y.c > 1 AS second, count(*) AS n FROM (SELECT case_id, count(o.seg_no) AS c FROM gt LEFT JOIN over o USING (session_id, case_id) GROUP BY 1) x JOIN (SELECT g.case_id, count(s.g) AS c FROM gt g LEFT JOIN (SELECT session_id, g, min(timestamp_ms) AS a, max(timestamp_ms) AS b FROM (SELECT *, coalesce(sum(CAST(p AS INTEGER)) OVER (PARTITION BY session_id ORDER BY idx), 0) AS g FROM (SELECT c.*, lag(delta_t_ms > 86400000) OVER (PARTITION BY c.session_id ORDER BY c.idx) AS p FROM canon c LEFT JOIN trans t USING (session_id, idx))) GROUP BY 1, 2) s ON s.session_id = g.session_id AND s.a < g.end_ms AND g.start_ms < s.b GROUP BY 1) y USING (case_id) GROUP BY ALL")
def _(s, d):
    from worktrace.operators import executions as ex

    gt = fx.ground_truth(s, d)
    bins = 30 * 24 * fx.HOUR

    def pieces(segmented: DataFrame, name: str) -> DataFrame:
        n = jn.overlaps(ex.segment_spans(segmented), gt, bins).groupBy("case_id").agg(F.count("*").alias("n"))
        return gt.join(n, "case_id", "left").select("case_id", (F.coalesce("n", F.lit(0)) > 1).alias(name))

    other = sq.segments(base.canon(s, d), base.trans(s, d).select("session_id", "idx", b.pause(24 * fx.HOUR).alias("boundary")))
    return pieces(base.segmented(s, d), "first").join(pieces(other, "second"), "case_id").groupBy("first", "second").agg(F.count("*").alias("n"))


@plan("v13_concentration", "SELECT operator, sum(CAST(is_boundary AND delta_t_ms > 43200000 AS INTEGER))::BIGINT AS hits, round(sum(CAST(is_boundary AND delta_t_ms > 43200000 AS INTEGER)) / sum(sum(CAST(is_boundary AND delta_t_ms > 43200000 AS INTEGER))) OVER (), 9) AS share FROM labelled JOIN (SELECT DISTINCT session_id, operator FROM canon) USING (session_id) GROUP BY 1")
def _(s, d):
    who = base.canon(s, d).select("session_id", "operator").distinct()
    hits = base.labelled(s, d).join(who, "session_id").groupBy("operator").agg(F.count_if(F.col("is_boundary") & b.pause(base.HALF_DAY)).alias("hits"))
    return hits.withColumn("share", F.round(F.col("hits") / F.sum("hits").over(sq.Window.partitionBy()), 9))


@plan("v14_promotion_gates", f"SELECT f1 > 0.1 AS good_f1, r > 0.3 AS good_recall, f1 > 0.1 AND r > 0.3 AS promoted FROM (SELECT r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT {processes.PRF} FROM (SELECT count(*) FILTER (is_boundary AND predicted) AS tp, count(*) FILTER (NOT is_boundary AND predicted) AS fp, count(*) FILTER (is_boundary AND NOT predicted) AS fn FROM ({processes.PRED}))))")
def _(s, d):
    m = ev.boundary_metrics(processes.truth(s, d), "is_boundary", "predicted")
    return m.select((F.col("f1") > 0.1).alias("good_f1"), (F.col("recall") > 0.3).alias("good_recall"), ((F.col("f1") > 0.1) & (F.col("recall") > 0.3)).alias("promoted"))
