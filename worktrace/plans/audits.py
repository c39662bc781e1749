"""Plans for the data-quality audit, ground truth, logs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace import fixtures as fx
from worktrace.operators import labels as lb
from worktrace.operators import logs as lg
from worktrace.operators import quality as qa
from worktrace.operators import sequence as sq
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


def lines(s: SparkSession, d: str) -> DataFrame:
    """Raw JSON lines of the events: some malformed (k = 13), some without a type (k = 17); fields absent, null and empty."""
    k = F.col("k")
    body = F.to_json(
        F.struct(
            "event_id",
            "session_id",
            F.when(k != 17, F.col("event_type")).alias("event_type"),
            "timestamp_ms",
            F.when(k % 5 == 0, F.lit("")).otherwise(F.col("chunk_id")).alias("note"),
            F.struct(F.when(k % 10 != 9, F.concat(F.lit("app"), (k % 4).cast("string"))).alias("app"), F.when(k % 2 == 0, F.struct(F.concat(F.lit("/r"), (k % 6).cast("string")).alias("url"))).alias("tab")).alias("context"),
            F.struct(F.col("value").alias("amount"), F.when(k % 6 == 0, F.lit("")).otherwise(F.lit("text")).alias("text")).alias("payload"),
            F.map_filter(F.create_map(F.lit("v"), F.lit("1")), lambda a, b: k % 3 != 0).alias("metadata"),
            F.filter(F.array(F.lit("x")), lambda a: k % 4 != 0).alias("tags"),
            F.struct(F.col("chunk_id").alias("chunk_id")).alias("correlation"),
        )
    )
    title = F.when(k % 7 == 0, F.lit(',"title":null}')).otherwise(F.lit(',"title":"t"}'))
    made = fx.raw_events(s, d).select("event_id", "k", body.alias("body")).select("event_id", "k", F.concat(F.expr("left(body, length(body) - 1)"), title).alias("whole"))
    return made.select("event_id", "k", F.when(k == 13, F.concat(F.lit("{"), "whole")).otherwise(F.col("whole")).alias("raw"))


@plan("a02_malformed_lines", "SELECT event_id FROM raw WHERE k = 13")
def _(s, d):
    return qa.malformed(lines(s, d)).select("event_id")


@plan("a03_required_fields", "SELECT count(*) AS n FROM raw WHERE k NOT IN (13, 17)")
def _(s, d):
    good = qa.parsed(lines(s, d)).where("v IS NOT NULL")
    return qa.required(good, ["event_id", "session_id", "event_type", "timestamp_ms"]).agg(F.count("*").alias("n"))


@plan("a03_missing_fields", "SELECT event_id, 'event_type' AS field FROM raw WHERE k = 17")
def _(s, d):
    good = qa.parsed(lines(s, d)).where("v IS NOT NULL")
    return qa.missing_fields(good, ["session_id", "event_type"]).select("event_id", "field")


@plan("a05_session_merge", "SELECT session_id, event_id, idx FROM canon")
def _(s, d):
    return base.canon(s, d).select("session_id", "event_id", "idx")


@plan("a06_typed_events", "SELECT event_id, session_id, CASE WHEN k <> 17 THEN event_type END AS event_type, timestamp_ms FROM raw WHERE k <> 13")
def _(s, d):
    typed = qa.parsed(lines(s, d)).where("v IS NOT NULL")
    at = lambda p, t: F.try_variant_get("v", f"$.{p}", t).alias(p)
    return typed.select(at("event_id", "long"), at("session_id", "string"), at("event_type", "string"), at("timestamp_ms", "long"))


@plan("a10_segments_sink", "SELECT session_id, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS start, strftime(make_timestamp(CASE WHEN start_ms >= end_ms THEN start_ms + 1 ELSE end_ms END * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS \"end\", dominant_context AS label FROM exec")
def _(s, d):
    from worktrace.plans import processes
    from worktrace.sources.sinks import segment_rows

    return segment_rows(processes.rows(s, d), "process_id")


@plan("a11_ground_truth_rows", "SELECT session_id, case_id, process_code, start_ms, end_ms, apps FROM gt LEFT JOIN (SELECT case_id, string_agg(DISTINCT application, '|' ORDER BY application) AS apps FROM cased WHERE case_id IS NOT NULL GROUP BY 1) USING (case_id)")
def _(s, d):
    apps = base.cased(s, d).where("case_id IS NOT NULL AND application IS NOT NULL").groupBy("case_id").agg(F.concat_ws("|", F.array_sort(F.collect_set("application"))).alias("apps"))
    return fx.ground_truth(s, d).join(apps, "case_id", "left").select("session_id", "case_id", "process_code", "start_ms", "end_ms", "apps")


#: Paths with the condition under which each is absent, null or empty in ``lines``.
PATHS = {
    "$.event_id": ("false", "false", "false"), "$.session_id": ("false", "false", "false"), "$.event_type": ("k = 17", "false", "false"), "$.timestamp_ms": ("false", "false", "false"),
    "$.note": ("false", "false", "k % 5 = 0"), "$.title": ("false", "k % 7 = 0", "false"), "$.context.app": ("k % 10 = 9", "false", "false"), "$.context.tab": ("k % 2 = 1", "false", "false"),
    "$.context.tab.url": ("k % 2 = 1", "false", "false"), "$.payload.amount": ("false", "false", "false"), "$.payload.text": ("false", "false", "k % 6 = 0"), "$.metadata": ("false", "false", "k % 3 = 0"),
    "$.tags": ("false", "false", "k % 4 = 0"), "$.correlation.chunk_id": ("false", "false", "false"),
}


@plan("q01_missingness", "SELECT path, absent, nulls, empty, round(100 * absent / n, 6) AS pct_absent, round(100 * nulls / n, 6) AS pct_null, round(100 * empty / n, 6) AS pct_empty FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS path, count(*) FILTER ({a}) AS absent, count(*) FILTER ({z}) AS nulls, count(*) FILTER ({e}) AS empty, count(*) AS n FROM raw WHERE k <> 13" for p, (a, z, e) in PATHS.items()) + ")")
def _(s, d):
    out = qa.missingness(qa.parsed(lines(s, d)).where("v IS NOT NULL"), list(PATHS))
    return out.withColumns({c: F.round(c, 6) for c in ("pct_absent", "pct_null", "pct_empty")})


@plan("q02_exact_duplicates", "SELECT count(*) AS n, min(doc_id) AS first_doc_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def _(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    return qa.exact_duplicates(docs.select("doc_id", F.to_variant_object(F.struct("text")).alias("v")), "doc_id")


@plan("q03_semantic_duplicates", "SELECT text, count(DISTINCT doc_id) AS n_ids, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1")
def _(s, d):
    return qa.semantic_duplicates(s.read.parquet(f"{d}/documents.parquet"), ["text"], "doc_id")


@plan("q04_sequential_duplicates", "SELECT session_id, idx FROM (SELECT session_id, idx, event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND application IS NOT DISTINCT FROM lag(application) OVER w AND lag(idx) OVER w IS NOT NULL AS same FROM canon WINDOW w AS (PARTITION BY session_id ORDER BY idx)) WHERE same")
def _(s, d):
    return qa.sequential_duplicates(base.canon(s, d), ["event_type", "application"]).select("session_id", "idx")


@plan("q05_timestamp_quality", "SELECT session_id, count(*) FILTER (gap < 0) AS negative, count(*) FILTER (gap = 0) AS zero, max(gap) AS max_gap, count(*) FILTER (gap < 3600000) AS bucket_0, count(*) FILTER (gap >= 3600000 AND gap < 86400000) AS bucket_1, count(*) FILTER (gap >= 86400000) AS bucket_2 FROM (SELECT session_id, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY idx) AS gap FROM canon) GROUP BY 1")
def _(s, d):
    return qa.timestamp_quality(base.canon(s, d), [fx.HOUR, 24 * fx.HOUR])


@plan("q06_unknown_types", "SELECT interaction_category AS layer, event_type, count(*) AS n FROM canon WHERE event_type IN ('error', 'signup') GROUP BY ALL")
def _(s, d):
    known = s.createDataFrame([("navigation", "view"), ("pointer", "click"), ("clipboard", "purchase")], "layer string, event_type string")
    return qa.unknown_types(base.canon(s, d).withColumnRenamed("interaction_category", "layer"), known)


@plan("q07_emptiness", "SELECT event_type, count(*) AS n, count(*) FILTER (window_title IS NULL AND browser_url IS NULL) AS n_empty, round(count(*) FILTER (window_title IS NULL AND browser_url IS NULL) / count(*), 9) AS share FROM canon GROUP BY 1")
def _(s, d):
    return qa.emptiness_by_type(base.canon(s, d), ["window_title", "browser_url"]).withColumn("share", F.round("share", 9))


@plan("q08_text_profile", "SELECT lang, count(*) AS n, count(*) FILTER (length(text) > 0) AS n_text, CAST(min(length(text)) FILTER (length(text) > 0) AS INTEGER) AS shortest, CAST(max(length(text)) FILTER (length(text) > 0) AS INTEGER) AS longest, round(avg(length(text)) FILTER (length(text) > 0), 6) AS mean_length FROM documents GROUP BY ROLLUP (lang)")
def _(s, d):
    return qa.text_profile(s.read.parquet(f"{d}/documents.parquet"), "text", "lang").withColumn("mean_length", F.round("mean_length", 6))


@plan("q10_identity", "SELECT session_id, count(DISTINCT application) AS machines, count(*) FILTER (idx % 11 = 5) AS other_session, count(*) FILTER (idx % 13 = 7) AS other_chunk FROM canon GROUP BY 1 HAVING count(DISTINCT application) > 1 OR count(*) FILTER (idx % 11 = 5) > 0 OR count(*) FILTER (idx % 13 = 7) > 0")
def _(s, d):
    """Records against the folders that they lie in; a few are laid into other folders on purpose."""
    placed = base.canon(s, d).withColumns({"session_dir": F.when(F.col("idx") % 11 == 5, "elsewhere").otherwise(F.col("session_id")), "chunk_dir": F.when(F.col("idx") % 13 == 7, "elsewhere").otherwise(F.col("chunk_id"))})
    return qa.identity_checks(placed.withColumnRenamed("application", "machine"))


@plan("q11_gt_coverage", "SELECT session_id, last_ms, gt_end_ms FROM (SELECT session_id, max(end_ms) AS gt_end_ms FROM gt GROUP BY 1) LEFT JOIN (SELECT session_id, max(timestamp_ms) AS last_ms FROM canon WHERE event_type = 'error' GROUP BY 1) USING (session_id) WHERE coalesce(last_ms, 0) < gt_end_ms - 86400000")
def _(s, d):
    return qa.gt_coverage(base.canon(s, d).where("event_type = 'error'"), fx.ground_truth(s, d), 24 * fx.HOUR)


@plan("q12_repeated_ids", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return qa.repeated_ids(s.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey")


@plan("q13_out_of_order", "SELECT session_id, count(*) FILTER (timestamp_ms < p) AS n_late FROM (SELECT session_id, timestamp_ms, lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY event_id) AS p FROM canon) GROUP BY 1")
def _(s, d):
    return qa.out_of_order(base.canon(s, d), ["event_id"])


CHUNKS = "SELECT session_id, chunk_id, lag(chunk_id) OVER w AS previous_id, CASE WHEN n % 7 = 0 THEN 'lost' ELSE lead(chunk_id) OVER w END AS next_id FROM (SELECT session_id, chunk_id, count(*) AS n FROM canon GROUP BY ALL) WINDOW w AS (PARTITION BY session_id ORDER BY chunk_id)"


@plan("q14_chunk_linkage", f"SELECT session_id, chunk_id, 'next' AS side, next_id AS target FROM ({CHUNKS}) WHERE next_id = 'lost'")
def _(s, d):
    w = sq.ordered("session_id", by="chunk_id")
    chunks = base.canon(s, d).groupBy("session_id", "chunk_id").agg(F.count("*").alias("n")).select("session_id", "chunk_id", F.lag("chunk_id").over(w).alias("previous_id"), F.when(F.col("n") % 7 == 0, "lost").otherwise(F.lead("chunk_id").over(w)).alias("next_id"))
    return qa.chunk_linkage(chunks)


@plan("q15_issue_summary", "SELECT session_id AS scope, count(*) FILTER (application IS NULL) AS no_app, count(*) FILTER (window_title IS NULL) AS no_title FROM canon WHERE application IS NULL OR window_title IS NULL GROUP BY 1")
def _(s, d):
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("application").isNull(), "no_app"), F.when(F.col("window_title").isNull(), "no_title")))).alias("kind")
    return qa.issue_summary(base.canon(s, d).select(F.col("session_id").alias("scope"), kinds), ["no_app", "no_title"])


@plan("q16_cleaning", "SELECT event_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_ms, event_id) AS position, row_number() OVER (PARTITION BY session_id ORDER BY event_id) <> row_number() OVER (PARTITION BY session_id ORDER BY timestamp_ms, event_id) AS moved FROM (SELECT * FROM canon QUALIFY row_number() OVER (PARTITION BY session_id, event_type, application, chunk_id ORDER BY event_id) = 1)")
def _(s, d):
    return qa.cleaned(base.canon(s, d), ["event_type", "application", "chunk_id"], ["event_id"]).select("event_id", F.col("position").cast("long"), "moved")


@plan("q17_profile", "SELECT session_id, event_type, CAST(grouping_id(session_id, event_type) AS BIGINT) AS level, count(*) AS n, max(timestamp_ms) - min(timestamp_ms) AS duration_ms, count(*) FILTER (has_extracted_text) AS n_text FROM canon GROUP BY GROUPING SETS ((session_id, event_type), (session_id), ())")
def _(s, d):
    return qa.profile(base.canon(s, d))


@plan("q_audit", "SELECT (SELECT count(*) FROM raw WHERE k = 13) AS malformed, (SELECT count(*) FROM raw WHERE k = 17) AS incomplete, count(*) AS n, count(*) FILTER (application IS NULL) AS no_app, count(DISTINCT session_id) AS sessions FROM canon")
def _(s, d):
    events = base.canon(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("application").isNull()).alias("no_app"), F.count_distinct("session_id").alias("sessions"))
    raw = qa.parsed(lines(s, d)).agg(F.count_if(F.col("v").isNull()).alias("malformed"), F.count_if(F.col("v").isNotNull() & F.try_variant_get("v", "$.event_type", "string").isNull()).alias("incomplete"))
    return raw.crossJoin(events)  # one row each


HEALTH = "SELECT session_id, n_events, coverage, n_domains, concat_ws(',', CASE WHEN coverage < 0.45 THEN 'low_domain_coverage' END, CASE WHEN n_domains < 3 THEN 'few_domains' END) AS warnings FROM (SELECT session_id, count(*) AS n_events, avg(CAST(browser_domain IS NOT NULL AS INTEGER)) AS coverage, count(DISTINCT browser_domain) AS n_domains FROM canon GROUP BY 1)"


def _health(s, d):
    events = base.canon(s, d)
    return qa.health(events, events.select("session_id").distinct(), 0.45, 3)


@plan("q20_health", f"SELECT session_id, n_events, round(coverage, 9) AS coverage, n_domains, warnings, warnings <> '' AS degraded FROM ({HEALTH})")
def _(s, d):
    return _health(s, d).withColumn("coverage", F.round("coverage", 9))


@plan("q21_health_agreement", f"SELECT tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 9) AS sensitivity, round(tn / nullif(tn + fp, 0), 9) AS specificity FROM (SELECT count(*) FILTER (x AND y) AS tp, count(*) FILTER (x AND NOT y) AS fp, count(*) FILTER (NOT x AND y) AS fn, count(*) FILTER (NOT x AND NOT y) AS tn FROM (SELECT warnings <> '' AS x, n_events < 60 AS y FROM ({HEALTH})))")
def _(s, d):
    out = qa.agreement(_health(s, d), F.col("degraded"), F.col("n_events") < 60)
    return out.withColumns({c: F.round(c, 9) for c in ("sensitivity", "specificity")})


@plan("q22_reference_gaps", "SELECT session_id, chunk_id, count(*) AS n_refs, count(*) FILTER (here) AS n_present, CASE WHEN bool_and(here) THEN 'complete' WHEN NOT bool_or(here) THEN 'all' WHEN min(timestamp_ms) FILTER (NOT here) < max(timestamp_ms) FILTER (here) THEN 'interleaved' ELSE 'tail' END AS gap_kind FROM (SELECT *, application IS NOT NULL AS here FROM canon) GROUP BY ALL")
def _(s, d):
    refs = base.canon(s, d).select("session_id", "chunk_id", F.col("event_id").alias("name"), F.col("timestamp_ms").alias("at_ms"))
    return qa.reference_gaps(refs, base.canon(s, d).where("application IS NOT NULL").select("session_id", "chunk_id", F.col("event_id").alias("name")))


# ground truth


def gt_log(s: SparkSession, d: str) -> DataFrame:
    """A ground-truth log: views start, signups suspend, clicks switch out, purchases resume a process; errors end a session."""
    names = {"view": "process_started", "signup": "process_suspended", "click": "process_switched_out", "purchase": "process_resumed", "error": "session_ended"}
    event = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("event_type")]
    return fx.canonical(s, d).select("session_id", F.col("idx").alias("rec_no"), F.col("timestamp_ms").alias("at_ms"), event.alias("event"), F.when(event != "session_ended", F.coalesce("application", F.lit("none"))).alias("process_code"), F.col("event_id").cast("string").alias("case_id"), F.coalesce("window_title", F.lit("x")).alias("split_id"))


LOG = "SELECT session_id, idx AS rec_no, timestamp_ms AS at_ms, CASE event_type WHEN 'view' THEN 'process_started' WHEN 'signup' THEN 'process_suspended' WHEN 'click' THEN 'process_switched_out' WHEN 'purchase' THEN 'process_resumed' ELSE 'session_ended' END AS event, CASE WHEN event_type <> 'error' THEN coalesce(application, 'none') END AS process_code, CAST(event_id AS VARCHAR) AS case_id, coalesce(window_title, 'x') AS split_id FROM canon"


@plan("g01_executions_from_log", f"""SELECT session_id, process_code, CAST(run AS BIGINT) AS run, case_id, start_ms, coalesce(sus, sw, CASE WHEN run = max(run) OVER (PARTITION BY session_id, process_code) THEN ended END) AS end_ms, sus IS NOT NULL AS suspended FROM (
  SELECT session_id, process_code, run, arg_min(case_id, rec_no) AS case_id, min(at_ms) AS start_ms, max(at_ms) FILTER (event = 'process_suspended') AS sus, min(at_ms) FILTER (event = 'process_switched_out') AS sw FROM (
    SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY session_id, process_code ORDER BY rec_no) AS run FROM (SELECT *, event = 'process_resumed' OR (event = 'process_started' AND lag(event) OVER (PARTITION BY session_id, process_code ORDER BY rec_no) IS DISTINCT FROM 'process_started') AS opens FROM ({LOG}) WHERE process_code IS NOT NULL)) WHERE run > 0 GROUP BY ALL)
  LEFT JOIN (SELECT session_id, max(at_ms) AS ended FROM ({LOG}) WHERE event = 'session_ended' GROUP BY 1) USING (session_id)""")
def _(s, d):
    return lb.executions_from_log(gt_log(s, d))


@plan("g01_unmatched_splits", f"SELECT session_id, split_id, 'suspend_without_resume' AS kind FROM ({LOG}) a WHERE event = 'process_suspended' AND NOT EXISTS (SELECT 1 FROM ({LOG}) b WHERE b.event = 'process_resumed' AND a.session_id = b.session_id AND a.split_id = b.split_id) UNION ALL SELECT session_id, split_id, 'resume_without_suspend' FROM ({LOG}) a WHERE event = 'process_resumed' AND NOT EXISTS (SELECT 1 FROM ({LOG}) b WHERE b.event = 'process_suspended' AND a.session_id = b.session_id AND a.split_id = b.split_id)")
def _(s, d):
    return lb.unmatched_splits(gt_log(s, d))


@plan("g02_overlapping", "SELECT count(*) AS n FROM (SELECT end_ms, lead(start_ms) OVER (PARTITION BY session_id ORDER BY start_ms, case_id) AS n FROM (SELECT session_id, case_id, start_ms, end_ms + 86400000 AS end_ms FROM gt)) WHERE n < end_ms")
def _(s, d):
    return lb.overlapping(fx.ground_truth(s, d).withColumn("end_ms", F.col("end_ms") + 24 * fx.HOUR)).agg(F.count("*").alias("n"))


@plan("g03_boundaries", "SELECT session_id, start_ms AS at_ms, prev = process_code AS is_resume, prev AS prev_code, process_code AS next_code FROM (SELECT *, lag(process_code) OVER (PARTITION BY session_id ORDER BY start_ms) AS prev FROM gt) WHERE prev IS NOT NULL")
def _(s, d):
    return lb.boundaries(fx.ground_truth(s, d))


CONT = """SELECT session_id, idx, category, CASE WHEN category IN ('boundary', 'resume_boundary') THEN 1 WHEN category = 'inside' THEN 0 END AS label FROM (
SELECT l.session_id, l.idx, CASE WHEN is_boundary AND is_resume THEN 'resume_boundary' WHEN is_boundary THEN 'boundary' WHEN a IS NULL AND b IS NULL THEN 'noise' WHEN a IS NULL OR b IS NULL THEN 'noise_edge' WHEN a = b THEN 'inside' ELSE 'between' END AS category
FROM labelled l JOIN (SELECT session_id, idx, case_id AS a, lead(case_id) OVER (PARTITION BY session_id ORDER BY idx) AS b FROM cased) USING (session_id, idx))"""


def _continuity(s, d):
    return lb.continuity(base.labelled(s, d), base.cased(s, d))


@plan("g04_continuity_labels", CONT)
def _(s, d):
    return _continuity(s, d)


@plan("g05_reconciliation", f"SELECT *, n_new = 0 OR n_same = 0 AS one_class FROM (SELECT session_id, count(*) FILTER (label = 1) AS n_new, count(*) FILTER (label = 0) AS n_same, count(*) FILTER (label IS NULL) AS n_excluded FROM ({CONT}) GROUP BY 1)")
def _(s, d):
    return lb.reconciliation(_continuity(s, d))


@plan("g06_noise_structure", f"SELECT category, count(*) AS n FROM ({CONT}) GROUP BY CUBE (category)")
def _(s, d):
    return _continuity(s, d).cube("category").agg(F.count("*").alias("n"))


@plan("g07_gap_regimes", f"SELECT category, count(*) AS n, median(delta_t_ms) AS median_ms, round(avg(delta_t_ms), 3) AS mean_ms FROM ({CONT}) JOIN trans USING (session_id, idx) GROUP BY 1")
def _(s, d):
    both = _continuity(s, d).join(base.trans(s, d).select("session_id", "idx", "delta_t_ms"), ["session_id", "idx"])
    return both.groupBy("category").agg(F.count("*").alias("n"), F.median("delta_t_ms").alias("median_ms"), F.round(F.avg("delta_t_ms"), 3).alias("mean_ms"))


@plan("g08_gap_at_boundary", "SELECT is_boundary, count(*) AS n, median(delta_t_ms) AS median_ms FROM labelled GROUP BY 1")
def _(s, d):
    return base.labelled(s, d).groupBy("is_boundary").agg(F.count("*").alias("n"), F.median("delta_t_ms").alias("median_ms"))


@plan("g09_concurrency", "SELECT session_id, CAST(max(alive) AS BIGINT) AS max_alive FROM (SELECT session_id, sum(d) OVER (PARTITION BY session_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS alive FROM (SELECT session_id, start_ms AS t, 1 AS d FROM gt UNION ALL SELECT session_id, end_ms + 172800000, -1 FROM gt)) GROUP BY 1")
def _(s, d):
    return lb.concurrency(fx.ground_truth(s, d).withColumn("end_ms", F.col("end_ms") + 48 * fx.HOUR))


@plan("g10_reappearing", "SELECT session_id, count(*) AS n_cases, count(*) FILTER (n > 1) AS n_returning FROM (SELECT session_id, value, count(*) AS n FROM fr GROUP BY ALL) GROUP BY 1")
def _(s, d):
    return lb.reappearing(sq.runs(sq.fill_forward(base.canon(s, d), "system", "filled"), "filled"))


# automation logs: an execution is a user, its states come from the event types


def status(s: SparkSession, d: str) -> DataFrame:
    return base.canon(s, d).select(F.col("session_id").alias("execution_id"), F.col("timestamp_ms").alias("at"), F.col("idx").alias("seq"), F.col("event_type").alias("state"))


@plan("l01_illegal_transitions", "SELECT x.execution_id, x.at, x.seq, x.before, x.state FROM (SELECT session_id AS execution_id, timestamp_ms AS at, idx AS seq, lag(event_type) OVER (PARTITION BY session_id ORDER BY idx) AS before, event_type AS state FROM canon) x WHERE before IS NOT NULL AND concat(before, '>', state) NOT IN ('signup>view', 'view>view', 'view>click', 'click>purchase', 'click>view', 'purchase>view')")
def _(s, d):
    allowed = s.createDataFrame([("signup", "view"), ("view", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view")], "before string, state string")
    return lg.illegal_transitions(status(s, d), allowed)


@plan("l01_final_states", "SELECT session_id AS execution_id, arg_max(event_type, idx) AS state FROM canon GROUP BY 1")
def _(s, d):
    return lg.final_states(status(s, d))


@plan("l02_replays", "SELECT session_id AS execution_id, timestamp_ms AS at, idx AS seq, event_type AS state FROM (SELECT *, max(CAST(event_type IN ('purchase', 'error') AS INTEGER)) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM canon) WHERE event_type = 'click' AND done = 1")
def _(s, d):
    return lg.replays(status(s, d), "click", ["purchase", "error"])


@plan("l02_latest", "SELECT session_id AS execution_id, timestamp_ms AS at, idx AS seq, event_type AS state FROM canon QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) = 1")
def _(s, d):
    return lg.latest(status(s, d), "execution_id")


@plan("l03_reconciled", "SELECT a.session_id AS execution_id, CASE WHEN ok IS NULL THEN 'still_unknown' WHEN ok THEN 'confirmed' ELSE 'failed' END AS resolution FROM (SELECT session_id, arg_max(event_type, idx) AS state FROM canon GROUP BY 1) a LEFT JOIN (SELECT session_id, bool_or(process_code = 'P1') AS ok FROM gt WHERE process_code IN ('P1', 'P2') GROUP BY 1) b USING (session_id) WHERE state <> 'purchase'")
def _(s, d):
    record = fx.ground_truth(s, d).where("process_code IN ('P1', 'P2')").groupBy(F.col("session_id").alias("execution_id")).agg(F.bool_or(F.col("process_code") == "P1").alias("ok"))
    return lg.reconciled(lg.final_states(status(s, d)).where("state <> 'purchase'"), record)


@plan("l04_lifecycle", "SELECT state, count(*) AS n, list_sort(list(ms))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS p50, max(ms) AS longest FROM (SELECT session_id, max(timestamp_ms) - min(timestamp_ms) AS ms, arg_max(event_type, idx) AS state FROM canon GROUP BY 1) GROUP BY 1")
def _(s, d):
    return lg.lifecycle(status(s, d))


@plan("l05_taxonomy", "SELECT CASE event_type WHEN 'error' THEN 'fault' WHEN 'signup' THEN 'user' ELSE 'other' END AS failure, count(*) AS n FROM canon GROUP BY 1")
def _(s, d):
    return lg.taxonomy(base.canon(s, d).select(F.col("event_type").alias("error")), {"error": "fault", "signup": "user"}, "other")


@plan("l06_evidence", "SELECT session_id AS execution_id, bool_and(event_type IN ('view', 'click', 'purchase', 'signup')) AS passed, bool_and(application IS NOT NULL OR event_type = 'error') AS conclusive, count(*) AS n_checks FROM canon GROUP BY 1")
def _(s, d):
    result = F.when(F.col("event_type") == "error", "FAIL").when(F.col("application").isNull(), "UNAVAILABLE").otherwise("PASS")
    checks = base.canon(s, d).select(F.col("session_id").alias("execution_id"), result.alias("result"))
    return lg.evidence(checks)


# kinds of relational work


@plan("k01_sorted", "SELECT session_id, seg_no, row_number() OVER (ORDER BY session_id, seg_no) AS place FROM exec WHERE event_count > 3")
def _(s, d):
    from worktrace.operators import executions as ex

    rows = ex.segment_spans(base.segmented(s, d)).where("event_count > 3")
    return sq.numbered(rows.select("session_id", "seg_no"), "session_id", ["seg_no"], "place")


@plan("k02_top_k", "SELECT operator, application, n FROM (SELECT operator, application, count(*) AS n FROM canon WHERE application IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY operator ORDER BY n DESC, application) <= 2")
def _(s, d):
    n = base.canon(s, d).where("application IS NOT NULL").groupBy("operator", "application").agg(F.count("*").alias("n"))
    rank = F.row_number().over(sq.Window.partitionBy("operator").orderBy(F.desc("n"), "application"))
    return n.withColumn("r", rank).where("r <= 2").drop("r")


@plan("k03_sets", "(SELECT session_id FROM canon WHERE event_type = 'purchase' INTERSECT SELECT session_id FROM canon WHERE event_type = 'signup') EXCEPT SELECT session_id FROM canon WHERE application = 'app3'")
def _(s, d):
    of = lambda c: base.canon(s, d).where(c).select("session_id").distinct()
    return of("event_type = 'purchase'").intersect(of("event_type = 'signup'")).subtract(of("application = 'app3'"))


@plan("k04_counts", "SELECT chunk_id, count(*) AS n, count(DISTINCT session_id) AS sessions, count(*) FILTER (event_type = 'error') AS errors FROM canon GROUP BY 1")
def _(s, d):
    return base.canon(s, d).groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("event_type") == "error").alias("errors"))


@plan("k06_pivot", "SELECT operator, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM canon GROUP BY 1")
def _(s, d):
    return base.canon(s, d).groupBy("operator").pivot("event_type", ["view", "click", "error"]).agg(F.count(F.lit(1))).na.fill(0)


@plan("k07_tagged_union", "SELECT tag, count(*) AS n FROM (SELECT 'a' AS tag, event_id FROM canon WHERE operator = 'op0' UNION ALL SELECT 'b', event_id FROM canon WHERE operator <> 'op0') GROUP BY 1")
def _(s, d):
    part = lambda c, t: base.canon(s, d).where(c).select(F.lit(t).alias("tag"), "event_id")
    return part("operator = 'op0'", "a").unionByName(part("operator <> 'op0'", "b")).groupBy("tag").agg(F.count("*").alias("n"))


@plan("q09_text_entry", "SELECT event_type, count(*) AS n, count(*) FILTER (window_title IS NOT NULL) AS with_text, count(*) FILTER (contains(window_title, 'Doc_3')) AS plaintext FROM canon WHERE interaction_category = 'input' GROUP BY 1")
def _(s, d):
    typed = base.canon(s, d).where("interaction_category = 'input'")
    return typed.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("window_title").isNotNull()).alias("with_text"), F.count_if(F.col("window_title").contains("Doc_3")).alias("plaintext"))


@plan("q18_dataset_profile", "SELECT count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, min(ms) AS shortest, max(ms) AS longest, round(avg(ms), 3) AS mean_ms FROM (SELECT session_id, count(*) AS n, max(timestamp_ms) - min(timestamp_ms) AS ms FROM canon GROUP BY 1)")
def _(s, d):
    per = base.canon(s, d).groupBy("session_id").agg(F.count("*").alias("n"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("ms"))
    return per.agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.min("ms").alias("shortest"), F.max("ms").alias("longest"), F.round(F.avg("ms"), 3).alias("mean_ms"))


@plan("q19_audit_rollup", "SELECT 'negative' AS name, CAST(count(*) FILTER (gap < 0) AS BIGINT) AS value FROM (SELECT timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY idx) AS gap FROM canon) UNION ALL SELECT 'long_gaps', count(*) FILTER (gap >= 86400000) FROM (SELECT timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY idx) AS gap FROM canon)")
def _(s, d):
    per = qa.timestamp_quality(base.canon(s, d), [fx.HOUR, 24 * fx.HOUR])
    one = per.agg(F.sum("negative").alias("negative"), F.sum("bucket_2").alias("long_gaps"))
    return one.unpivot([], ["negative", "long_gaps"], "name", "value")


@plan("a12_transition_sink", "SELECT session_id, count(*) AS n FROM trans GROUP BY 1")
def _(s, d):
    return base.trans(s, d).groupBy("session_id").agg(F.count("*").alias("n"))


@plan("a13_session_view", f"SELECT session_id, n_events, coalesce(n_exec, 0) AS n_executions, warnings FROM ({HEALTH}) LEFT JOIN (SELECT session_id, count(*) AS n_exec FROM exec GROUP BY 1) USING (session_id)")
def _(s, d):
    from worktrace.operators import executions as ex

    n = ex.segment_spans(base.segmented(s, d)).groupBy("session_id").agg(F.count("*").alias("n_executions"))
    return _health(s, d).join(n, "session_id", "left").select("session_id", "n_events", F.coalesce("n_executions", F.lit(0)).alias("n_executions"), "warnings")


def payloads(s: SparkSession, d: str) -> DataFrame:
    """Events with a nested payload as a variant: click targets and form fields."""
    title, app = F.col("window_title"), F.col("application")
    body = F.to_json(F.struct(F.struct(F.struct(app.alias("id"), F.col("browser_domain").alias("class")).alias("attributes")).alias("element"), F.struct(title.alias("label"), F.col("event_type").alias("input_type")).alias("field")))
    return base.canon(s, d).withColumn("v", F.try_parse_json(body))


@plan("f05_click_targets", "SELECT event_id, application AS id, browser_domain AS class FROM canon WHERE event_type = 'click' AND (application IS NOT NULL OR browser_domain IS NOT NULL)")
def _(s, d):
    at = lambda p: F.try_variant_get("v", p, "string")
    found = payloads(s, d).where("event_type = 'click'").select("event_id", at("$.element.attributes.id").alias("id"), at("$.element.attributes.class").alias("class"))
    return found.where("id IS NOT NULL OR class IS NOT NULL")


@plan("f07_form_fields", "SELECT event_id, window_title AS label, event_type AS input_type FROM canon WHERE interaction_category = 'input'")
def _(s, d):
    at = lambda p: F.try_variant_get("v", p, "string")
    return payloads(s, d).where("interaction_category = 'input'").select("event_id", at("$.field.label").alias("label"), at("$.field.input_type").alias("input_type"))


@plan("f13_event_text", "SELECT conv_id, turn, nullif(trim(text), '') AS text, nullif(trim(text), '') IS NOT NULL AS has_text FROM conversations")
def _(s, d):
    text = F.nullif(F.trim("text"), F.lit(""))
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.alias("text"), text.isNotNull().alias("has_text"))


@plan("f18_exclusion", "SELECT dominant_context AS process_id, starts_with(dominant_context, 'browser:') OR starts_with(dominant_context, 'unknown') AS excluded, count(*) AS n FROM exec GROUP BY ALL")
def _(s, d):
    from worktrace.functions import scalar
    from worktrace.plans import processes

    rows = processes.rows(s, d)
    return rows.groupBy("process_id", scalar.excluded(F.col("process_id"), ["browser:", "unknown"]).alias("excluded")).agg(F.count("*").alias("n"))


@plan("k05_rollup", "SELECT operator, session_id, count(*) AS n FROM canon GROUP BY ROLLUP (operator, session_id)")
def _(s, d):
    return base.canon(s, d).rollup("operator", "session_id").agg(F.count("*").alias("n"))


@plan("j14_lookup", "SELECT event_id, n_name FROM canon JOIN nation ON n_nationkey = idx % 25")
def _(s, d):
    nation = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long"), "n_name")  # 25 rows
    return base.canon(s, d).withColumn("n_nationkey", F.col("idx") % 25).join(F.broadcast(nation), "n_nationkey").select("event_id", "n_name")
