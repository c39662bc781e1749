"""Plans over sequences: functions, windows, joins, detectors and executions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktrace import fixtures as fx
from worktrace.functions import scalar
from worktrace.operators import boundary as b
from worktrace.operators import executions as ex
from worktrace.operators import joins as jn
from worktrace.operators import sequence as sq
from worktrace.plans.oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HALF_DAY = 12 * fx.HOUR


def plan(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle)
        return f

    return add


def canon(spark: SparkSession, d: str) -> DataFrame:
    return fx.canonical(spark, d)


def trans(spark: SparkSession, d: str) -> DataFrame:
    return sq.transitions(canon(spark, d), HALF_DAY)


def points(spark: SparkSession, d: str) -> DataFrame:
    """Boundary points: starts of the executions that have one before them in their session."""
    gt = fx.ground_truth(spark, d)
    later = F.lag("end_ms").over(Window.partitionBy("session_id").orderBy("start_ms")).isNotNull()
    return gt.withColumn("later", later).where("later").select("session_id", F.col("start_ms").alias("at_ms"), (F.substring("process_code", 2, 9).cast("int") % 3 == 0).alias("is_resume"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return jn.boundary_labels(trans(spark, d), points(spark, d))


def cuts(spark: SparkSession, d: str) -> DataFrame:
    events = canon(spark, d)
    return b.merge_leave_and_return(events, b.system_change(events), 2)


def segmented(spark: SparkSession, d: str) -> DataFrame:
    return sq.segments(canon(spark, d), cuts(spark, d))


def cased(spark: SparkSession, d: str) -> DataFrame:
    return jn.containing_case(canon(spark, d), fx.ground_truth(spark, d), "timestamp_ms")


@plan("f01_interaction_category", "SELECT event_type, interaction_category, count(*) AS n FROM canon GROUP BY ALL")
def _(s, d):
    return canon(s, d).groupBy("event_type", "interaction_category").agg(F.count("*").alias("n"))


@plan("f02_canonical_events", "SELECT session_id, event_id, idx, timestamp_ms, event_type, interaction_category, application, window_title, browser_domain, browser_url, has_extracted_text, chunk_id FROM canon")
def _(s, d):
    return canon(s, d).select("session_id", "event_id", "idx", "timestamp_ms", "event_type", "interaction_category", "application", "window_title", "browser_domain", "browser_url", "has_extracted_text", "chunk_id")


@plan("f03_hosts", """SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS netloc FROM pages WHERE url IS NOT NULL""")
def _(s, d):
    url = F.col("url")
    return s.read.parquet(f"{d}/pages.parquet").where("url IS NOT NULL").select("page_id", scalar.host(url).alias("host"), scalar.netloc(url).alias("netloc"))


@plan("f03_ports", "SELECT event_id, CAST(regexp_extract(browser_url, ':(\\d+)/', 1) AS INTEGER) AS port, '127.0.0.1' AS host FROM canon WHERE browser_url IS NOT NULL")
def _(s, d):
    url = F.col("browser_url")
    return canon(s, d).where("browser_url IS NOT NULL").select("event_id", scalar.port(url).alias("port"), scalar.host(url).alias("host"))


@plan("f04_url_routes", "SELECT page_id, CASE WHEN contains(url, '#') AND split_part(url, '#', 2) <> '' THEN concat('#', split_part(url, '#', 2)) END AS route FROM pages WHERE url IS NOT NULL")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").where("url IS NOT NULL").select("page_id", scalar.url_route(F.col("url")).alias("route"))


@plan("f06_click_routes", "SELECT event_id, concat('#', split_part(browser_url, '#', 2)) AS route FROM canon WHERE event_type = 'click' AND browser_url IS NOT NULL")
def _(s, d):
    return canon(s, d).where("event_type = 'click' AND browser_url IS NOT NULL").select("event_id", scalar.url_route(F.col("browser_url")).alias("route"))


@plan("f08_route_changes", """SELECT a, b, count(*) AS n FROM (SELECT split_part(browser_url, '#', 2) AS a, split_part(lead(browser_url) OVER (PARTITION BY session_id ORDER BY idx), '#', 2) AS b FROM canon) WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b""")
def _(s, d):
    route = scalar.url_route(F.col("browser_url"))
    both = canon(s, d).select(F.substring(route, 2, 99).alias("a"), F.substring(F.lead(route).over(sq.ordered()), 2, 99).alias("b"))
    return both.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


@plan("f09_system_identity", "SELECT event_id, system FROM canon")
def _(s, d):
    return canon(s, d).select("event_id", "system")


@plan("f10_document_keys", "SELECT event_id, CASE WHEN application IN ('app0', 'app1') THEN nullif(trim(ltrim(regexp_replace(window_title, '\\s*-\\s*Word$', ''), '*')), '') END AS document FROM canon")
def _(s, d):
    return canon(s, d).select("event_id", scalar.document_key(F.col("application"), F.col("window_title"), fx.SUFFIXES, ["Untitled"]).alias("document"))


@plan("f11_known_changes", "SELECT count(*) FILTER (system <> n) AS known_changes, count(*) FILTER (system IS DISTINCT FROM n) AS all_changes FROM (SELECT system, lead(system) OVER w AS n, lead(idx) OVER w AS ni FROM canon WINDOW w AS (PARTITION BY session_id ORDER BY idx)) WHERE ni IS NOT NULL")
def _(s, d):
    w = sq.ordered()
    both = canon(s, d).select("system", F.lead("system").over(w).alias("n"), F.lead("idx").over(w).alias("ni")).where("ni IS NOT NULL")
    return both.agg(F.count_if(scalar.system_changed(F.col("system"), F.col("n"))).alias("known_changes"), F.count_if(~F.col("system").eqNullSafe(F.col("n"))).alias("all_changes"))


@plan("f12_operators", "SELECT operator, count(DISTINCT session_id) AS sessions, count(*) AS events FROM canon GROUP BY operator")
def _(s, d):
    return canon(s, d).groupBy("operator").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events"))


@plan("f14_token_sets", r"""SELECT conv_id, turn, len(list_distinct(list_transform(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'), lambda x: lower(x)))) AS n_tokens FROM conversations WHERE text IS NOT NULL""")
def _(s, d):
    return s.read.parquet(f"{d}/conversations.parquet").where("text IS NOT NULL").select("conv_id", "turn", F.size(scalar.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@plan("f15_signal_predicates", "SELECT event_type = 'view' AS is_navigation, event_type = 'purchase' AS is_clipboard, window_title IS NOT NULL AS has_title, count(*) AS n FROM canon GROUP BY ALL")
def _(s, d):
    return canon(s, d).groupBy((F.col("event_type") == "view").alias("is_navigation"), (F.col("event_type") == "purchase").alias("is_clipboard"), F.col("window_title").isNotNull().alias("has_title")).agg(F.count("*").alias("n"))


@plan("f16_scalars", "SELECT event_id, round(ln(1 + greatest(timestamp_ms % 100000, 0)), 9) AS log_gap, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM canon")
def _(s, d):
    return canon(s, d).select("event_id", F.round(scalar.log1p_gap(F.col("timestamp_ms") % 100000), 9).alias("log_gap"), scalar.iso_utc(F.col("timestamp_ms")).alias("iso"))


@plan("f17_candidate_sources", "SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'v1_only' WHEN b THEN 'v2_only' ELSE 'neither' END AS source, count(*) AS n FROM (SELECT delta_t_ms > 86400000 AS a, application_changed OR browser_domain_changed AS b FROM trans) GROUP BY 1")
def _(s, d):
    return trans(s, d).groupBy(scalar.candidate_source(b.pause(24 * fx.HOUR), b.context()).alias("source")).agg(F.count("*").alias("n"))


@plan("f19_redaction", "SELECT event_id, CAST(2 AS INTEGER) AS n_fields, CAST(length(window_title) AS VARCHAR) AS title_length FROM canon WHERE window_title IS NOT NULL")
def _(s, d):
    fields = F.create_map(F.lit("app"), F.col("application"), F.lit("title"), F.col("window_title"), F.lit("password"), F.col("event_type"))
    out = scalar.redacted(fields, "(?i)password|secret|token", "(?i)title|text")
    return canon(s, d).where("window_title IS NOT NULL").select("event_id", F.size(out).alias("n_fields"), out["title_length"].alias("title_length"))


@plan("f20_blind_leaks", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS leaks FROM canon")
def _(s, d):
    blind = canon(s, d).select("event_id", "timestamp_ms", "application")
    return blind.agg(F.count("*").alias("n_rows"), F.count_if(F.to_json(F.struct("*")).rlike("purchase|case_id|process_code")).alias("leaks"))


@plan("w01_transition_features", "SELECT * REPLACE (round(log1p_delta_t_ms, 9) AS log1p_delta_t_ms) FROM trans")
def _(s, d):
    return trans(s, d).withColumn("log1p_delta_t_ms", F.round("log1p_delta_t_ms", 9))


@plan("w02_fill_forward", "SELECT session_id, idx, f AS filled FROM filled")
def _(s, d):
    return sq.fill_forward(canon(s, d), "system", "filled").select("session_id", "idx", "filled")


@plan("w03_runs", "SELECT session_id, run_no, min(f) AS value, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS length FROM fruns GROUP BY session_id, run_no")
def _(s, d):
    return sq.runs(sq.fill_forward(canon(s, d), "system", "filled"), "filled")


@plan("w04_return_patterns", """SELECT session_id, value, left_run, run_no AS returned_run, left_end AS left_end_idx, start_idx AS return_start_idx, run_no - left_run = 2 AS is_immediate, start_idx - left_end - 1 AS away_events
FROM (SELECT *, lag(run_no) OVER w AS left_run, lag(end_idx) OVER w AS left_end FROM fr WINDOW w AS (PARTITION BY session_id, value ORDER BY run_no)) WHERE left_run IS NOT NULL""")
def _(s, d):
    return sq.return_patterns(sq.runs(sq.fill_forward(canon(s, d), "system", "filled"), "filled"))


DUP = "SELECT *, coalesce(event_type = 'view' AND lag(event_type) OVER w = 'view' AND lag(application) OVER w IS NOT DISTINCT FROM application, false) AS dup FROM canon WINDOW w AS (PARTITION BY session_id ORDER BY idx)"


@plan("w05_drop_consecutive", f"SELECT session_id, idx, event_id FROM ({DUP}) WHERE NOT dup")
def _(s, d):
    return sq.drop_consecutive(canon(s, d), "view", F.col("application")).select("session_id", "idx", "event_id")


@plan("w06_duplicate_noise", f"SELECT session_id, idx, dup OR n AS duplicate_noise FROM (SELECT *, lead(dup) OVER (PARTITION BY session_id ORDER BY idx) AS n FROM ({DUP})) WHERE n IS NOT NULL")
def _(s, d):
    return sq.duplicate_noise(canon(s, d), "view", F.col("application"))


@plan("w07_window_summaries", "SELECT session_id, idx, array_to_string(list_sort(tb), ',') AS types_before, array_to_string(list_sort(ta), ',') AS types_after, duration_before, duration_after, text_before, text_after FROM win")
def _(s, d):
    out = sq.windows(canon(s, d), 5)
    return out.select("session_id", "idx", F.concat_ws(",", "types_before").alias("types_before"), F.concat_ws(",", "types_after").alias("types_after"), "duration_before", "duration_after", "text_before", "text_after")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@plan("w08_trajectories", "SELECT session_id, idx, round(types_jaccard, 9) AS types_jaccard, round(apps_jaccard, 9) AS apps_jaccard, round(domains_jaccard, 9) AS domains_jaccard, duration_before, duration_after, text_before, text_after FROM traj")
def _(s, d):
    out = sq.trajectories(sq.windows(canon(s, d), 5)).drop("categories_jaccard", "titles_jaccard")
    return _rounded(out, "types_jaccard", "apps_jaccard", "domains_jaccard")


@plan("w09_content_drift", r"""SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS drift, len(a) > 0 AND len(b) > 0 AS available
FROM (SELECT conv_id, turn, list_distinct(flatten(list(t) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))) AS a, list_distinct(flatten(list(t) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))) AS b, lead(turn) OVER w AS n
      FROM (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+'), lambda x: lower(x))) AS t FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n IS NOT NULL""")
def _(s, d):
    return _rounded(sq.drift(s.read.parquet(f"{d}/conversations.parquet"), 2, ("conv_id",), "turn", "text"), "drift")


RUNLEN = "SELECT session_id, idx, flag, CASE WHEN flag THEN count(*) OVER (PARTITION BY session_id, g) ELSE 0 END AS cluster_size FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY session_id ORDER BY idx) AS g FROM (SELECT session_id, idx, delta_t_ms > 21600000 AS flag, (delta_t_ms > 21600000) IS DISTINCT FROM lag(delta_t_ms > 21600000) OVER (PARTITION BY session_id ORDER BY idx) AS new FROM trans))"


@plan("w10_cluster_sizes", RUNLEN)
def _(s, d):
    return sq.cluster_sizes(trans(s, d).select("session_id", "idx", b.pause(6 * fx.HOUR).alias("flag")), "flag").select("session_id", "idx", "flag", "cluster_size")


EDGES = """SELECT session_id, idx, max(l) AS leave_pair, max(r) AS return_pair FROM (
  SELECT session_id, idx, ns - 1 AS l, NULL AS r FROM k WHERE nv <> application AND ns <= idx + 10
  UNION ALL SELECT session_id, idx - 1, NULL, ps FROM k WHERE pv <> application AND ps >= idx - 10) GROUP BY session_id, idx"""
KNOWN = "SELECT session_id, idx, application, lead(idx) OVER v AS ns, lag(idx) OVER v AS ps, lead(application) OVER w AS nv, lag(application) OVER w AS pv FROM canon WHERE application IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY idx), v AS (PARTITION BY session_id, application ORDER BY idx)"


@plan("w11_return_edges", f"SELECT session_id, idx, leave_pair IS NOT NULL AS is_leave, return_pair IS NOT NULL AS is_return, coalesce(return_pair, leave_pair) AS pair FROM ({EDGES.replace('FROM k', f'FROM ({KNOWN})')})")
def _(s, d):
    return sq.return_edges(canon(s, d), "application", 10)


@plan("w12_demoted_edges", f"SELECT DISTINCT session_id, unnest([idx, pair]) AS idx FROM (SELECT e.session_id, e.idx, coalesce(return_pair, leave_pair) AS pair FROM ({EDGES.replace('FROM k', f'FROM ({KNOWN})')}) e JOIN trans t ON t.session_id = e.session_id AND t.idx = e.idx AND t.delta_t_ms > 86400000)")
def _(s, d):
    return sq.demoted_edges(sq.return_edges(canon(s, d), "application", 10), trans(s, d).where(b.pause(24 * fx.HOUR)))


DEB = "SELECT session_id, idx, coalesce(f <> nf, false) AND nl >= {k} AS boundary FROM (SELECT session_id, idx, f, lead(f) OVER w AS nf, lead(l) OVER w AS nl FROM (SELECT *, count(*) OVER (PARTITION BY session_id, run_no) AS l FROM fruns) WINDOW w AS (PARTITION BY session_id ORDER BY idx)) WHERE nl IS NOT NULL"


@plan("w13_debounced_change", DEB.format(k=3))
def _(s, d):
    return b.debounced_change(canon(s, d), 3)


@plan("w14_segment_ids", "SELECT session_id, seg_no, min(idx) AS first_idx, max(idx) AS last_idx FROM seg GROUP BY ALL")
def _(s, d):
    return segmented(s, d).groupBy("session_id", "seg_no").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@plan("w15_surrounding_events", "SELECT g.session_id, case_id AS span_id, max(c.timestamp_ms) FILTER (c.timestamp_ms < start_ms) AS before_ms, min(c.timestamp_ms) FILTER (c.timestamp_ms > end_ms) AS after_ms FROM gt g JOIN canon c USING (session_id) GROUP BY ALL")
def _(s, d):
    return sq.surrounding(canon(s, d), fx.ground_truth(s, d).withColumnRenamed("case_id", "span_id"))


PAIRS = "SELECT a.session_id, a.idx AS i, b.idx AS j, a.case_id AS ca, b.case_id AS cb, b.idx - a.idx AS gap FROM cased a JOIN cased b ON a.session_id = b.session_id AND b.idx - a.idx IN (1, 2, 5, 10, 25) WHERE a.case_id IS NOT NULL AND b.case_id IS NOT NULL"
CAPPED = f"SELECT session_id, i, j, gap, ca = cb AS same FROM ({PAIRS}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY md5(concat_ws('|', session_id, CAST(i AS VARCHAR), CAST(j AS VARCHAR)))) <= 200"


#: The reference's grid: 24 log-spaced gaps up to 600, of which 22 differ as whole numbers.
GAPS = sorted({round(600 ** (k / 23)) for k in range(24)})
#: That grid and the gaps of the capped queries.
LINKED = sorted({*GAPS, 1, 2, 5, 10, 25})
EVERY = f"SELECT a.session_id, a.idx AS i, b.idx AS j, b.idx - a.idx AS gap, a.case_id = b.case_id AS same FROM cased a JOIN cased b ON a.session_id = b.session_id AND b.idx - a.idx IN ({', '.join(map(str, GAPS))}) WHERE a.case_id IS NOT NULL AND b.case_id IS NOT NULL"


@plan("j10_offset_pairs", CAPPED)
def _(s, d):
    return jn.offset_pairs(cased(s, d), "case_id", [1, 2, 5, 10, 25], 200)


@plan("w16_between_counts", f"SELECT p.session_id, i, j, gap, same, count(c.idx) AS between FROM ({CAPPED}) p LEFT JOIN canon c ON c.session_id = p.session_id AND c.idx > i AND c.idx < j AND c.event_type = 'purchase' GROUP BY ALL")
def _(s, d):
    pairs = jn.offset_pairs(cased(s, d), "case_id", [1, 2, 5, 10, 25], 200)
    return jn.prefix_lookup(canon(s, d).withColumn("bought", F.col("event_type") == "purchase"), pairs, "bought")


@plan("j10_offset_pairs_all", EVERY)
def _(s, d):
    return jn.offset_pairs(cased(s, d), "case_id", GAPS)


@plan("w16_between_counts_all", f"SELECT p.session_id, i, j, gap, same, count(c.idx) AS between FROM ({EVERY}) p LEFT JOIN canon c ON c.session_id = p.session_id AND c.idx > i AND c.idx < j AND c.event_type = 'purchase' GROUP BY ALL")
def _(s, d):
    pairs = jn.offset_pairs(cased(s, d), "case_id", GAPS)
    return jn.prefix_lookup(canon(s, d).withColumn("bought", F.col("event_type") == "purchase"), pairs, "bought")


@plan("j01_boundary_labels", "SELECT session_id, idx, is_boundary, is_resume FROM labelled")
def _(s, d):
    return labelled(s, d).select("session_id", "idx", "is_boundary", "is_resume")


@plan("j02_containing_execution", "SELECT event_id, case_id FROM cased")
def _(s, d):
    return cased(s, d).select("event_id", "case_id")


@plan("j03_asof_case", "SELECT event_id, CASE WHEN timestamp_ms <= end_ms THEN g.case_id END AS case_id FROM canon c ASOF LEFT JOIN gt g ON g.session_id = c.session_id AND g.start_ms <= c.timestamp_ms")
def _(s, d):
    return cased(s, d).select("event_id", "case_id")


@plan("j04_overlaps", "SELECT * FROM over")
def _(s, d):
    return jn.overlaps(ex.segment_spans(segmented(s, d)), fx.ground_truth(s, d), 30 * 24 * fx.HOUR)


NEAR = "SELECT g.session_id, g.case_id, g.start_ms, min(abs(c.timestamp_ms - g.start_ms)) AS distance_ms, arg_min(c.timestamp_ms, (abs(c.timestamp_ms - g.start_ms), c.timestamp_ms)) AS nearest_ms FROM gt g JOIN canon c ON c.session_id = g.session_id AND c.event_type = 'error' GROUP BY ALL"


@plan("j05_nearest_signal", NEAR)
def _(s, d):
    spans = fx.ground_truth(s, d).select("session_id", "case_id", "start_ms")
    return jn.nearest(spans, canon(s, d).where("event_type = 'error'"), "start_ms", "timestamp_ms").where("distance_ms IS NOT NULL")


@plan("j06_nearest_frame", NEAR.replace("GROUP BY ALL", "GROUP BY ALL").replace("min(abs(c.timestamp_ms - g.start_ms)) AS distance_ms, ", "").replace("AS nearest_ms", "AS nearest_ms, arg_min(c.event_id, (abs(c.timestamp_ms - g.start_ms), c.timestamp_ms)) AS event_id"))
def _(s, d):
    spans = fx.ground_truth(s, d).select("session_id", "case_id", "start_ms")
    return jn.nearest(spans, canon(s, d).where("event_type = 'error'"), "start_ms", "timestamp_ms", "event_id").where("distance_ms IS NOT NULL").drop("distance_ms")


@plan("j07_bracketing_frame", "SELECT session_id, case_id, start_ms, CASE WHEN start_ms - m <= 604800000 THEN m END AS frame_ms FROM (SELECT g.session_id, g.case_id, g.start_ms, max(c.timestamp_ms) AS m FROM gt g LEFT JOIN canon c ON c.session_id = g.session_id AND c.timestamp_ms < g.start_ms AND c.event_type = 'error' GROUP BY g.session_id, g.case_id, g.start_ms)")
def _(s, d):
    spans = fx.ground_truth(s, d).select("session_id", "case_id", "start_ms")
    return jn.one_sided(spans, canon(s, d).where("event_type = 'error'"), "start_ms", "timestamp_ms", 7 * 24 * fx.HOUR, after=False)


@plan("j08_inner_transitions", "SELECT t.session_id, t.idx, g.case_id FROM trans t JOIN gt g ON g.session_id = t.session_id AND g.start_ms <= t.timestamp_ms AND t.next_timestamp_ms <= g.end_ms")
def _(s, d):
    return jn.inside(trans(s, d), fx.ground_truth(s, d)).select("session_id", "idx", "case_id")


@plan("j09_execution_events", "SELECT session_id, case_id, n, first_type FROM (SELECT session_id, case_id, count(*) AS n, arg_min(event_type, idx) AS first_type FROM cased WHERE case_id IS NOT NULL GROUP BY ALL) WHERE n >= 2")
def _(s, d):
    return cased(s, d).where("case_id IS NOT NULL").groupBy("session_id", "case_id").agg(F.count("*").alias("n"), F.min_by("event_type", "idx").alias("first_type")).where("n >= 2")


@plan("j11_known_sessions", "SELECT session_id, count(*) AS n FROM canon WHERE session_id NOT IN (SELECT session_id FROM canon WHERE application IS NULL GROUP BY 1 HAVING count(*) > 8) GROUP BY 1")
def _(s, d):
    bad = canon(s, d).where("application IS NULL").groupBy("session_id").agg(F.count("*").alias("x")).where("x > 8")
    return canon(s, d).join(bad, "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("n"))


@plan("j12_count_mismatches", "SELECT coalesce(a.process_code, b.process_code) AS process_code, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM (SELECT process_code, count(*) AS n_a FROM gt GROUP BY 1) a FULL JOIN (SELECT process_code, count(*) AS n_b FROM gt WHERE n_events > 1 GROUP BY 1) b USING (process_code) WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)")
def _(s, d):
    gt = fx.ground_truth(s, d)
    long = cased(s, d).where("case_id IS NOT NULL").groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")
    return jn.count_mismatches(gt, gt.join(long, "case_id", "left_semi"), "process_code")


DETECTORS = {
    "b01_pause": ("delta_t_ms > 43200000", lambda: b.pause(HALF_DAY)),
    "b02_pause_and_change": ("delta_t_ms > 43200000 AND (application_changed OR window_title_changed OR browser_domain_changed OR interaction_category_changed)", lambda: b.pause_and_change(HALF_DAY)),
    "b03_pause_or_change": ("delta_t_ms > 43200000 OR application_changed OR window_title_changed OR browser_domain_changed OR interaction_category_changed", lambda: b.pause_or_change(HALF_DAY)),
    "b04_gap_at_least": ("delta_t_ms >= 43200000", lambda: b.gap_at_least(HALF_DAY)),
    "b05_application_change": ("application_changed", lambda: F.col("application_changed")),
    "b08_two_thresholds": ("((application_changed OR browser_domain_changed) AND delta_t_ms > 21600000) OR delta_t_ms > 86400000", lambda: b.two_thresholds(6 * fx.HOUR, 24 * fx.HOUR)),
    "b12_union": ("delta_t_ms > 86400000 OR (application_changed AND delta_t_ms > 21600000)", lambda: b.pause(24 * fx.HOUR) | (F.col("application_changed") & b.pause(6 * fx.HOUR))),
}
for _name, (_sql, _column) in DETECTORS.items():
    plan(_name, f"SELECT session_id, idx, {_sql} AS boundary FROM trans")(lambda s, d, c=_column: trans(s, d).select("session_id", "idx", c().alias("boundary")))


@plan("b06_system_change", "SELECT * FROM cut0")
def _(s, d):
    return b.system_change(canon(s, d))


LASTING = (2, 3, 5, 8, 12)


@plan("b07_debounced_sweep", " UNION ALL ".join(f"SELECT {k} AS k, count(*) FILTER (boundary) AS n_cuts FROM ({DEB.format(k=k)})" for k in LASTING))
def _(s, d):
    return b.debounced_counts(canon(s, d), LASTING)


RULE = "((application_changed OR browser_domain_changed) AND delta_t_ms > 21600000 OR delta_t_ms > 86400000)"


@plan("b09_rule_with_veto", f"SELECT session_id, idx, {RULE} AND NOT coalesce(types_jaccard >= 0.6, false) AS boundary FROM trans JOIN traj USING (session_id, idx)")
def _(s, d):
    both = trans(s, d).join(sq.trajectories(sq.windows(canon(s, d), 5)).select("session_id", "idx", "types_jaccard"), ["session_id", "idx"])
    return both.select("session_id", "idx", b.with_veto(b.two_thresholds(6 * fx.HOUR, 24 * fx.HOUR), F.col("types_jaccard"), 0.6).alias("boundary"))


HOPS = "SELECT session_id, idx, application AS a, lead(application) OVER (PARTITION BY session_id ORDER BY idx) AS b FROM canon"


@plan("b10_rule_with_motif", f"""SELECT t.session_id, t.idx, (((application_changed AND NOT coalesce(usual, false)) OR browser_domain_changed) AND delta_t_ms > 21600000) OR delta_t_ms > 86400000 AS boundary
FROM trans t JOIN ({HOPS}) h USING (session_id, idx) LEFT JOIN (
  SELECT o.session_id, o.a, o.b, total - own >= 600 AS usual FROM (SELECT session_id, a, b, count(*) AS own FROM ({HOPS}) WHERE a <> b GROUP BY ALL) o JOIN (SELECT a, b, count(*) AS total FROM ({HOPS}) WHERE a <> b GROUP BY ALL) USING (a, b)) u
  ON u.session_id = t.session_id AND u.a = h.a AND u.b = h.b""")
def _(s, d):
    return b.with_motif(trans(s, d), canon(s, d), 6 * fx.HOUR, 24 * fx.HOUR, 600)


@plan("b11_coverage_aware", "SELECT session_id, idx, ((application_changed OR browser_domain_changed) AND delta_t_ms > CASE WHEN coverage < 0.5 THEN 43200000 ELSE 21600000 END) OR delta_t_ms > 86400000 AS boundary FROM trans JOIN (SELECT session_id, count(browser_domain) / count(*) AS coverage FROM canon GROUP BY 1) USING (session_id)")
def _(s, d):
    coverage = canon(s, d).groupBy("session_id").agg((F.count("browser_domain") / F.count("*")).alias("coverage"))
    return trans(s, d).join(coverage, "session_id").select("session_id", "idx", b.coverage_aware(6 * fx.HOUR, HALF_DAY, 24 * fx.HOUR, F.col("coverage"), 0.5).alias("boundary"))


DEMOTED = "SELECT DISTINCT session_id, unnest([idx, pair]) AS idx, true AS return_demoted FROM (SELECT e.session_id, e.idx, coalesce(return_pair, leave_pair) AS pair FROM (" + EDGES.replace("FROM k", f"FROM ({KNOWN})") + ") e JOIN trans t ON t.session_id = e.session_id AND t.idx = e.idx AND t.delta_t_ms > 86400000)"
EVIDENCE = f"""SELECT t.session_id, t.idx, t.delta_t_ms > 86400000 AS candidate, t.delta_t_ms, t.application_changed, density_before,
  delta_t_ms > 432000000 AS chunk_boundary, coalesce(x.dup OR x.n, false) AS duplicate_noise, coalesce(return_demoted, false) AS return_demoted, cluster_size, types_jaccard AS jaccard
FROM trans t JOIN traj j USING (session_id, idx) LEFT JOIN ({DEMOTED}) r USING (session_id, idx)
JOIN (SELECT session_id, idx, dup, lead(dup) OVER (PARTITION BY session_id ORDER BY idx) AS n FROM ({DUP})) x USING (session_id, idx)
JOIN ({RUNLEN.replace('21600000', '86400000')}) c USING (session_id, idx)"""
RULES = f"""SELECT *, CASE WHEN NOT candidate THEN 'none' WHEN chunk_boundary OR duplicate_noise THEN 'rule_1_chunk_noise' WHEN return_demoted THEN 'rule_2_return_pattern' WHEN cluster_size >= 2 THEN 'rule_3_cluster' ELSE 'rule_4_continuity' END AS rule FROM ({EVIDENCE})"""
FINAL = f"SELECT *, CASE WHEN rule = 'rule_3_cluster' THEN true WHEN rule = 'rule_4_continuity' THEN coalesce(jaccard < 0.6, true) ELSE false END AS final FROM ({RULES})"


def evidence(s: SparkSession, d: str) -> DataFrame:
    events, t = canon(s, d), trans(s, d)
    long = t.select("session_id", "idx", "delta_t_ms", "application_changed", "density_before", b.pause(24 * fx.HOUR).alias("candidate"), b.pause(120 * fx.HOUR).alias("chunk_boundary"))
    demoted = sq.demoted_edges(sq.return_edges(events, "application", 10), t.where(b.pause(24 * fx.HOUR))).withColumn("return_demoted", F.lit(True))
    both = sq.cluster_sizes(long, "candidate").join(sq.duplicate_noise(events, "view", F.col("application")), ["session_id", "idx"])
    both = both.join(sq.trajectories(sq.windows(events, 5)).select("session_id", "idx", F.col("types_jaccard").alias("jaccard")), ["session_id", "idx"])
    return both.join(demoted, ["session_id", "idx"], "left").withColumn("return_demoted", F.coalesce("return_demoted", F.lit(False)))


@plan("b13_ordered_rules", f"SELECT session_id, idx, rule, final FROM ({FINAL})")
def _(s, d):
    return b.reconstruct(evidence(s, d), 0.6).select("session_id", "idx", "rule", "final")


@plan("b14_ablation", f"SELECT session_id, idx, CASE WHEN NOT candidate THEN 'none' WHEN chunk_boundary OR duplicate_noise THEN 'rule_1_chunk_noise' ELSE 'rule_4_continuity' END AS rule, candidate AND NOT (chunk_boundary OR duplicate_noise) AND coalesce(jaccard < 0.6, true) AS final FROM ({EVIDENCE})")
def _(s, d):
    return b.reconstruct_simple(evidence(s, d), 0.6).select("session_id", "idx", "rule", "final")


@plan("b15_protection", f"SELECT session_id, idx, CASE WHEN p THEN 'rule_4_protected' ELSE rule END AS rule, final OR p AS final FROM (SELECT *, rule = 'rule_4_continuity' AND NOT final AND application_changed AND density_before >= 2 AS p FROM ({FINAL}))")
def _(s, d):
    return b.protect(b.reconstruct(evidence(s, d), 0.6), "combined", F.col("density_before"), 2, F.col("application_changed")).select("session_id", "idx", "rule", "final")


@plan("b16_merged_returns", "SELECT * FROM cut")
def _(s, d):
    return cuts(s, d)


@plan("b19_coherence_demotion", f"SELECT session_id, idx, final AND NOT coalesce(jaccard >= 0.4, false) AS final FROM ({FINAL})")
def _(s, d):
    return b.demote_coherent(b.reconstruct(evidence(s, d), 0.6), F.col("jaccard"), 0.4).select("session_id", "idx", "final")


SAMPLED = """SELECT point_id, kind, session_id, at_ms FROM (
  SELECT concat_ws('|', 'boundary', session_id, case_id) AS point_id, 'boundary' AS kind, session_id, CAST(floor((end_ms + n) / 2) AS BIGINT) AS at_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY session_id ORDER BY start_ms) AS n FROM gt) WHERE n IS NOT NULL
  UNION ALL SELECT concat_ws('|', 'control', session_id, case_id), 'control', session_id, CAST(floor((start_ms + end_ms) / 2) AS BIGINT) FROM gt WHERE n_events >= 4) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY md5(concat(point_id, 'seed'))) <= 50"""


def sampled(s: SparkSession, d: str) -> DataFrame:
    n = cased(s, d).where("case_id IS NOT NULL").groupBy("case_id").agg(F.count("*").alias("n_events"))
    return b.sampling_points(fx.ground_truth(s, d).join(n, "case_id"), 4, 50, "seed")


@plan("b20_sampling_points", SAMPLED)
def _(s, d):
    return sampled(s, d)


@plan("e01_segments", "SELECT session_id, seg_no, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS event_count FROM seg GROUP BY ALL")
def _(s, d):
    return ex.segment_spans(segmented(s, d))


@plan("e02_executions", "SELECT execution_id, session_id, e.seg_no, operator, start_ms, end_ms, duration_ms, event_count, apps AS applications FROM exec e JOIN (SELECT session_id, seg_no, coalesce(string_agg(DISTINCT application, ',' ORDER BY application) FILTER (application <> 'app3'), '') AS apps FROM seg GROUP BY ALL) USING (session_id, seg_no)")
def _(s, d):
    return ex.executions(segmented(s, d), fx.NOISE_APPS).withColumn("applications", F.concat_ws(",", "applications"))


@plan("e03_dominant_context", "SELECT * FROM ctx")
def _(s, d):
    return ex.dominant_context(segmented(s, d), fx.SUFFIXES)


@plan("e04_steps", "SELECT * FROM step")
def _(s, d):
    return ex.steps(segmented(s, d))


@plan("e04_step_types", "SELECT session_id, seg_no, step_no, rank, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seg_no, step_no ORDER BY n DESC, first) AS rank FROM (SELECT session_id, seg_no, step_no, event_type, count(*) AS n, min(idx) AS first FROM stepev GROUP BY ALL)) WHERE rank <= 3")
def _(s, d):
    return ex.step_types(segmented(s, d), 3)


@plan("e05_pipeline_counts", "SELECT c0.session_id, raw_cuts, merged_cuts FROM (SELECT session_id, count(*) FILTER (boundary) AS raw_cuts FROM cut0 GROUP BY 1) c0 JOIN (SELECT session_id, count(*) FILTER (boundary) AS merged_cuts FROM cut GROUP BY 1) USING (session_id)")
def _(s, d):
    events = canon(s, d)
    raw = b.system_change(events)
    count = lambda df, name: df.groupBy("session_id").agg(F.count_if("boundary").alias(name))
    return count(raw, "raw_cuts").join(count(b.merge_leave_and_return(events, raw, 2), "merged_cuts"), "session_id")


E06_ROWS = "SELECT c.session_id, c.idx, c.timestamp_ms, t.* EXCLUDE (session_id, idx, timestamp_ms), k.boundary AS system_cut, p90, p95, p99 FROM canon c LEFT JOIN trans t USING (session_id, idx) LEFT JOIN cut0 k USING (session_id, idx), (SELECT quantile_cont(delta_t_ms, 0.9) AS p90, quantile_cont(delta_t_ms, 0.95) AS p95, quantile_cont(delta_t_ms, 0.99) AS p99 FROM trans)"
#: Ten methods: fixed gaps, percentiles of the gaps, changes and rules.
E06 = ("gap6", "gap12", "gap24", "p90", "p95", "p99", "app", "system", "pause_and_change", "two_thresholds")
E06_SQL = {"gap6": "delta_t_ms >= 21600000", "gap12": "delta_t_ms >= 43200000", "gap24": "delta_t_ms >= 86400000", "p90": "delta_t_ms >= p90", "p95": "delta_t_ms >= p95", "p99": "delta_t_ms >= p99", "app": "application_changed", "system": "system_cut", "pause_and_change": "delta_t_ms > 43200000 AND (application_changed OR window_title_changed OR browser_domain_changed OR interaction_category_changed)", "two_thresholds": RULE}


@plan("e06_methods_compared", " UNION ALL ".join(f"""SELECT '{m}' AS method, count(*) AS n_segments, count(*) - count(DISTINCT session_id) AS n_cuts, round(avg(n), 6) AS mean_events, round(avg(ms), 3) AS mean_ms, max(n) AS max_events FROM (
  SELECT session_id, g, count(*) AS n, max(timestamp_ms) - min(timestamp_ms) AS ms FROM (SELECT *, coalesce(sum(CAST(p AS INTEGER)) OVER (PARTITION BY session_id ORDER BY idx), 0) AS g FROM (SELECT session_id, idx, timestamp_ms, lag({E06_SQL[m]}) OVER (PARTITION BY session_id ORDER BY idx) AS p FROM ({E06_ROWS}))) GROUP BY session_id, g)""" for m in E06))
def _(s, d):
    t, events = trans(s, d), canon(s, d)
    cuts_at = t.agg(F.percentile("delta_t_ms", F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99))).alias("p")).select(*(F.col("p")[i].alias(n) for i, n in enumerate(("p90", "p95", "p99"))))
    both = t.join(b.system_change(events).withColumnRenamed("boundary", "system_cut"), ["session_id", "idx"]).crossJoin(F.broadcast(cuts_at))  # one row
    at_least = lambda c: F.col("delta_t_ms") >= F.col(c)
    methods = {
        **{f"gap{h}": b.gap_at_least(h * fx.HOUR) for h in (6, 12, 24)},
        **{n: at_least(n) for n in ("p90", "p95", "p99")},
        "app": F.col("application_changed"),
        "system": F.col("system_cut"),
        "pause_and_change": b.pause_and_change(HALF_DAY),
        "two_thresholds": b.two_thresholds(6 * fx.HOUR, 24 * fx.HOUR),
    }
    flags = both.select("session_id", "idx", *(c.alias(n) for n, c in methods.items()))
    return ex.methods_compared(flags, events, list(E06)).withColumn("mean_events", F.round("mean_events", 6)).withColumn("mean_ms", F.round("mean_ms", 3))


@plan("e07_coherence", """SELECT session_id, seg_no, n, ms, nn AS next_n, nms AS next_ms, round(least(r, nr) / greatest(r, nr), 9) AS rate_ratio, round(len(list_intersect(t, nt)) / nullif(len(list_distinct(list_concat(t, nt))), 0), 9) AS types_jaccard
FROM (SELECT *, CASE WHEN ms > 0 THEN n * 1000 / ms END AS r, CASE WHEN nms > 0 THEN nn * 1000 / nms END AS nr FROM (SELECT *, lead(n) OVER w AS nn, lead(ms) OVER w AS nms, lead(t) OVER w AS nt
  FROM (SELECT session_id, seg_no, count(*) AS n, max(timestamp_ms) - min(timestamp_ms) AS ms, list(DISTINCT event_type) AS t FROM seg GROUP BY ALL) WINDOW w AS (PARTITION BY session_id ORDER BY seg_no)) WHERE nn IS NOT NULL)""".replace("least(r, nr) / greatest(r, nr)", "CASE WHEN r IS NULL AND nr IS NULL THEN NULL ELSE least(r, nr) / greatest(r, nr) END"))
def _(s, d):
    return _rounded(ex.coherence(segmented(s, d)).drop("apps_jaccard"), "rate_ratio", "types_jaccard")


@plan("e08_segment_costs", """SELECT session_id, seg_no, n, round(coalesce(sw, 0), 9) AS switch_rate, round(CASE WHEN ag > 0 THEN sg / ag END, 9) AS gap_cv, round(e, 9) AS type_entropy FROM (
  SELECT session_id, seg_no, count(*) AS n, avg(sw) AS sw, avg(g) AS ag, stddev_pop(g) AS sg FROM (SELECT session_id, seg_no, ln(1 + timestamp_ms - lag(timestamp_ms) OVER w) AS g, CAST(event_type <> lag(event_type) OVER w AS DOUBLE) AS sw FROM seg WINDOW w AS (PARTITION BY session_id, seg_no ORDER BY idx)) GROUP BY ALL)
JOIN (SELECT session_id, seg_no, abs(sum(q * log2(q))) AS e FROM (SELECT session_id, seg_no, count(*) / sum(count(*)) OVER (PARTITION BY session_id, seg_no) AS q FROM seg GROUP BY session_id, seg_no, event_type) GROUP BY ALL) USING (session_id, seg_no)""")
def _(s, d):
    return _rounded(ex.costs(segmented(s, d)).withColumn("type_entropy", F.abs("type_entropy")), "switch_rate", "gap_cv", "type_entropy")


@plan("e09_purity", "SELECT session_id, seg_no, coalesce(bool_or(is_boundary AND NOT l), false) AS is_mixed FROM (SELECT s.session_id, s.seg_no, is_boundary, lead(s.idx) OVER (PARTITION BY s.session_id, s.seg_no ORDER BY s.idx) IS NULL AS l FROM seg s LEFT JOIN labelled b USING (session_id, idx)) GROUP BY ALL")
def _(s, d):
    return ex.purity(segmented(s, d), labelled(s, d))


@plan("e10_interruption_profiles", "SELECT session_id, case_id, count(*) AS n, max(delta_t_ms) AS max_gap_ms, arg_min(idx, (-delta_t_ms, idx)) AS max_gap_idx, count(*) FILTER (delta_t_ms >= 43200000) AS gaps_0, count(*) FILTER (delta_t_ms >= 86400000) AS gaps_1, count(*) FILTER (application_changed) AS app_changes, count(*) FILTER (browser_domain_changed) AS domain_changes, round(avg(density_before), 9) AS mean_density FROM (SELECT t.*, g.case_id FROM trans t JOIN gt g ON g.session_id = t.session_id AND g.start_ms <= t.timestamp_ms AND t.next_timestamp_ms <= g.end_ms) GROUP BY ALL")
def _(s, d):
    return _rounded(ex.interruption_profile(jn.inside(trans(s, d), fx.ground_truth(s, d)), [HALF_DAY, 24 * fx.HOUR]), "mean_density")


@plan("e11_returns_inside", """SELECT r.session_id, r.case_id, value, left_end AS left_end_idx, start_idx AS return_start_idx, run_no - left_run = 2 AS is_immediate, start_idx - left_end - 1 AS away_events, b.timestamp_ms - a.timestamp_ms AS away_ms FROM (
  SELECT *, lag(run_no) OVER w AS left_run, lag(end_idx) OVER w AS left_end FROM (SELECT session_id, case_id, run_no, min(application) AS value, min(idx) AS start_idx, max(idx) AS end_idx FROM (
    SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY session_id, case_id ORDER BY idx) AS run_no FROM (SELECT *, row_number() OVER w > 1 AND application IS DISTINCT FROM lag(application) OVER w AS new FROM cased WHERE case_id IS NOT NULL WINDOW w AS (PARTITION BY session_id, case_id ORDER BY idx))) GROUP BY 1, 2, 3) WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY session_id, case_id, value ORDER BY run_no)) r JOIN canon a ON a.session_id = r.session_id AND a.idx = left_end JOIN canon b ON b.session_id = r.session_id AND b.idx = start_idx WHERE left_run IS NOT NULL""")
def _(s, d):
    return ex.returns_inside(cased(s, d).where("case_id IS NOT NULL"), "application")
