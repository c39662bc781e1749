"""The whole audit and the session profiles, over raw lines that Spark makes of the events with every fault that is looked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace import fixtures as fx
from worktrace.operators import audit
from worktrace.operators import evaluation as ev
from worktrace.plans import processes
from worktrace.plans import sequences as base
from worktrace.plans.oracle import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TYPES = ("view", "signup", "click", "purchase", "error")


def plan(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle)
        return f

    return add


def lines(s: SparkSession, d: str) -> DataFrame:
    """(session_dir, chunk_dir, raw). Copies: every seventh event as it is, every thirteenth under another id. Cut short: k = 13. Times as text 2.5 s off:
    k % 23 = 0; not UTC: k % 29 = 0; none: k % 41 = 0. Another session or chunk named: k % 31, k % 37 = 0. A layer of its own: k % 19 = 0."""
    k = F.col("k")
    copies = F.expr("filter(array(0, CASE WHEN event_id % 7 = 0 THEN 1 END, CASE WHEN event_id % 13 = 0 THEN 2 END), x -> x IS NOT NULL)")
    iso = F.date_format(F.timestamp_millis(F.col("timestamp_ms") + F.when(k % 23 == 0, 2500).otherwise(0)), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    rows = fx.raw_events(s, d).withColumn("copy", F.explode(copies))
    body = F.to_json(
        F.struct(
            F.concat(F.col("event_id").cast("string"), F.when(F.col("copy") == 2, "b").otherwise("")).alias("event_id"),
            F.when(k % 31 == 0, "other").otherwise(F.col("session_id")).alias("session_id"),
            "timestamp_ms",
            F.when(k % 41 != 0, F.concat(iso, F.when(k % 29 == 0, "+00:00").otherwise("Z"))).alias("timestamp_iso"),
            F.when(k % 19 == 0, "odd").when(k % 2 == 0, "browser").otherwise("ui").alias("layer"),
            F.when(k != 17, F.col("event_type")).alias("event_type"),
            F.when(k % 10 != 9, F.when(k % 5 == 0, "").otherwise("n")).alias("note"),
            F.map_filter(F.create_map(F.lit("text"), F.lit("t")), lambda a, b: k % 6 != 0).alias("payload"),
            F.struct(F.when(k % 37 == 0, "other").otherwise(F.col("chunk_id")).alias("chunk_id"), F.col("event_id").cast("long").alias("sequence_number")).alias("correlation"),
        )
    )
    whole = F.concat(F.expr("left(body, length(body) - 1)"), F.when(k % 7 == 0, ',"title":null}').otherwise(',"title":"t"}'))
    made = rows.withColumn("body", body)
    return made.select(F.col("session_id").alias("session_dir"), F.col("chunk_id").alias("chunk_dir"), F.when(k == 13, F.expr("left(body, 30)")).otherwise(whole).alias("raw"))


def known(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(a, t) for a in ("ui", "browser") for t in TYPES if (a, t) != ("ui", "purchase")], "layer string, event_type string")


_SENT = "SELECT *, CAST(event_id AS VARCHAR) || CASE WHEN copy = 2 THEN 'b' ELSE '' END AS id, CASE WHEN k <> 17 THEN event_type END AS kind, k % 6 = 0 AS bare, CASE WHEN k % 19 = 0 THEN 'odd' WHEN k % 2 = 0 THEN 'browser' ELSE 'ui' END AS layer FROM (SELECT *, unnest(CASE WHEN event_id % 91 = 0 THEN [0, 1, 2] WHEN event_id % 7 = 0 THEN [0, 1] WHEN event_id % 13 = 0 THEN [0, 2] ELSE [0] END) AS copy FROM raw)"
_GOOD = f"SELECT *, timestamp_ms - lag(timestamp_ms) OVER w AS pause, lag(id) OVER w IS NOT NULL AND kind IS NOT DISTINCT FROM lag(kind) OVER w AND bare = lag(bare) OVER w AS again FROM ({_SENT}) WHERE k <> 13 WINDOW w AS (PARTITION BY session_id ORDER BY timestamp_ms, event_id, id, copy)"
_COUNTS = {
    "times": {"not_utc": "k % 29 = 0 OR k % 41 = 0", "time_mismatch": "k % 23 = 0 AND k % 29 <> 0 AND k % 41 <> 0", "negative": "pause < 0", "zero": "pause = 0"},
    "pauses": {"under_100ms": "pause < 100", "100ms_to_1s": "pause >= 100 AND pause < 1000", "1s_to_10s": "pause >= 1000 AND pause < 10000", "10s_to_60s": "pause >= 10000 AND pause < 60000", "over_60s": "pause >= 60000"},
    "missing": {"note_absent": "k % 10 = 9", "note_null": "false", "note_empty": "k % 10 <> 9 AND k % 5 = 0", "title_absent": "false", "title_null": "k % 7 = 0", "title_empty": "false", "payload_absent": "false", "payload_null": "false", "payload_empty": "k % 6 = 0"},
    "identity": {"other_session": "k % 31 = 0", "other_chunk": "k % 37 = 0"},
}
_SAME = f"SELECT session_id, id, count(*) AS n FROM ({_SENT}) WHERE k <> 13 GROUP BY 1, 2 HAVING count(*) > 1"
_PARTS = [f"SELECT session_id, '{s}' AS section, '{n}' AS name, count(*) FILTER ({c}) AS value FROM ({_GOOD}) GROUP BY 1" for s, names in _COUNTS.items() for n, c in names.items()]
_PARTS += [
    f"SELECT session_id, 'times', 'longest', coalesce(greatest(max(pause), 0), 0) FROM ({_GOOD}) GROUP BY 1",
    *(f"SELECT session_id, 'lines', '{n}', count(*) FILTER ({c}) FROM ({_SENT}) GROUP BY 1" for n, c in (("n_lines", "true"), ("malformed", "k = 13"), ("n_events", "k <> 13"))),
    f"SELECT session_id, 'duplicates', 'exact_groups', count(*) FROM ({_SAME}) GROUP BY 1",
    f"SELECT session_id, 'duplicates', 'exact_repeats', sum(n - 1) FROM ({_SAME}) GROUP BY 1",
    f"SELECT session_id, 'duplicates', 'semantic_groups', count(*) FROM (SELECT session_id FROM ({_SENT}) WHERE k <> 13 GROUP BY session_id, timestamp_ms, kind, bare HAVING count(DISTINCT id) > 1) GROUP BY 1",
    f"SELECT session_id, 'sequential', coalesce(kind, 'none'), count(*) FROM ({_GOOD}) WHERE again AND kind IS DISTINCT FROM 'view' GROUP BY ALL",
    f"SELECT session_id, 'no_payload', coalesce(kind, 'none'), count(*) FROM ({_GOOD}) WHERE bare GROUP BY ALL",
    f"SELECT session_id, 'unknown', layer, count(*) FROM ({_GOOD}) WHERE layer = 'odd' GROUP BY ALL",
    f"SELECT session_id, 'unknown', layer || '/' || coalesce(kind, 'none'), count(*) FROM ({_GOOD}) WHERE layer <> 'odd' AND (kind IS NULL OR (layer = 'ui' AND kind = 'purchase')) GROUP BY ALL",
]
_FACTS = " UNION ALL ".join(_PARTS)
AUDIT = f"SELECT session_id, section, name, CAST(value AS BIGINT) AS value FROM ({_FACTS}) UNION ALL SELECT NULL, section, name, CAST(CASE WHEN name = 'longest' THEN max(value) ELSE sum(value) END AS BIGINT) FROM ({_FACTS}) GROUP BY section, name"


@plan("q_whole_audit", AUDIT)
def _(s, d):
    return audit.facts(lines(s, d), known(s), {"note": "$.note", "title": "$.title", "payload": "$.payload"}, ["view"])


def _profiles(s: SparkSession, d: str) -> DataFrame:
    events = base.canon(s, d).withColumns({"layer": F.when(F.col("browser_domain").isNull(), "ui").otherwise("browser"), "has_text": F.col("has_extracted_text")})
    return audit.session_profiles(events, fx.ground_truth(s, d))


def _map(column: str, most: str = "") -> str:
    return f"(SELECT session_id, string_agg(x || '=' || n, ',' ORDER BY x) AS by_{column} FROM (SELECT session_id, x, n FROM (SELECT session_id, {column} AS x, count(*) AS n FROM src WHERE {column} IS NOT NULL GROUP BY ALL) {most}) GROUP BY 1)"


_SRC = "(SELECT *, CASE WHEN browser_domain IS NULL THEN 'ui' ELSE 'browser' END AS layer FROM canon)"
PROFILE = f"SELECT b.*, round(n_text / n_events, 9) AS text_rate, session_id IN (SELECT session_id FROM gt) AS has_ground_truth, by_event_type, by_layer, by_application FROM (SELECT session_id, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_events, round((max(timestamp_ms) - min(timestamp_ms)) / 1000, 6) AS duration_s, count(*) FILTER (has_extracted_text) AS n_text FROM src GROUP BY 1) b LEFT JOIN {_map('event_type')} USING (session_id) LEFT JOIN {_map('layer')} USING (session_id) LEFT JOIN {_map('application', 'QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, x) <= 20')} USING (session_id)".replace("FROM src", f"FROM {_SRC}")


@plan("q17_session_profiles", PROFILE)
def _(s, d):
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    out = _profiles(s, d)
    return out.select("session_id", "n_chunks", "n_events", F.round("duration_s", 6).alias("duration_s"), "n_text", F.round("text_rate", 9).alias("text_rate"), "has_ground_truth", text("by_event_type"), text("by_layer"), text("by_application"))


#: Signals by name, and within how many ms of a point they count. Fixed values.
SIGNALS = {"error": "event_type = 'error'", "purchase": "event_type = 'purchase'", "clipboard_or_input": "interaction_category IN ('clipboard', 'input')", "noise_app": "application = 'app3'", "never": "event_type = 'none'"}
NEAR_MS = 12 * fx.HOUR


def _signal_sql(name: str, condition: str) -> str:
    points = f"SELECT p.session_id, p.at_ms, any_value(p.is_resume) AS r, coalesce(min(abs(c.timestamp_ms - p.at_ms)) <= {NEAR_MS}, false) AS hit FROM points p LEFT JOIN canon c ON c.session_id = p.session_id AND {condition} GROUP BY p.session_id, p.at_ms"
    events = f"SELECT c.session_id, c.idx, any_value(coalesce({condition}, false)) AS has, min(abs(c.timestamp_ms - p.at_ms)) AS d FROM canon c LEFT JOIN points p ON c.session_id = p.session_id GROUP BY c.session_id, c.idx"
    near = f"coalesce(d <= {NEAR_MS}, false)"
    return f"""SELECT '{name}' AS signal, * REPLACE (round(lift, 9) AS lift) FROM
(SELECT *, CASE WHEN interior > 0 THEN near / interior END AS lift, round(near, 9) AS near_rate, round(interior, 9) AS interior_rate FROM (SELECT count(*) AS n_events, count(*) FILTER (has) AS n_signal_events, count(*) FILTER (has AND {near}) AS n_aligned, count(*) FILTER (has AND NOT {near}) AS n_unaligned,
 round(coalesce(count(*) FILTER (has AND {near}) / nullif(count(*) FILTER (has), 0), 0), 9) AS "precision", round(avg(d) FILTER (has AND {near}), 3) AS distance_mean, median(d) FILTER (has AND {near}) AS distance_median,
 coalesce(count(*) FILTER (has AND {near}) / nullif(count(*) FILTER ({near}), 0), 0) AS near, coalesce(count(*) FILTER (has AND NOT {near}) / nullif(count(*) FILTER (NOT {near}), 0), 0) AS interior FROM ({events}))),
(SELECT count(*) AS n_sessions_with_points, CAST(sum(n) AS BIGINT) AS n_points, CAST(sum(r) AS BIGINT) AS n_resumed, round(sum(h) / sum(n), 9) AS coverage, round(1 - sum(h) / sum(n), 9) AS missed, round(sum(rh) / nullif(sum(r), 0), 9) AS resumed_coverage, round((sum(h) - sum(rh)) / nullif(sum(n) - sum(r), 0), 9) AS normal_coverage,
 round(avg(h / n), 9) AS session_coverage_mean, round(stddev_pop(h / n), 9) AS session_coverage_std, round(min(h / n), 9) AS session_coverage_min, round(max(h / n), 9) AS session_coverage_max FROM (SELECT session_id, count(*) AS n, count(*) FILTER (hit) AS h, count(*) FILTER (r) AS r, count(*) FILTER (hit AND r) AS rh FROM ({points}) GROUP BY 1))"""


@plan("v04_signals", " UNION ALL ".join(f"SELECT * EXCLUDE (near, interior) FROM ({_signal_sql(n, c)})" for n, c in SIGNALS.items()))
def _(s, d):
    from worktrace.operators import signals

    out = signals.evaluated(base.canon(s, d), base.points(s, d), {n: F.expr(c) for n, c in SIGNALS.items()}, NEAR_MS)
    ratios = ["precision", "near_rate", "interior_rate", "lift", "coverage", "missed", "resumed_coverage", "normal_coverage", *(f"session_coverage_{x}" for x in ("mean", "std", "min", "max"))]
    return out.withColumns({c: F.round(c, 9) for c in ratios} | {"distance_mean": F.round("distance_mean", 3)})


CHANGES = ("application_changed", "window_title_changed", "browser_domain_changed", "interaction_category_changed")
_KINDS = f"SELECT l.*, i.case_id, CASE WHEN predicted AND is_boundary THEN 'true' WHEN predicted AND i.case_id IS NOT NULL THEN 'false_inside' WHEN predicted THEN 'false_noise' WHEN is_boundary THEN 'missed' ELSE 'quiet' END AS kind FROM ({processes.PRED}) l LEFT JOIN (SELECT session_id, idx, CASE WHEN case_id = lead(case_id) OVER (PARTITION BY session_id ORDER BY idx) THEN case_id END AS case_id FROM cased) i USING (session_id, idx)"


@plan("v17_forensics", f"SELECT kind, CAST(sum(n) AS BIGINT) AS n, count(case_id) AS n_executions, coalesce(max(n) FILTER (case_id IS NOT NULL), 0) AS most_in_one, round(sum(p) / sum(n), 6) AS mean_log_pause, {', '.join(f'round(sum(s{i}) / sum(n), 9) AS share_{c}' for i, c in enumerate(CHANGES))} FROM (SELECT kind, case_id, count(*) AS n, sum(ln(1 + greatest(delta_t_ms, 0))) AS p, {', '.join(f'count(*) FILTER ({c}) AS s{i}' for i, c in enumerate(CHANGES))} FROM ({_KINDS}) GROUP BY kind, case_id) GROUP BY kind")
def _(s, d):
    out = ev.boundary_forensics(processes.truth(s, d), base.cased(s, d).select("session_id", "idx", "case_id"), CHANGES)
    return out.withColumns({"mean_log_pause": F.round("mean_log_pause", 6)} | {f"share_{c}": F.round(f"share_{c}", 9) for c in CHANGES})
