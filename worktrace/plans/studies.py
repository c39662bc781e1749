"""Plans for sources, split and merge costs, sampled points, model parts and stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace import fixtures as fx
from worktrace.operators import boundary as b
from worktrace.operators import discovery as dc
from worktrace.operators import evaluation as ev
from worktrace.operators import executions as ex
from worktrace.operators import joins as jn
from worktrace.operators import learning as ln
from worktrace.operators import sequence as sq
from worktrace.plans import audits, models, processes
from worktrace.plans import sequences as base
from worktrace.plans.oracle import sql
from worktrace.sources import logs
from worktrace.streaming import sessions as st

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def plan(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle)
        return f

    return add


# sources: listings and texts that the folders would hold, derived from the events


def files(s: SparkSession, d: str) -> DataFrame:
    """(path, size) of a dataset folder: one chunk a day, with events, and screenshots in it or beside it."""
    day = F.col("chunk_id")
    at = F.date_format((F.col("timestamp_ms") / 1000).cast("timestamp"), "MMdd")
    chunk = base.canon(s, d).groupBy("session_id", "chunk_id").agg(F.count("*").alias("n"), F.min(at).alias("md"))
    stem = F.concat(F.lit("/data/"), "session_id", F.lit("/"))
    own = F.concat(stem, F.lit("part_"), "md")
    made = F.array(
        F.struct(F.concat(own, F.lit("/events.jsonl")).alias("path"), (F.col("n") * 100).alias("size")),
        F.struct(F.when(F.dayofmonth(day.cast("date")) % 3 == 0, F.concat(own, F.lit("/shot.png"))).alias("path"), F.col("n").alias("size")),
        F.struct(F.when(F.dayofmonth(day.cast("date")) % 3 == 1, F.concat(stem, F.lit("chunk_"), "md", F.lit("/shot.jpg"))).alias("path"), F.col("n").alias("size")),
    )
    return chunk.select(F.explode(made).alias("f")).select("f.path", F.col("f.size").cast("long").alias("size")).where("path IS NOT NULL")


DAYS = "SELECT session_id, chunk_id, strftime(min(make_timestamp(timestamp_ms * 1000)), '%m%d') AS md, day(CAST(chunk_id AS DATE)) AS dom, count(*) AS n FROM canon GROUP BY 1, 2"


@plan("a01_discover_chunks", f"SELECT session_id AS session_dir, concat('part_', md) AS chunk_dir, n * 100 AS size, CASE dom % 3 WHEN 0 THEN concat('part_', md) WHEN 1 THEN concat('chunk_', md) END AS shots_dir, CASE WHEN dom % 3 < 2 THEN 1 ELSE 0 END AS n_shots FROM ({DAYS})")
def _(s, d):
    found = logs.chunks_of(files(s, d))
    return found.select("session_dir", "chunk_dir", "size").join(logs.screenshot_folders(found.select("session_dir", "chunk_dir"), files(s, d)), ["session_dir", "chunk_dir"])


@plan("a04_manifests", f"SELECT session_id, CASE WHEN dom % 7 <> 0 THEN chunk_id END AS chunk_id, CASE WHEN dom % 7 <> 0 THEN n END AS end_ms, dom % 7 = 0 AS malformed FROM (SELECT CASE WHEN dom % 7 <> 0 THEN session_id END AS session_id, chunk_id, dom, n FROM ({DAYS}))")
def _(s, d):
    day = F.dayofmonth(F.col("chunk_id").cast("date"))
    chunk = base.canon(s, d).groupBy("session_id", "chunk_id").agg(F.count("*").alias("n"))
    text = F.to_json(F.struct("chunk_id", "session_id", F.struct(F.lit(0).alias("start_ms"), F.col("n").alias("end_ms")).alias("time_range")))
    found = logs.manifests_from(chunk.select(F.when(day % 7 == 0, F.lit("{broken")).otherwise(text).alias("raw")))
    return found.select("session_id", "chunk_id", F.col("time_range.end_ms").alias("end_ms"), F.col("_corrupt_record").isNotNull().alias("malformed"))


@plan("a07_ground_truth_log", f"SELECT session_id, rec_no, event, process_code, at_ms FROM ({audits.LOG}) WHERE rec_no % 9 <> 4")
def _(s, d):
    log = audits.gt_log(s, d)
    stamp = F.concat(F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    text = F.to_json(F.struct("event", stamp.alias("ts_utc"), "process_code", "case_id", "split_id"))
    lines = log.select("session_id", "rec_no", F.when(F.col("rec_no") % 9 == 4, F.concat(F.lit("{"), text)).otherwise(text).alias("raw"))
    good, _bad = logs.records_from(lines)
    return good.select("session_id", "rec_no", "event", "process_code", "at_ms")


@plan("a07_malformed_records", f"SELECT session_id, rec_no FROM ({audits.LOG}) WHERE rec_no % 9 = 4")
def _(s, d):
    lines = audits.gt_log(s, d).select("session_id", "rec_no", F.when(F.col("rec_no") % 9 == 4, F.lit("{ not json")).otherwise(F.lit("{}")).alias("raw"))
    return logs.records_from(lines)[1].select("session_id", "rec_no")


@plan("a08_manifest_executions", "SELECT session_id AS session_dir, process_code, case_id, start_ms, end_ms, start_ms % 4 = 0 AS suspended FROM gt")
def _(s, d):
    gt = fx.ground_truth(s, d)
    one = F.struct(F.when(F.col("end_ms") % 2 == 0, F.col("process_code")).alias("code"), F.lit("v").alias("variant"), "case_id", F.timestamp_millis("start_ms").alias("start_ts"), F.timestamp_millis("end_ms").alias("end_ts"), F.array(F.lit("app")).alias("apps"), F.when(F.col("start_ms") % 4 == 0, F.lit("s")).alias("split_id"))
    by_code = gt.groupBy("session_id", "process_code").agg(F.collect_list(one).alias("executions"))
    texts = by_code.groupBy("session_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("process_code").alias("code"), F.lit("f").alias("family_name"), "executions")).alias("processes"))).alias("raw"))
    found = texts.select(F.col("session_id").alias("session_dir"), F.from_json("raw", logs.GT_MANIFEST)["processes"].alias("processes"))
    return logs.executions_from(found).select("session_dir", "process_code", "case_id", "start_ms", "end_ms", "suspended")


@plan("a09_references", f"SELECT session_id AS session_dir, concat('part_', md) AS chunk_dir, dom % 3 = 0 AS present, CASE WHEN dom % 3 = 0 THEN n END AS file_size FROM ({DAYS})")
def _(s, d):
    refs = logs.chunks_of(files(s, d)).select("session_dir", "chunk_dir", F.lit("shot.png").alias("filename"))
    return logs.resolved(refs, files(s, d)).select("session_dir", "chunk_dir", "present", "file_size")


# split against merge


COST = "SELECT session_id, seg_no, coalesce(sw, 0) AS switch_rate, CASE WHEN ag > 0 THEN sg / ag END AS gap_cv, e AS type_entropy FROM (SELECT session_id, seg_no, avg(sw) AS sw, avg(g) AS ag, stddev_pop(g) AS sg FROM (SELECT session_id, seg_no, ln(1 + timestamp_ms - lag(timestamp_ms) OVER w) AS g, CAST(event_type <> lag(event_type) OVER w AS DOUBLE) AS sw FROM {x} WINDOW w AS (PARTITION BY session_id, seg_no ORDER BY idx)) GROUP BY ALL) JOIN (SELECT session_id, seg_no, abs(sum(q * log2(q))) AS e FROM (SELECT session_id, seg_no, count(*) / sum(count(*)) OVER (PARTITION BY session_id, seg_no) AS q FROM {x} GROUP BY session_id, seg_no, event_type) GROUP BY ALL) USING (session_id, seg_no)"
MERGED = "(SELECT * EXCLUDE (last) FROM (SELECT * REPLACE (unnest([seg_no - 1, seg_no]) AS seg_no) FROM (SELECT *, max(seg_no) OVER (PARTITION BY session_id) AS last FROM seg)) WHERE seg_no >= 0 AND seg_no < last)"
PARTS = ("switch_rate", "gap_cv", "type_entropy")
Z = "SELECT session_id, seg_no, " + " + ".join(f"coalesce(({c} - (SELECT avg({c}) FROM own)) / nullif((SELECT stddev_pop({c}) FROM own), 0), 0)" for c in PARTS) + " AS z FROM {x}"
GAP = f"WITH own AS ({COST.format(x='seg')}), mer AS ({COST.format(x=MERGED)}), zo AS ({Z.format(x='own')}), zm AS ({Z.format(x='mer')}) SELECT m.session_id, m.seg_no, m.z AS merged_z, h.s AS split_z, m.z - h.s AS gap FROM zm m JOIN (SELECT session_id, seg_no, z + lead(z) OVER (PARTITION BY session_id ORDER BY seg_no) AS s FROM zo) h ON h.session_id = m.session_id AND h.seg_no = m.seg_no"


@plan("v24_split_gaps", f"SELECT session_id, seg_no, round(merged_z, 6) AS merged_z, round(split_z, 6) AS split_z, round(gap, 6) AS gap FROM ({GAP})")
def _(s, d):
    return ex.split_gaps(base.segmented(s, d)).withColumns({c: F.round(c, 6) for c in ("merged_z", "split_z", "gap")})


LAMBDAS = (-4.0, -2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 4.0)


@plan("v24_split_sweep", f"SELECT lam, count(*) FILTER (round(gap, 9) > lam) AS kept, count(*) FILTER (round(gap, 9) > lam AND coalesce(is_boundary, false)) AS true_kept, count(*) FILTER (coalesce(is_boundary, false)) AS true_cuts FROM ({GAP}) g JOIN (SELECT session_id, seg_no, max(idx) AS idx FROM seg GROUP BY ALL) USING (session_id, seg_no) LEFT JOIN labelled USING (session_id, idx), (SELECT CAST(unnest([{', '.join(map(str, LAMBDAS))}]) AS DOUBLE) AS lam) GROUP BY 1")
def _(s, d):
    """Cuts that a penalty lets stand, and how many of them are true."""
    seg = base.segmented(s, d)
    at = seg.groupBy("session_id", "seg_no").agg(F.max("idx").alias("idx"))
    truth = base.labelled(s, d).select("session_id", "idx", "is_boundary")
    judged = ex.split_gaps(seg).withColumn("gap", F.round("gap", 9)).join(at, ["session_id", "seg_no"]).join(truth, ["session_id", "idx"], "left").withColumn("is_boundary", F.coalesce("is_boundary", F.lit(False)))
    cells = [x for i, v in enumerate(LAMBDAS) for x in (F.count_if(F.col("gap") > v).alias(f"k{i}"), F.count_if((F.col("gap") > v) & F.col("is_boundary")).alias(f"t{i}"))]
    rows = F.array(*(F.struct(F.lit(v).alias("lam"), F.col(f"k{i}").alias("kept"), F.col(f"t{i}").alias("true_kept"), "true_cuts") for i, v in enumerate(LAMBDAS)))
    return judged.agg(F.count_if("is_boundary").alias("true_cuts"), *cells).select(F.explode(rows).alias("x")).select("x.*")


@plan("v27_sampled_points", f"SELECT p.point_id, p.kind, p.session_id, p.at_ms, inside_id, before_id, after_id, i.dominant_context AS inside_context, i.event_count AS inside_events, sg.signature AS inside_systems FROM (@B20) p LEFT JOIN (SELECT point_id, arg_min(execution_id, start_ms) FILTER (at_ms BETWEEN start_ms AND end_ms) AS inside_id, arg_max(execution_id, start_ms) FILTER (end_ms < at_ms) AS before_id, arg_min(execution_id, start_ms) FILTER (start_ms > at_ms) AS after_id FROM (@B20) JOIN exec USING (session_id) GROUP BY 1) f USING (point_id) LEFT JOIN exec i ON i.execution_id = inside_id LEFT JOIN sigs sg ON sg.session_id = i.session_id AND sg.seg_no = i.seg_no".replace("@B20", base.SAMPLED))
def _(s, d):
    """Sampled points with the execution around, before and after each, and its context, size and ordered systems."""
    points, seg = base.sampled(s, d), base.segmented(s, d)
    whole = ex.executions(seg, fx.NOISE_APPS).join(ex.dominant_context(seg, fx.SUFFIXES), ["session_id", "seg_no"])
    found = ex.around_points(points, whole)
    signatures = dc.signatures(dc.trace_steps(ex.steps(seg), F.col("system")))
    inside = whole.join(signatures, ["session_id", "seg_no"], "left").select(F.col("execution_id").alias("inside_id"), F.col("dominant_context").alias("inside_context"), F.col("event_count").alias("inside_events"), F.col("signature").alias("inside_systems"))
    return found.join(inside, "inside_id", "left").select("point_id", "kind", "session_id", "at_ms", "inside_id", "before_id", "after_id", "inside_context", "inside_events", "inside_systems")


# model parts


@plan("m05_importance")
def _(s, d):
    return ln.importance(models.second(s, d), ln.SECOND, "is_boundary").withColumn("coefficient", F.round("coefficient", 4))


@plan("m05_contributions")
def _(s, d):
    """Mean contribution of each feature on true boundaries and on the other transitions."""
    parts = ln.contributions(models.second(s, d), ln.SECOND, "is_boundary", ["is_boundary"])
    return parts.groupBy("is_boundary").agg(F.count("*").alias("n"), *(F.round(F.avg(f"part_{c}"), 4).alias(f"part_{c}") for c in ln.SECOND))


@plan("m07_motifs", f"SELECT o.session_id, o.a, o.b, total - own AS n_elsewhere FROM (SELECT session_id, a, b, count(*) AS own FROM ({base.HOPS}) WHERE a <> b GROUP BY ALL) o JOIN (SELECT a, b, count(*) AS total FROM ({base.HOPS}) WHERE a <> b GROUP BY ALL) USING (a, b) WHERE total - own >= 50")
def _(s, d):
    return b.motifs(base.canon(s, d), 50)


# stream operators on a whole table


@plan("x02_gap_segments", "SELECT session_id, count(*) AS n_events, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY session_id ORDER BY idx) AS g FROM (SELECT *, coalesce(timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY idx) > 86400000, false) AS new FROM canon)) GROUP BY session_id, g")
def _(s, d):
    found = st.gap_segments(base.canon(s, d).withColumn("at", F.timestamp_millis("timestamp_ms")), "at", "24 hours")
    return found.select("session_id", "n_events", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("last_at").alias("last_ms"))


@plan("x03_quality_counters", "SELECT (timestamp_ms // 86400000) * 86400000 AS start_ms, count(*) AS n, count(*) FILTER (application IS NULL) AS no_app, round(avg(CAST(browser_domain IS NOT NULL AS INTEGER)), 9) AS coverage FROM canon GROUP BY 1")
def _(s, d):
    found = st.quality_counters(base.canon(s, d).withColumn("at", F.timestamp_millis("timestamp_ms")), "at", "1 day")
    return found.select(F.unix_millis("start").alias("start_ms"), "n", "no_app", F.round("coverage", 9).alias("coverage"))


# promotion of a candidate detector over the one in use


#: Gates of a promotion: least gain of F1 and recall; what may be added to, or times, the figures of the detector in use. Fixed values.
GATES = {"least_gain": 0.02, "least_recall": 0.55, "more_fragmented": 2.0, "times_under": 2.0, "times_over": 1.25, "most_degraded": 0.4}
IN_USE, CANDIDATE = "(delta_t_ms > 43200000)", "(delta_t_ms > 21600000 OR application_changed)"
GAINS = f"SELECT session_id, x.f1 AS a, y.f1 AS b, y.f1 - x.f1 AS gain, operator FROM ({processes.SF1.format(prf=processes.PRF, x=IN_USE)}) x JOIN ({processes.SF1.format(prf=processes.PRF, x=CANDIDATE)}) y USING (session_id) JOIN (SELECT DISTINCT session_id, operator FROM canon) USING (session_id)"


def _flagged(s: SparkSession, d: str) -> DataFrame:
    wider = b.pause(6 * fx.HOUR) | F.col("application_changed")
    return base.labelled(s, d).withColumns({"in_use": b.pause(base.HALF_DAY), "candidate": wider})


def _gains(s: SparkSession, d: str) -> DataFrame:
    rows, who = _flagged(s, d), base.canon(s, d).select("session_id", "operator").distinct()
    per = lambda c, n: ev.boundary_metrics(rows, "is_boundary", c, ["session_id"]).where("session_id IS NOT NULL").select("session_id", F.col("f1").alias(n))
    return per("in_use", "a").join(per("candidate", "b"), "session_id").join(who, "session_id").withColumn("gain", F.col("b") - F.col("a"))


@plan("v12_extreme_sessions", f"SELECT * FROM (SELECT 'best' AS side, session_id, round(gain, 9) AS gain, row_number() OVER (ORDER BY round(gain, 9) DESC, session_id) AS place FROM ({GAINS}) UNION ALL SELECT 'worst', session_id, round(gain, 9), row_number() OVER (ORDER BY round(gain, 9), session_id) FROM ({GAINS})) WHERE place <= 5")
def _(s, d):
    """The five sessions that gain most and the five that lose most."""
    return ev.extremes(_gains(s, d).withColumn("gain", F.round("gain", 9)), "gain", 5)


SURVIVAL = f"SELECT count(*) AS n_sessions, round(avg(gain), 9) AS mean_gain, round(avg(gain) FILTER (place > 3), 9) AS without_top_three, round((SELECT avg(gain) FROM ({GAINS}) JOIN (SELECT operator, row_number() OVER (ORDER BY round(avg(gain), 9) DESC, operator) AS place FROM ({GAINS}) GROUP BY operator) USING (operator) WHERE place > 1), 9) AS without_best_operator, round(avg(CAST(gain < -0.01 AS INTEGER)), 9) AS degraded FROM (SELECT *, row_number() OVER (ORDER BY round(gain, 9) DESC, session_id) AS place FROM ({GAINS}))"


@plan("v13_gain_survival", SURVIVAL)
def _(s, d):
    """Mean gain of F1, without the three sessions that gain most, and over operators without the one that gains most."""
    return ev.gain_survival(_gains(s, d), 3).withColumns({c: F.round(c, 9) for c in ("mean_gain", "without_top_three", "without_best_operator", "degraded")})


CUT_BY = "SELECT session_id, g AS seg_no, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms FROM (SELECT *, coalesce(sum(CAST(p AS INTEGER)) OVER (PARTITION BY session_id ORDER BY idx), 0) AS g FROM (SELECT c.session_id, c.idx, c.timestamp_ms, lag({x}) OVER (PARTITION BY c.session_id ORDER BY c.idx) AS p FROM canon c LEFT JOIN trans t USING (session_id, idx))) GROUP BY 1, 2"
OVER_BY = "SELECT s.session_id, s.seg_no, g.case_id FROM ({spans}) s JOIN gt g ON s.session_id = g.session_id AND s.start_ms < g.end_ms AND g.start_ms < s.end_ms"


def _segmentation_sql(x: str) -> str:
    spans = CUT_BY.format(x=x)
    over = OVER_BY.format(spans=spans)
    m = processes.EM.format(k="", g="").replace("FROM over", f"FROM ({over})")
    n = processes.ES.format(k="", g="").replace("FROM over", f"FROM ({over})").replace("FROM spans s", f"FROM ({spans}) s")
    return f"SELECT *, {processes.RATES} FROM ({m}), ({n})"


def _pooled_sql(x: str) -> str:
    return f"SELECT r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT {processes.PRF} FROM (SELECT count(*) FILTER (is_boundary AND {x}) AS tp, count(*) FILTER (NOT is_boundary AND {x}) AS fp, count(*) FILTER (is_boundary AND NOT {x}) AS fn FROM labelled))"


@plan("v14_eight_gates", f"SELECT *, g1 AND g2 AND g3 AND g4 AND g5 AND g6 AND g7 AND g8 AS promoted FROM (SELECT c.f1 - a.f1 >= {GATES['least_gain']} AS g1, c.r >= {GATES['least_recall']} AS g2, n.pct_fragmented <= o.pct_fragmented + {GATES['more_fragmented']} AS g3, n.under_rate <= o.under_rate * {GATES['times_under']} AS g4, n.over_rate <= o.over_rate * {GATES['times_over']} AS g5, degraded <= {GATES['most_degraded']} AS g6, without_top_three > 0 AS g7, without_best_operator > 0 AS g8 FROM ({_pooled_sql(IN_USE)}) a, ({_pooled_sql(CANDIDATE)}) c, ({_segmentation_sql(IN_USE)}) o, ({_segmentation_sql(CANDIDATE)}) n, ({SURVIVAL}))")
def _(s, d):
    """Gain of F1, recall, fragmentation, under- and over-segmentation, degraded sessions, and whether the gain survives without its
    best sessions and without its best operator."""
    rows, gt = _flagged(s, d), fx.ground_truth(s, d)
    figures = ("pct_fragmented", "under_rate", "over_rate")

    def segmentation(c: str, name: str) -> DataFrame:
        spans = ex.segment_spans(sq.segments(base.canon(s, d), rows.select("session_id", "idx", F.col(c).alias("boundary"))))
        found = ev.execution_metrics(spans, gt, jn.overlaps(spans, gt, 30 * 24 * fx.HOUR))
        return found.select(*(F.col(f).alias(f"{name}_{f}") for f in figures))

    pooled = lambda c, n: ev.boundary_metrics(rows, "is_boundary", c).select(F.col("f1").alias(f"{n}_f1"), F.col("recall").alias(f"{n}_recall"))
    one = pooled("in_use", "old")
    for part in (pooled("candidate", "new"), segmentation("in_use", "old"), segmentation("candidate", "new"), ev.gain_survival(_gains(s, d), 3)):
        one = one.crossJoin(part)  # one row each
    return ev.gates(one, GATES)


# what happens on the paths of a process


def _classed(s: SparkSession, d: str) -> DataFrame:
    """Events with the process and the path class of their execution, and the applications before and after it."""
    classes = dc.classify(processes.rows(s, d)).select("session_id", "seg_no", "process_id", "path_class", "duration_ms")
    w = sq.ordered()
    events = base.segmented(s, d).withColumns({"app_before": F.lag("application").over(w), "app_after": F.lead("application").over(w), "edge_before": F.lag("seg_no").over(w) != F.col("seg_no"), "edge_after": F.lead("seg_no").over(w) != F.col("seg_no")})
    own = sq.ordered("session_id", "seg_no")
    events = events.withColumns({"entry": F.lag("idx").over(own).isNull(), "exit": F.lead("idx").over(own).isNull()})
    return events.join(classes, ["session_id", "seg_no"])


CLASSED = f"SELECT e.*, lag(idx) OVER o IS NULL AS entry, lead(idx) OVER o IS NULL AS exit, process_id, path_class, duration_ms FROM (SELECT *, lag(application) OVER w AS app_before, lead(application) OVER w AS app_after, lag(seg_no) OVER w <> seg_no AS edge_before, lead(seg_no) OVER w <> seg_no AS edge_after FROM seg WINDOW w AS (PARTITION BY session_id ORDER BY idx)) e JOIN (SELECT session_id, seg_no, dominant_context AS process_id, duration_ms, CASE WHEN signature = dominant THEN 'dominant' WHEN list_has_all(string_split(signature, '>'), string_split(dominant, '>')) THEN 'detour' ELSE 'other' END AS path_class FROM ex JOIN ({processes.TOP}) t ON t.process_id = ex.dominant_context) c USING (session_id, seg_no) WINDOW o AS (PARTITION BY e.session_id, e.seg_no ORDER BY idx)"
#: Aspect: (condition, value), the same in both languages.
FORENSICS = {
    "event_type": ("true", "event_type"),
    "click_target": ("event_type = 'click'", "application"),
    "field": ("interaction_category = 'input'", "window_title"),
    "input_method": ("interaction_category IN ('input', 'clipboard')", "event_type"),
    "route": ("browser_url IS NOT NULL", "substring(browser_url, 23, 9)"),
    "entry_type": ("entry", "event_type"),
    "exit_type": ("exit", "event_type"),
    "app_before": ("entry AND edge_before", "app_before"),
    "app_after": ("exit AND edge_after", "app_after"),
    "detour_document": ("path_class = 'detour'", "window_title"),
}


@plan("p14_path_forensics", "SELECT path_class, aspect, value, n FROM (SELECT *, row_number() OVER (PARTITION BY path_class, aspect ORDER BY n DESC, value) AS place FROM (" + " UNION ALL ".join(f"SELECT path_class, '{a}' AS aspect, {v} AS value, count(*) AS n FROM ({CLASSED}) WHERE {c} AND {v} IS NOT NULL GROUP BY 1, 3" for a, (c, v) in FORENSICS.items()) + ")) WHERE place <= 20")
def _(s, d):
    """The twenty most frequent values of each aspect by path class, from one pass."""
    return dc.top_aspects(_classed(s, d), ["path_class"], FORENSICS, 20)


#: Aspects of a process summary and profile.
SUMMARY = {"application": ("true", "application"), "system": ("true", "system"), "category": ("true", "interaction_category"), "event_type": ("true", "event_type")}
SPREAD = {"operator": ("entry", "operator"), "category": ("true", "interaction_category"), "day": ("entry", "chunk_id"), "path_class": ("entry", "path_class")}


def _aspects_sql(aspects: dict, most: int | None) -> str:
    return "SELECT process_id, aspect, value, n FROM (SELECT *, row_number() OVER (PARTITION BY process_id, aspect ORDER BY n DESC, value) AS place FROM (" + " UNION ALL ".join(f"SELECT process_id, '{a}' AS aspect, {v} AS value, count(*) AS n FROM ({CLASSED}) WHERE {c} AND {v} IS NOT NULL GROUP BY 1, 3" for a, (c, v) in aspects.items()) + "))" + (f" WHERE place <= {most}" if most else "")


@plan("p16_top_values", _aspects_sql(SUMMARY, 5))
def _(s, d):
    return dc.top_aspects(_classed(s, d), ["process_id"], SUMMARY, 5)


@plan("p06_distributions", _aspects_sql(SPREAD, None))
def _(s, d):
    """Executions by operator, day and path class, and events by category, of each process."""
    return dc.top_aspects(_classed(s, d), ["process_id"], SPREAD)


@plan("p09_process_inputs", f"SELECT process_id, count(DISTINCT operator) AS n_users, string_agg(DISTINCT application, ',' ORDER BY application) AS applications, count(*) FILTER (interaction_category IN ('input', 'pointer', 'clipboard')) AS n_manual, round(sum(CASE WHEN entry THEN duration_ms END) / 3600000.0, 6) AS hours FROM ({CLASSED}) GROUP BY 1")
def _(s, d):
    apps = F.concat_ws(",", F.array_sort(F.collect_set("application")))
    manual = F.col("interaction_category").isin(*fx.MANUAL)
    return _classed(s, d).groupBy("process_id").agg(F.count_distinct("operator").alias("n_users"), F.nullif(apps, F.lit("")).alias("applications"), F.count_if(manual).alias("n_manual"), F.round(F.sum(F.when(F.col("entry"), F.col("duration_ms"))) / 3_600_000, 6).alias("hours"))


KNOWN = ["app:app0", "app:app1", "app:app2", "browser:127.0.0.1:5130", "browser:127.0.0.1:5131"]


@plan("p15_coverage", f"SELECT reason, path_class, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS ms, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT duration_ms, CASE WHEN signature = '' THEN 'no_evidence' WHEN NOT list_has_all({KNOWN}, string_split(signature, '>')) THEN 'unknown_system' WHEN duration_ms > 432000000 THEN 'too_long' WHEN len(string_split(signature, '>')) > 3 THEN 'too_many_steps' ELSE 'eligible' END AS reason, CASE WHEN signature = dominant THEN 'dominant' WHEN list_has_all(string_split(signature, '>'), string_split(dominant, '>')) THEN 'detour' ELSE 'other' END AS path_class FROM ex JOIN ({processes.TOP}) t ON t.process_id = ex.dominant_context) GROUP BY 1, 2")
def _(s, d):
    routed = dc.routed(dc.classify(processes.rows(s, d)), KNOWN, 120 * fx.HOUR)
    out = routed.groupBy("reason", "path_class").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(sq.Window.partitionBy()), 9))  # few rows
