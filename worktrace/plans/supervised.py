"""Plans for supervised models: process classes of executions, links between events, feature sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace import fixtures as fx
from worktrace.operators import density as dn
from worktrace.operators import regression as rg
from worktrace.operators import supervised as sv
from worktrace.operators.classes import class_predictions
from worktrace.operators.tables import written
from worktrace.plans import sequences as base
from worktrace.plans.oracle import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FOLDS = 5
#: Trees of the registered forests; their depth is the operators' default.
TREES = 60


def plan(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle)
        return f

    return add


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def _hash(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT)"


# --- process classes ---------------------------------------------------------------------------------------------------------

KEYS = ["session_id", "case_id"]


def executions(s: SparkSession, d: str) -> tuple[DataFrame, list[str], list[str]]:
    """Vectors of the executions known from ground truth, with their process."""
    events = base.cased(s, d).where("case_id IS NOT NULL")
    words = sv.top_values(base.canon(s, d), {"interaction_category": 12, "event_type": 14, "application": 10, "browser_domain": 10})
    rows, behaviour, identity = sv.execution_vectors(events, KEYS, words, fx.MANUAL)
    return rows.join(fx.ground_truth(s, d).select("case_id", "process_code"), "case_id"), behaviour, identity


_SHARES = ", ".join(
    [f"round(avg(CAST(coalesce(interaction_category = '{v}', false) AS INTEGER)), 9) AS cat_{v}" for v in fx.CATEGORIES.values()]
    + [f"round(avg(CAST(coalesce(event_type = '{v}', false) AS INTEGER)), 9) AS type_{v}" for v in fx.CATEGORIES]
    + [f"round(avg(CAST(coalesce(application = 'app{v}', false) AS INTEGER)), 9) AS app_app{v}" for v in range(4)]
    + [f"round(avg(CAST(coalesce(browser_domain = '127.0.0.1:{v}', false) AS INTEGER)), 9) AS domain_127_0_0_1_{v}" for v in (5130, 5131, 5132)]
)
VECTORS = f"""SELECT *, round(ln(1 + duration_ms), 9) AS log1p_duration, round(CASE WHEN duration_ms > 0 THEN n_events / (duration_ms / 1000) ELSE 0 END, 9) AS per_second FROM (
  SELECT session_id, case_id, any_value(process_code) AS process_code, CAST(count(*) AS DOUBLE) AS n_events, CAST(max(timestamp_ms) - min(timestamp_ms) AS DOUBLE) AS duration_ms, {_SHARES},
    CAST(count(DISTINCT interaction_category) AS DOUBLE) AS n_categories, CAST(count(DISTINCT event_type) AS DOUBLE) AS n_types,
    round(avg(CAST(interaction_category IN ('input', 'pointer', 'clipboard') AS INTEGER)), 9) AS manual_share, round(avg(CAST(coalesce(has_extracted_text, false) AS INTEGER)), 9) AS text_share,
    CAST(count(DISTINCT application) AS DOUBLE) AS n_applications, CAST(count(*) FILTER (switched) AS DOUBLE) AS n_switches, CAST(count(DISTINCT window_title) AS DOUBLE) AS n_titles
  FROM (SELECT *, row_number() OVER w > 1 AND lag(application) OVER w IS DISTINCT FROM application AS switched FROM cased WHERE case_id IS NOT NULL WINDOW w AS (PARTITION BY session_id, case_id ORDER BY idx))
  GROUP BY session_id, case_id HAVING count(*) >= 2)"""


@plan("m10_execution_vectors", VECTORS)
def _(s, d):
    rows, behaviour, identity = executions(s, d)
    return _r(rows.select(*KEYS, "process_code", *behaviour, *identity), *behaviour, *identity)


def _baselines(s, d):
    rows = executions(s, d)[0].select(*KEYS, F.col("process_code").alias("truth"), sv.group_fold(F.col("session_id"), FOLDS).alias("fold"))
    return sv.baseline_predictions(rows, "truth", "fold", F.col("case_id"))


_FOLDED = f"""rest AS (SELECT fold, l, t.n - coalesce(o.n, 0) AS n FROM (SELECT DISTINCT fold FROM e) CROSS JOIN (SELECT truth AS l, count(*) AS n FROM e GROUP BY 1) t LEFT JOIN (SELECT fold, truth AS l, count(*) AS n FROM e GROUP BY 1, 2) o USING (fold, l) WHERE t.n - coalesce(o.n, 0) > 0),
most AS (SELECT fold, l FROM rest QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, l) = 1),
span AS (SELECT fold, l, sum(n) OVER (PARTITION BY fold ORDER BY l) - n AS lo, sum(n) OVER (PARTITION BY fold ORDER BY l) AS hi, sum(n) OVER (PARTITION BY fold) AS t FROM rest),
pred AS (SELECT 'majority' AS model, truth, l AS predicted FROM e LEFT JOIN most USING (fold)
  UNION ALL SELECT 'stratified', truth, l FROM e LEFT JOIN span ON span.fold = e.fold AND u * t >= lo AND u * t < hi),
counts AS (SELECT model, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
  SELECT model, truth AS label, CAST(truth IS NOT DISTINCT FROM predicted AS INTEGER) AS tp, 0 AS fp, CAST(truth IS DISTINCT FROM predicted AS INTEGER) AS fn FROM pred
  UNION ALL SELECT model, predicted, 0, 1, 0 FROM pred WHERE truth IS DISTINCT FROM predicted) WHERE label IS NOT NULL GROUP BY ALL),
report AS (SELECT model, label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, tp + fn AS support, tp FROM counts)"""


def _reported(body: str) -> str:
    """SQL over the baselines' predictions: the CTEs of the executions first."""
    head = sql(f"SELECT case_id, process_code AS truth, {_hash('session_id')} % {FOLDS} AS fold, {_hash('case_id')} / 268435456 AS u FROM cased WHERE case_id IS NOT NULL GROUP BY session_id, case_id, process_code HAVING count(*) >= 2")
    ctes, last = head.rsplit("\nSELECT", 1)
    return f"{ctes},\ne AS (SELECT{last}),\n{_FOLDED}\n{body}"


@plan("m10_baseline_classes")
def _(s, d):
    return _r(sv.class_report(_baselines(s, d), ["model"]).drop("tp"), "precision", "recall", "f1")


@plan("m10_baselines")
def _(s, d):
    return _r(sv.overall(sv.class_report(_baselines(s, d), ["model"]), ["model"]), "accuracy", "macro_f1", "weighted_f1")


@plan("m10_baseline_confusion")
def _(s, d):
    return sv.confusion(_baselines(s, d), ["model"])


ORACLE["m10_baseline_classes"] = _reported("SELECT model, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM report")
ORACLE["m10_baselines"] = _reported("SELECT model, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM report GROUP BY 1")
ORACLE["m10_baseline_confusion"] = _reported("SELECT model, truth, predicted, count(*) AS n FROM pred GROUP BY ALL")


def classified(s: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions of both variants by a multinomial regression and a forest: one written table."""
    rows, behaviour, identity = executions(s, d)
    sets = {"behaviour": behaviour, "identity": [*behaviour, *identity]}
    return sv.written(class_predictions(rows, sets, "process_code", "session_id", FOLDS, KEYS, trees=TREES), "predictions")


@plan("m10_models")
def _(s, d):
    of = ["variant", "model"]
    return sv.overall(sv.class_report(classified(s, d), of), of)


@plan("m10_confusion")
def _(s, d):
    return sv.confusion(classified(s, d), ["variant", "model"])


@plan("m10_importances")
def _(s, d):
    rows, behaviour, identity = executions(s, d)
    out = None
    for variant, columns in (("behaviour", behaviour), ("identity", [*behaviour, *identity])):
        table, _ = sv.ready(rows, columns, "process_code", "session_id", FOLDS, KEYS)
        part = sv.importances(table, columns, trees=TREES).where("rank <= 12").withColumn("variant", F.lit(variant))
        out = part if out is None else out.unionByName(part)
    return out


# --- links between events ----------------------------------------------------------------------------------------------------


def pairs(s: SparkSession, d: str) -> DataFrame:
    return sv.pair_vectors(base.cased(s, d), "case_id", base.GAPS, F.col("event_type") == "view", F.col("event_type") == "purchase", F.col("browser_url"))


_GAPS = ", ".join(map(str, base.GAPS))
_LINK = {"same_application": "application", "same_window_title": "window_title", "same_browser_domain": "browser_domain", "same_tab_id": "browser_url", "same_event_type": "event_type", "same_chunk": "chunk_id"}
PAIR_SQL = f"""SELECT a.session_id, a.idx AS i, b.idx AS j, b.timestamp_ms - a.timestamp_ms AS apart_ms, a.case_id = b.case_id AS same, round(ln(1 + greatest(b.timestamp_ms - a.timestamp_ms, 0)), 9) AS log1p_delta_t_ms, CAST(b.idx - a.idx AS DOUBLE) AS index_gap,
  {", ".join(f"CAST(coalesce(a.{c} = b.{c}, false) AS DOUBLE) AS {n}" for n, c in _LINK.items())},
  CAST(a.browser_domain IS NOT NULL AND b.browser_domain IS NOT NULL AS DOUBLE) AS both_domains_known, CAST(a.browser_url IS NOT NULL AND b.browser_url IS NOT NULL AS DOUBLE) AS both_tabs_known,
  CAST(count(*) FILTER (c.sw) AS DOUBLE) AS n_app_switches_between, CAST(count(DISTINCT c.application) AS DOUBLE) AS n_distinct_apps_between,
  CAST(count(*) FILTER (c.event_type = 'view') > 0 AS DOUBLE) AS any_navigation_between, CAST(count(*) FILTER (c.event_type = 'purchase') > 0 AS DOUBLE) AS any_clipboard_between,
  count(*) FILTER (c.case_id IS NOT NULL AND c.case_id <> a.case_id AND c.case_id <> b.case_id) > 0 AS other_work
FROM cased a JOIN cased b ON a.session_id = b.session_id AND b.idx - a.idx IN ({_GAPS})
JOIN (SELECT *, row_number() OVER w > 1 AND lag(application) OVER w IS DISTINCT FROM application AS sw FROM cased WINDOW w AS (PARTITION BY session_id ORDER BY idx)) c ON c.session_id = a.session_id AND c.idx BETWEEN a.idx AND b.idx
WHERE a.case_id IS NOT NULL AND b.case_id IS NOT NULL GROUP BY ALL"""


@plan("m12_pair_vectors", PAIR_SQL)
def _(s, d):
    return _r(pairs(s, d), "log1p_delta_t_ms")


#: The models of the ablation by the columns that they see.
GROUPS = {"all": (*sv.DISTANCE, *sv.LINKING), "distance": sv.DISTANCE, "linking": sv.LINKING}
#: Steps in which the forests see the pause, as a logarithm.
STEPS = {"log1p_delta_t_ms": 0.125}


def _folded(s: SparkSession, d: str, strata: dict) -> DataFrame:
    """The pairs with their fold and strata: one written table."""
    return sv.written(pairs(s, d).select(sv.group_fold(F.col("session_id"), FOLDS).alias("fold"), "same", *(v.alias(k) for k, v in strata.items()), *GROUPS["all"]), "pairs")


def linked(s: SparkSession, d: str, groups: dict, strata: dict | None = None) -> DataFrame:
    """Out-of-fold scores of the pairs, (columns, model, strata, truth, score, n), by a regression (all columns; each pair) and a forest for each group of columns (cells of n pairs that it cannot tell apart)."""
    rows, keys = _folded(s, d, strata or {}), list(strata or {})
    same = sv.written(sv.alike(rows, GROUPS["all"], ["fold", "same", *keys], STEPS), "alike")
    parts = []
    for group, columns in groups.items():
        table, labels = sv.cells(same, columns, "same", keys)
        scores = sv.predictions(table, labels, {"random_forest": sv.forest(balanced=True, trees=TREES, depth=8)}, FOLDS, keys)
        parts.append(scores.select(F.lit(group).alias("columns"), "model", *keys, "truth", "score", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fits = [rg.Fit(tuple(GROUPS["all"]), k) for k in range(FOLDS)]
    known = {(r["fold"], r["same"]) for r in same.where("same IS NOT NULL").select("fold", "same").distinct().collect()}
    told = [{v for f, v in known if f != k} for k in range(FOLDS)]
    models = rg.fitted_together(rows.where("same IS NOT NULL").withColumn("_y", F.col("same").cast("double")), fits)
    score = rg.chance_by_fold(fits, models, [float(True in v) if v else None for v in told])
    each = rows.where("same IS NOT NULL").select(F.lit("all").alias("columns"), F.lit("logistic_regression").alias("model"), *keys, F.col("same").alias("truth"), score.alias("score"), F.lit(1).cast("long").alias("n"))
    return sv.written(out, "links").unionByName(each)


@plan("m12_pair_ablation")
def _(s, d):
    return sv.link_report(linked(s, d, GROUPS), ["columns", "model"])


@plan("m12_pair_models")
def _(s, d):
    time = F.when(F.col("apart_ms") < fx.HOUR, "under 1 h").when(F.col("apart_ms") < 12 * fx.HOUR, "1 to 12 h").when(F.col("apart_ms") < 48 * fx.HOUR, "12 to 48 h").otherwise("over 48 h")
    gap = F.col("j") - F.col("i")
    reach = F.when(gap <= 3, "1 to 3").when(gap <= 20, "4 to 20").when(gap <= 100, "21 to 100").otherwise("over 100")
    other = F.when(F.col("other_work"), "other work between").otherwise("no other work between")
    scored = linked(s, d, {"all": GROUPS["all"]}, {"time": time, "reach": reach, "other": other})
    strata = F.array(*(F.struct(F.lit(k).alias("by"), v.alias("stratum")) for k, v in (("overall", F.lit("all")), ("time gap", F.col("time")), ("index gap", F.col("reach")), ("between", F.col("other")))))
    each = scored.withColumn("_s", F.explode(strata)).select("model", "_s.by", "_s.stratum", "truth", "score", "n")
    return sv.link_report(each, ["model", "by", "stratum"])


@plan("m12_pair_importances")
def _(s, d):
    same = sv.alike(pairs(s, d).select(F.lit(0).alias("fold"), "same", *GROUPS["all"]), GROUPS["all"], ["fold", "same"], STEPS)
    table, _ = sv.cells(same, GROUPS["all"], "same", [])
    return sv.importances(table, GROUPS["all"], trees=TREES, depth=8, balanced=True)


# --- one model for each session that is left out -----------------------------------------------------------------------------


@plan("m04_left_out_scores")
def _(s, d):
    from worktrace.operators import learning as ln
    from worktrace.operators.left_out import left_out_scores
    from worktrace.plans import models

    rows = models.second(s, d).select("session_id", "idx", "is_boundary", *ln.SECOND)
    return left_out_scores(rows, ln.SECOND, "is_boundary", "session_id").select("session_id", "idx", "is_boundary", "score")


# --- feature sets with added evidence ------------------------------------------------------------------------------------------

LEAST_GAPS = 1000
_BASE = f"""WITH_FOLD AS (SELECT operator, log1p_delta_t_ms AS g, {_hash('session_id')} % {FOLDS} AS own FROM trans JOIN (SELECT DISTINCT session_id, operator FROM canon) USING (session_id)),
each AS (SELECT k AS fold, operator, g FROM WITH_FOLD JOIN range({FOLDS}) t(k) ON k <> own UNION ALL SELECT k, NULL, g FROM WITH_FOLD JOIN range({FOLDS}) t(k) ON k <> own),
stats AS (SELECT fold, operator, any_value(m) AS m, median(abs(g - m)) AS d, count(*) AS n FROM (SELECT *, median(g) OVER (PARTITION BY fold, operator) AS m FROM each) GROUP BY fold, operator)
SELECT CAST(s.fold AS INTEGER) AS fold, s.operator, s.n, round(CASE WHEN s.operator IS NULL OR s.n < {LEAST_GAPS} THEN a.m ELSE s.m END, 9) AS centre, round(greatest(CASE WHEN s.operator IS NULL OR s.n < {LEAST_GAPS} THEN a.d ELSE s.d END, 1e-6), 9) AS spread,
  CASE WHEN s.operator IS NULL OR s.n < {LEAST_GAPS} THEN 'all' ELSE 'operator' END AS source FROM stats s JOIN stats a ON a.fold = s.fold AND a.operator IS NULL"""


def _gaps(s: SparkSession, d: str) -> DataFrame:
    return base.trans(s, d).join(base.canon(s, d).select("session_id", "operator").distinct(), "session_id")


@plan("m08_fold_baselines")
def _(s, d):
    from worktrace.operators import feature_sets as fs

    return _r(fs.fold_baselines(_gaps(s, d), FOLDS, LEAST_GAPS), "centre", "spread")


ORACLE["m08_fold_baselines"] = sql("SELECT 1 FROM trans JOIN canon").rsplit("\nSELECT", 1)[0] + ",\n" + _BASE

#: Columns that the sets add to both detectors' own.
ADDED = {"M1": (), "M2A": ("z_log_gap",), "M2B": ("drift", "drift_known"), "M2C": ("z_log_gap", "drift", "drift_known")}


@plan("m09_feature_sets")
def _(s, d):
    """Both detectors with each set of added columns, by two protocols of thresholds, against the set without any."""
    from worktrace.operators import feature_sets as fs
    from worktrace.operators import learning as ln
    from worktrace.operators import sequence as sq
    from worktrace.plans import models

    keys = ["session_id", "idx"]
    words = sq.drift(base.canon(s, d), 10, ("session_id",), "idx", "window_title").select(*keys, F.coalesce("drift", F.lit(0.0)).alias("drift"), F.col("available").cast("double").alias("drift_known"))
    second = models.second(s, d).select(*keys, *(F.col(c).alias(f"second_{c}") for c in ln.SECOND))
    rows = base.labelled(s, d).join(base.canon(s, d).select("session_id", "operator").distinct(), "session_id").join(words, keys).join(second, keys)
    rows = sv.written(rows, "labelled")
    table = fs.with_fold_z(rows, fs.fold_baselines(rows, FOLDS, LEAST_GAPS), FOLDS)
    z = {"z_log_gap": [f"z_log_gap_{k}" for k in range(FOLDS)]}
    first = fs.set_scores(table, {n: (*ln.FIRST, *more) for n, more in ADDED.items()}, "is_boundary", keys, FOLDS, z)
    other = fs.set_scores(table, {n: (*(f"second_{c}" for c in ln.SECOND), *more) for n, more in ADDED.items()}, "is_boundary", keys, FOLDS, z)
    return fs.compared_sets(first, other, keys, "M1", (0.6, 0.6), 0.02)


# --- density clusters of executions ------------------------------------------------------------------------------------------

#: Radii in deviations of the standardised columns, and least neighbourhoods.
RADII, NEIGHBOURS = [1.0, 2.0, 3.0], [5, 10, 15, 20]


def _work(columns: list[str]) -> list[str]:
    """Columns of how an execution is worked that do not name places: lengths as logarithms."""
    return [c for c in columns if c not in ("duration_ms", "n_events", "per_second")]


def _density(s: SparkSession, d: str, clusters: bool = True) -> DataFrame:
    """Both sets of vectors by all settings: behaviour alone, and with the applications and domains (which give the process away)."""
    rows, behaviour, identity = executions(s, d)
    rows = written(rows, "executions")
    sets = {"behaviour": _work(behaviour), "with_identity": _work(behaviour) + identity}
    parts = [dn.density_clusters(dn.standard_vectors(rows, columns, ["case_id"]), "case_id", RADII, NEIGHBOURS, parts=clusters).select(F.lit(name).alias("vectors"), "*") for name, columns in sets.items()]
    return parts[0].unionAll(parts[1]).join(rows.select("case_id", "process_code"), "case_id")


def _near(columns: list[str]) -> str:
    """Rows within each radius of each row, in SQL, over the table v of vectors."""
    far = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in columns)
    scaled = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS {c}" for c in columns)
    return f"SELECT a.case_id, b.case_id AS other, sqrt({far}) AS away FROM (SELECT case_id, {scaled} FROM v) a, (SELECT case_id, {scaled} FROM v) b WHERE {far} <= {max(RADII) ** 2}"


_BEHAVIOUR = (
    [f"cat_{v}" for v in fx.CATEGORIES.values()] + ["n_categories"] + [f"type_{v}" for v in fx.CATEGORIES]
    + ["n_types", "manual_share", "text_share", "n_applications", "n_switches", "n_titles", "log1p_duration"]
)
_IDENTITY = [f"app_app{v}" for v in range(4)] + [f"domain_127_0_0_1_{v}" for v in (5130, 5131, 5132)]


def _kinds(name: str, columns: list[str]) -> str:
    settings = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({r} AS DOUBLE), {m})" for r in RADII for m in NEIGHBOURS) + ") t(radius, least)"
    return f"""SELECT '{name}' AS vectors, case_id, radius, least, n_near, CASE WHEN n_near >= least THEN 'core' WHEN beside THEN 'border' ELSE 'noise' END AS kind FROM (
  SELECT p.radius, g.least, p.case_id, any_value(c.n_near) AS n_near, bool_or(o.n_near >= g.least) AS beside
  FROM (SELECT r.radius, w.case_id, w.other FROM near_{name} w JOIN (SELECT DISTINCT radius FROM ({settings})) r ON w.away <= r.radius) p
  JOIN count_{name} c ON c.radius = p.radius AND c.case_id = p.case_id JOIN count_{name} o ON o.radius = p.radius AND o.case_id = p.other JOIN ({settings}) g ON g.radius = p.radius GROUP BY ALL)"""


def _counts(name: str) -> str:
    return f"count_{name} AS (SELECT radius, case_id, count(*) AS n_near FROM near_{name}, (SELECT unnest({RADII}) AS radius) WHERE away <= radius GROUP BY ALL)"


@plan("m13_density_points", f"SELECT * FROM (WITH v AS ({VECTORS}), near_behaviour AS ({_near(_BEHAVIOUR)}), near_with_identity AS ({_near(_BEHAVIOUR + _IDENTITY)}), {_counts('behaviour')}, {_counts('with_identity')} {_kinds('behaviour', _BEHAVIOUR)} UNION ALL {_kinds('with_identity', _BEHAVIOUR + _IDENTITY)})")
def _(s, d):
    return _density(s, d, clusters=False).select("vectors", "case_id", "radius", "least", "n_near", "kind")


@plan("m13_density_report")
def _(s, d):
    return _r(dn.density_report(_density(s, d), ["vectors", "radius", "least"], "cluster", "process_code"), "ari", "nmi", "noise_share")
