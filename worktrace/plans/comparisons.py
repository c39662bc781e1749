"""Plans that compare populations: what the continuity rule removes rightly and wrongly, protection, clusters of flags, pairs in strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace import fixtures as fx
from worktrace.operators import boundary as b
from worktrace.operators import evaluation as ev
from worktrace.operators import joins as jn
from worktrace.operators import sequence as sq
from worktrace.operators import supervised as sv
from worktrace.operators.tables import written
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


def _r(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


FLAGS = ("application_changed", "window_title_changed", "browser_domain_changed", "interaction_category_changed", "extracted_text_at_transition", "chunk_boundary")
NUMBERS = ("types_jaccard", "apps_jaccard", "domains_jaccard", "delta_t_ms", "log1p_delta_t_ms", "density_before", "density_after", "duration_before", "duration_after")

#: Removed by the continuity rule: A rightly, B although it was a boundary.
REMOVED = f"SELECT l.*, CASE WHEN l.is_boundary THEN 'B' ELSE 'A' END AS population FROM ({base.FINAL}) f JOIN labelled l USING (session_id, idx) WHERE f.rule = 'rule_4_continuity' AND NOT f.final"
LONG = f"SELECT population, is_boundary, unnest([{', '.join(repr(x) for x in NUMBERS + FLAGS)}]) AS signal, unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in NUMBERS + FLAGS)}]) AS v FROM ({REMOVED}) JOIN (SELECT * EXCLUDE (text_before, text_after) FROM traj) USING (session_id, idx)"


def judged(s: SparkSession, d: str) -> DataFrame:
    """Cuts by the ordered rules, with the truth."""
    return b.reconstruct(base.evidence(s, d), 0.6).join(base.labelled(s, d).select("session_id", "idx", "is_boundary"), ["session_id", "idx"])


def removed(s: SparkSession, d: str) -> DataFrame:
    rule = b.reconstruct(base.evidence(s, d), 0.6).where("rule = 'rule_4_continuity' AND NOT final").select("session_id", "idx")
    return base.labelled(s, d).join(rule, ["session_id", "idx"]).withColumn("population", F.when(F.col("is_boundary"), "B").otherwise("A"))


def removed_signals(s: SparkSession, d: str) -> DataFrame:
    ways = sq.trajectories(sq.windows(base.canon(s, d), 5)).drop("text_before", "text_after")
    return ev.unpivoted(removed(s, d).join(ways, ["session_id", "idx"]), ["population", "is_boundary"], NUMBERS + FLAGS)


RANKS = "n, round(mean, 3) AS mean, median, round(deviation, 3) AS deviation, low, high, " + ", ".join(f"l[CAST(least(floor(n * {p}), n - 1) AS BIGINT) + 1] AS p{round(100 * p)}" for p in (0.25, 0.75, 0.9))
FIGURES = "count(v) AS n, avg(v) AS mean, median(v) AS median, stddev_pop(v) AS deviation, min(v) AS low, max(v) AS high, list_sort(list(v) FILTER (v IS NOT NULL)) AS l"


@plan("v19_signals", f"SELECT population, signal, {RANKS.replace('median,', 'round(median, 9) AS median,')} FROM (SELECT population, signal, {FIGURES} FROM ({LONG}) WHERE v IS NOT NULL GROUP BY ALL)")
def _(s, d):
    return _r(_r(ev.nearest_rank(removed_signals(s, d), "v", (0.25, 0.75, 0.9), ["population", "signal"]), 3, "mean", "deviation"), 9, "median")


@plan("v19_aucs", f"""SELECT signal, n_pos, n_neg, round(auc, 9) AS auc, coalesce(abs(auc - 0.5) >= 0.1, false) AS separates FROM (
  SELECT signal, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, CASE WHEN count(*) > 1 THEN sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) END AS auc FROM (
    SELECT *, coalesce(sum(neg) OVER (PARTITION BY signal ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
      SELECT signal, v, count(*) FILTER (is_boundary) AS pos, count(*) FILTER (NOT is_boundary) AS neg FROM ({LONG}) WHERE v IS NOT NULL GROUP BY 1, 2)) GROUP BY 1)""")
def _(s, d):
    out = ev.auc(removed_signals(s, d), "v", "is_boundary", ["signal"])
    return out.select("signal", "n_pos", "n_neg", F.round("auc", 9).alias("auc"), F.coalesce(F.abs(F.col("auc") - 0.5) >= 0.1, F.lit(False)).alias("separates"))


SOURCE = "CASE WHEN application_changed OR browser_domain_changed THEN 'both' ELSE 'v1_only' END"


def source() -> Column:
    """Every candidate has the long pause; the other detector is a change of context."""
    return F.when(b.context(), "both").otherwise("v1_only")


@plan("v19_sources", f"SELECT population, source, n, round(n / sum(n) OVER (PARTITION BY population), 9) AS rate FROM (SELECT population, {SOURCE} AS source, count(*) AS n FROM ({REMOVED}) GROUP BY ALL)")
def _(s, d):
    return _r(ev.rates(removed(s, d).withColumn("source", source()), ["population"], ["source"]), 9, "rate")


TOP = "SELECT t.population, side, value, n, place, round(n / total, 9) AS rate FROM (SELECT population, side, value, count(*) AS n, row_number() OVER (PARTITION BY population, side ORDER BY count(*) DESC, value) AS place FROM ({}) WHERE value IS NOT NULL GROUP BY population, side, value) t JOIN (SELECT population, count(*) AS total FROM ({}) GROUP BY 1) w ON w.population = t.population WHERE place <= 15"


@plan("v19_neighbours", TOP.format(f"SELECT population, unnest(['before', 'after']) AS side, unnest([x.event_type, y.event_type]) AS value FROM ({REMOVED}) r JOIN canon x ON x.session_id = r.session_id AND x.idx = r.idx JOIN canon y ON y.session_id = r.session_id AND y.idx = r.idx + 1", REMOVED))
def _(s, d):
    pop = removed(s, d)
    kinds = base.canon(s, d).select("session_id", "idx", F.col("event_type").alias("before"), F.lead("event_type").over(sq.ordered()).alias("after"))
    sides = F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(x).alias("value")) for x in ("before", "after"))))
    each = pop.join(kinds, ["session_id", "idx"]).withColumn("_x", sides).select("population", "_x.side", "_x.value")
    return _r(ev.most_common(each, ["population", "side"], "value", pop, "population"), 9, "rate")


WINDOWED = {"types_before": "tb", "types_after": "ta", "apps_before": "ab", "apps_after": "aa"}


@plan("v19_composition", TOP.format(" UNION ALL ".join(f"SELECT population, '{k}' AS side, unnest({c}) AS value FROM ({REMOVED}) JOIN win USING (session_id, idx)" for k, c in WINDOWED.items()), REMOVED))
def _(s, d):
    pop = removed(s, d)
    around = sq.windows(base.canon(s, d), 5).select("session_id", "idx", *WINDOWED)
    sides = F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(x).alias("values")) for x in WINDOWED)))
    each = pop.join(around, ["session_id", "idx"]).withColumn("_x", sides).select("population", "_x.side", F.explode("_x.values").alias("value"))
    return _r(ev.most_common(each, ["population", "side"], "value", pop, "population"), 9, "rate")


@plan("v19_gap_tiers", f"SELECT tier, {RANKS} FROM (SELECT tier, {FIGURES} FROM (SELECT 'all_boundaries' AS tier, delta_t_ms AS v FROM labelled WHERE is_boundary UNION ALL SELECT population, delta_t_ms FROM ({REMOVED})) GROUP BY 1)")
def _(s, d):
    every = base.labelled(s, d).where("is_boundary").select(F.lit("all_boundaries").alias("tier"), F.col("delta_t_ms").alias("v"))
    tiers = every.unionByName(removed(s, d).select(F.col("population").alias("tier"), F.col("delta_t_ms").alias("v")))
    return _r(ev.nearest_rank(tiers, "v", (0.25, 0.75, 0.9), ["tier"]), 3, "mean", "deviation")


@plan("v19_concentration", f"SELECT population, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_groups, round(max(c) / sum(c), 9) AS largest_share, round(sum(c) FILTER (place <= 3) / sum(c), 9) AS top_share, round(sum(c * c) / (sum(c) * sum(c)), 9) AS herfindahl FROM (SELECT population, session_id, count(*) AS c, row_number() OVER (PARTITION BY population ORDER BY count(*) DESC, session_id) AS place FROM ({REMOVED}) GROUP BY population, session_id) GROUP BY 1")
def _(s, d):
    return _r(ev.concentration(removed(s, d), "population", "session_id"), 9, "largest_share", "top_share", "herfindahl")


@plan("v18_protected_by_source", f"SELECT {SOURCE} AS source, count(*) AS n_protected, count(*) FILTER (is_boundary) AS n_true, count(*) FILTER (NOT is_boundary) AS n_false, round(count(*) FILTER (NOT is_boundary) / nullif(count(*) FILTER (is_boundary), 0), 9) AS false_to_true FROM ({REMOVED}) WHERE application_changed AND density_before >= 2 GROUP BY 1")
def _(s, d):
    kept = b.protect(b.reconstruct(base.evidence(s, d), 0.6), "combined", F.col("density_before"), 2, F.col("application_changed")).where(F.col("rule") == b.PROTECTED)
    known = base.labelled(s, d).join(kept.select("session_id", "idx"), ["session_id", "idx"])
    out = known.groupBy(source().alias("source")).agg(F.count("*").alias("n_protected"), F.count_if("is_boundary").alias("n_true"), F.count_if(F.expr("NOT is_boundary")).alias("n_false"))
    return out.withColumn("false_to_true", F.round(F.try_divide("n_false", "n_true"), 9))


TEMPOS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16)


@plan("v22_protection_sweep", "SELECT tau, rule, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (SELECT *, " + processes.PRF + " FROM (" + " UNION ALL ".join(f"SELECT CAST(tau AS BIGINT) AS tau, '{n}' AS rule, count(*) FILTER (is_boundary AND {x}) AS tp, count(*) FILTER (NOT is_boundary AND {x}) AS fp, count(*) FILTER (is_boundary AND NOT {x}) AS fn FROM ({base.FINAL}) f JOIN (SELECT session_id, idx, is_boundary FROM labelled) USING (session_id, idx), (SELECT unnest({list(TEMPOS)}) AS tau) GROUP BY 1" for n, x in (("tempo", "(final OR (rule = 'rule_4_continuity' AND density_before >= tau))"), ("combined", "(final OR (rule = 'rule_4_continuity' AND density_before >= tau AND application_changed))"))) + "))")
def _(s, d):
    """Metrics of the cuts when those that the continuity rule removed come back from a tempo on: every tempo in one pass."""
    back = lambda t: F.col("final") | ((F.col("rule") == b.CONTINUITY) & (F.col("density_before") >= t))
    both = lambda t: F.col("final") | (back(t) & F.col("application_changed"))
    return _r(ev.swept_metrics(judged(s, d), "is_boundary", {(t, n): f(t) for t in TEMPOS for n, f in (("tempo", back), ("combined", both))}), 9, "precision", "recall", "f1")


@plan("v21_cluster_comparison", f"""SELECT kind, {RANKS} FROM (SELECT kind, {FIGURES} FROM (
  SELECT CASE WHEN is_boundary THEN 'boundary' WHEN EXISTS (SELECT 1 FROM gt g WHERE g.session_id = c.session_id AND g.start_ms <= l.timestamp_ms AND l.next_timestamp_ms <= g.end_ms) THEN 'internal' ELSE 'outside' END AS kind, cluster_size AS v
  FROM (SELECT session_id, idx, count(*) OVER (PARTITION BY session_id, g) AS cluster_size, application_changed FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY session_id ORDER BY idx) AS g FROM (SELECT session_id, idx, application_changed, application_changed IS DISTINCT FROM lag(application_changed) OVER (PARTITION BY session_id ORDER BY idx) AS new FROM trans))) c
  JOIN labelled l USING (session_id, idx) WHERE c.application_changed) GROUP BY 1)""")
def _(s, d):
    """Sizes of the clusters that a change of application is in: at boundaries, inside executions and outside."""
    sized = sq.cluster_sizes(base.labelled(s, d), "application_changed").where("application_changed")
    inner = jn.inside(base.trans(s, d), fx.ground_truth(s, d)).select("session_id", "idx").distinct().withColumn("inner", F.lit(True))
    kind = F.when(F.col("is_boundary"), "boundary").when(F.col("inner"), "internal").otherwise("outside")
    rows = sized.join(inner, ["session_id", "idx"], "left").select(kind.alias("kind"), F.col("cluster_size").cast("long").alias("v"))
    return _r(ev.nearest_rank(rows, "v", (0.25, 0.75, 0.9), ["kind"]), 3, "mean", "deviation")


#: Bounds of the strata: hours for the pause (the reference's are seconds, of denser logs), places for the distance.
STRATA = {"time": ("apart", (("under_6h", 6 * fx.HOUR), ("6h_to_24h", 24 * fx.HOUR), ("24h_to_120h", 120 * fx.HOUR), ("over_120h", None))), "distance": ("gap", (("1_to_3", 4), ("4_to_20", 21), ("21_to_100", 101), ("over_100", None)))}


def _case(column: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {column} < {top} THEN '{name}'" for name, top in bounds if top) + f" ELSE '{bounds[-1][0]}' END"


PAIRED = f"SELECT p.*, y.timestamp_ms - x.timestamp_ms AS apart, CASE WHEN n_cases > CASE WHEN same THEN 1 ELSE 2 END THEN 'other_work' ELSE 'no_other_work' END AS between FROM ({base.EVERY}) p JOIN canon x ON x.session_id = p.session_id AND x.idx = p.i JOIN canon y ON y.session_id = p.session_id AND y.idx = p.j JOIN (SELECT p.session_id, i, j, count(DISTINCT c.case_id) AS n_cases FROM ({base.EVERY}) p JOIN cased c ON c.session_id = p.session_id AND c.idx BETWEEN i AND j GROUP BY ALL) k ON k.session_id = p.session_id AND k.i = p.i AND k.j = p.j"
EACH = f"SELECT same, -apart AS v, apart <= 86400000 AS predicted, unnest(['all', 'time', 'distance', 'between']) AS axis, unnest(['', {_case(*STRATA['time'])}, {_case(*STRATA['distance'])}, \"between\"]) AS stratum FROM ({PAIRED})"


@plan("v23_strata", f"""SELECT axis, stratum, n, n_same, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, round(auc, 9) AS auc, round(ap, 9) AS average_precision, n < 50 OR n_same = 0 OR n_same = n AS few
FROM (SELECT *, {processes.PRF} FROM (SELECT axis, stratum, count(*) AS n, count(*) FILTER (same) AS n_same, count(*) FILTER (same AND predicted) AS tp, count(*) FILTER (NOT same AND predicted) AS fp, count(*) FILTER (same AND NOT predicted) AS fn FROM ({EACH}) GROUP BY ALL))
JOIN (SELECT axis, stratum, CASE WHEN count(*) > 1 THEN sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) END AS auc, sum(pos * tps / (tps + fps)) / nullif(sum(pos), 0) AS ap FROM (
  SELECT *, coalesce(sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (x ROWS UNBOUNDED PRECEDING) AS tps, sum(neg) OVER (x ROWS UNBOUNDED PRECEDING) AS fps
  FROM (SELECT axis, stratum, v, count(*) FILTER (same) AS pos, count(*) FILTER (NOT same) AS neg FROM ({EACH}) GROUP BY ALL) WINDOW w AS (PARTITION BY axis, stratum ORDER BY v), x AS (PARTITION BY axis, stratum ORDER BY v DESC)) GROUP BY ALL) USING (axis, stratum)""")
def _(s, d):
    """Pairs at all gaps by pause, distance and other work between: metrics of "at most a day apart" and of nearness as a score."""
    made = sv.pair_vectors(base.cased(s, d), "case_id", base.GAPS, F.col("event_type") == "view", F.col("event_type") == "purchase", F.col("browser_url"))
    known = made.select("same", F.col("apart_ms").alias("apart"), (F.col("j") - F.col("i")).alias("gap"), F.when(F.col("other_work"), "other_work").otherwise("no_other_work").alias("other"))

    def level(column: str, bounds) -> Column:
        return reduce(lambda c, x: F.when(F.col(column) < x[1], x[0]).otherwise(c), reversed(bounds[:-1]), F.lit(bounds[-1][0]))

    axes = {"all": F.lit(""), "time": level(*STRATA["time"]), "distance": level(*STRATA["distance"]), "between": F.col("other")}
    spread = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), c.alias("stratum")) for a, c in axes.items())))
    keys = ["axis", "stratum"]
    each = known.withColumn("_x", spread).groupBy("_x.axis", "_x.stratum", (-F.col("apart")).alias("v")).agg(F.count_if("same").alias("pos"), F.count_if(~F.col("same")).alias("neg"))
    each = written(each, "values")
    near, n_of = F.col("v") >= -24 * fx.HOUR, lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    n = each.groupBy(*keys).agg(n_of("pos").alias("n_same"), n_of("neg").alias("n_other"), n_of("pos", near).alias("tp"), n_of("neg", near).alias("fp"), n_of("pos", ~near).alias("fn"), F.count("*").alias("k"))
    n = written(n.withColumn("n", F.col("n_same") + F.col("n_other")), "strata")
    # what is not below a value is at it or above, so one order gives both curves
    placed = ev.running_sums(each, keys, "v", {"pos_below": "pos", "neg_below": "neg"}, own=False).join(F.broadcast(n.select(*keys, "n_same", "n")), keys)
    wins, part = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.sum(F.col("pos") * (F.col("n_same") - F.col("pos_below")) / (F.col("n") - F.col("pos_below") - F.col("neg_below")))
    curves = placed.groupBy(*keys).agg(wins.alias("wins"), part.alias("part"))
    out = n.withColumns(ev._prf(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("few", F.expr("n < 50 OR n_same = 0 OR n_same = n")).join(curves, keys)
    out = out.withColumns({"auc": F.when(F.col("k") > 1, F.try_divide("wins", F.col("n_same") * F.col("n_other"))), "average_precision": F.try_divide("part", "n_same")}).drop("k", "n_other", "wins", "part")
    return _r(out, 9, "precision", "recall", "f1", "auc", "average_precision")
