"""How well signals, conditions on single events, tell where work changes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.operators.joins import nearest


def _part(n: Column, of: Column) -> Column:
    return F.try_divide(n, of)


def evaluated(events: DataFrame, points: DataFrame, signals: Mapping[str, Column], window_ms: int) -> DataFrame:
    """A row per signal: coverage of the points (all, resumed, others), precision, distances, rates near points and elsewhere with their
    lift, and the spread of coverage over sessions.

    events: session_id, timestamp_ms and what the signals need; points: session_id, at_ms, is_resume. A point is covered if the signal occurs
    within ``window_ms`` of it, an event is aligned if a point is. Ratios of nothing are null, but coverage and precision 0 and missed 1.
    All signals share one sort of the events for the nearest point and one by signal for the nearest signal; the median is
    one task a signal over distinct distances.
    """
    held = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in signals.items())), lambda x: x.isNotNull())
    slim = events.select("session_id", "timestamp_ms", held.alias("held"))
    names = F.array(*map(F.lit, signals))

    keyed = points.select("session_id", "at_ms", "is_resume", F.explode(names).alias("signal"))
    keyed = keyed.select(F.struct("session_id", "signal").alias("session_id"), "at_ms", "is_resume")
    fired = slim.select("session_id", "timestamp_ms", F.explode("held").alias("signal")).select(F.struct("session_id", "signal").alias("session_id"), "timestamp_ms")
    hit = F.coalesce(F.col("distance_ms") <= window_ms, F.lit(False))
    points_hit = nearest(keyed, fired, "at_ms", "timestamp_ms").select("session_id.signal", F.col("session_id.session_id").alias("session_id"), "is_resume", hit.alias("hit"))
    by_session = points_hit.groupBy("signal", "session_id").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if("is_resume").alias("resumed"), F.count_if(F.col("hit") & F.col("is_resume")).alias("resumed_hits")
    )
    n, hits, resumed, resumed_hits = (F.sum(c) for c in ("n", "hits", "resumed", "resumed_hits"))
    share = F.col("hits") / F.col("n")
    covered = by_session.groupBy("signal").agg(
        F.count("*").alias("n_sessions_with_points"), n.alias("n_points"), resumed.alias("n_resumed"), _part(hits, n).alias("coverage"), (1 - _part(hits, n)).alias("missed"),
        _part(resumed_hits, resumed).alias("resumed_coverage"), _part(hits - resumed_hits, n - resumed).alias("normal_coverage"),
        F.avg(share).alias("session_coverage_mean"), F.stddev_pop(share).alias("session_coverage_std"), F.min(share).alias("session_coverage_min"), F.max(share).alias("session_coverage_max"),
    )

    near = nearest(slim, points.select("session_id", "at_ms"), "timestamp_ms", "at_ms").select("held", "distance_ms", hit.alias("near"))
    # counts of events by the set of signals that they hold: few rows, whatever the number of events
    sums = near.groupBy("held", "near").agg(F.count("*").alias("n"), F.sum("distance_ms").alias("ms"))
    each = sums.select("held", "near", "n", "ms", F.explode(names).alias("signal")).withColumn("has", F.array_contains("held", F.col("signal")))
    some = lambda *c: F.coalesce(F.sum(F.when(c[0] if len(c) == 1 else c[0] & c[1], F.col("n"))), F.lit(0))
    has, by = F.col("has"), F.col("near")
    rates = each.groupBy("signal").agg(
        F.sum("n").alias("n_events"), some(has).alias("n_signal_events"), some(has, by).alias("n_aligned"), some(has, ~by).alias("n_unaligned"),
        F.coalesce(_part(some(has, by), some(has)), F.lit(0.0)).alias("precision"), _part(F.sum(F.when(has & by, F.col("ms"))), some(has, by)).alias("distance_mean"),
        F.coalesce(_part(some(has, by), some(by)), F.lit(0.0)).alias("near_rate"), F.coalesce(_part(some(has, ~by), some(~by)), F.lit(0.0)).alias("interior_rate"),
    )
    rates = rates.withColumn("lift", F.when(F.col("interior_rate") > 0, F.col("near_rate") / F.col("interior_rate")))
    middle = near.where("near").select("distance_ms", F.explode("held").alias("signal")).groupBy("signal").agg(F.median("distance_ms").alias("distance_median"))
    out = rates.join(middle, "signal", "left").join(covered, "signal", "left")
    return out.na.fill({"n_sessions_with_points": 0, "n_points": 0, "n_resumed": 0, "coverage": 0.0, "missed": 1.0, "session_coverage_mean": 0.0, "session_coverage_std": 0.0, "session_coverage_min": 0.0, "session_coverage_max": 0.0})
