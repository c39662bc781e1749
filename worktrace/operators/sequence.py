"""Window and sequence operators over events ordered by ``idx`` within ``session_id``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from worktrace.functions import scalar

SESSION = ("session_id",)


def ordered(*keys: str, by: str = "idx") -> WindowSpec:
    return Window.partitionBy(*(keys or SESSION)).orderBy(by)


def transitions(events: DataFrame, window_ms: int) -> DataFrame:
    """One row per pair of neighbouring events, named by the first one's idx: gap, densities before and after within
    window_ms, and null-safe changes. One exchange; the range frames need one more sort by time."""
    w = ordered()
    near = Window.partitionBy(*SESSION).orderBy("timestamp_ms")
    counted = events.withColumns(
        {
            "density_before": F.count("*").over(near.rangeBetween(-(window_ms - 1), 0)),
            "ahead": F.count("*").over(near.rangeBetween(0, window_ms - 1)),
        }
    )
    nxt = lambda c: F.lead(c).over(w)
    changed = lambda c: ~F.col(c).eqNullSafe(nxt(c))
    gap = nxt("timestamp_ms") - F.col("timestamp_ms")
    return (
        counted.select(
            "session_id",
            "idx",
            F.col("event_id").alias("event_i_id"),
            nxt("event_id").alias("event_next_id"),
            "timestamp_ms",
            nxt("timestamp_ms").alias("next_timestamp_ms"),
            gap.alias("delta_t_ms"),
            scalar.log1p_gap(gap).alias("log1p_delta_t_ms"),
            "density_before",
            nxt("ahead").alias("density_after"),
            changed("application").alias("application_changed"),
            changed("window_title").alias("window_title_changed"),
            changed("browser_domain").alias("browser_domain_changed"),
            changed("interaction_category").alias("interaction_category_changed"),
            (F.col("has_extracted_text") | nxt("has_extracted_text")).alias("extracted_text_at_transition"),
            changed("chunk_id").alias("chunk_boundary"),
        )
        .where("event_next_id IS NOT NULL")
    )


def fill_forward(events: DataFrame, column: str, out: str, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Nulls take the value before them; leading nulls stay."""
    w = ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(out, F.last(column, ignorenulls=True).over(w))


def with_runs(events: DataFrame, column: Column, out: str = "run_no", keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Number, from 0, of the run of equal values that a row is in."""
    w = ordered(*keys)
    marked = events.withColumn("_new", (F.row_number().over(w) > 1) & ~F.lag(column).over(w).eqNullSafe(column))
    return marked.withColumn(out, F.sum(F.col("_new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(events: DataFrame, column: str, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Run-length encoding: (keys, run_no, value, start_idx, end_idx, length)."""
    return with_runs(events, F.col(column), keys=keys).groupBy(*keys, "run_no").agg(
        F.min(column).alias("value"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("length")
    )


def return_patterns(run_rows: DataFrame, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Returns A, ..., A against the most recent departure from A; null values take no part. Immediate: one run between."""
    w = Window.partitionBy(*keys, "value").orderBy("run_no")
    out = run_rows.where("value IS NOT NULL").withColumns({"left_run": F.lag("run_no").over(w), "left_end_idx": F.lag("end_idx").over(w)})
    return out.where("left_run IS NOT NULL").select(
        *keys,
        "value",
        "left_run",
        F.col("run_no").alias("returned_run"),
        "left_end_idx",
        F.col("start_idx").alias("return_start_idx"),
        (F.col("run_no") - F.col("left_run") == 2).alias("is_immediate"),
        (F.col("start_idx") - F.col("left_end_idx") - 1).alias("away_events"),
    )


def drop_consecutive(events: DataFrame, event_type: str, key: Column) -> DataFrame:
    """Without events of the type that directly follow an event of that type with the same key."""
    return with_duplicate_flag(events, event_type, key).where("NOT is_duplicate").drop("is_duplicate")


def with_duplicate_flag(events: DataFrame, event_type: str, key: Column) -> DataFrame:
    w = ordered()
    same = (F.col("event_type") == event_type) & (F.lag("event_type").over(w) == event_type) & F.lag(key).over(w).eqNullSafe(key)
    return events.withColumn("is_duplicate", F.coalesce(same, F.lit(False)))


def duplicate_noise(events: DataFrame, event_type: str, key: Column) -> DataFrame:
    """Per transition: whether either end is such a duplicate."""
    flagged = with_duplicate_flag(events, event_type, key)
    after = F.lead("is_duplicate").over(ordered())
    return flagged.select("session_id", "idx", "is_duplicate", after.alias("after")).where("after IS NOT NULL").select("session_id", "idx", (F.col("is_duplicate") | F.col("after")).alias("duplicate_noise"))


SETS = {"apps": "application", "types": "event_type", "categories": "interaction_category", "domains": "browser_domain", "titles": "window_title"}


def windows(events: DataFrame, n: int) -> DataFrame:
    """Per transition: sets, durations and text of the n events up to it and the n events after it."""
    w = ordered()
    before, ahead = w.rowsBetween(-(n - 1), 0), w.rowsBetween(0, n - 1)
    cols = {}
    for name, column in SETS.items():
        cols[f"{name}_before"] = F.array_sort(F.collect_set(column).over(before))
        cols[f"{name}_ahead"] = F.array_sort(F.collect_set(column).over(ahead))
    cols |= {
        "duration_before": F.col("timestamp_ms") - F.first("timestamp_ms").over(before),
        "duration_ahead": F.last("timestamp_ms").over(ahead) - F.col("timestamp_ms"),
        "text_before": F.max("has_extracted_text").over(before),
        "text_ahead": F.max("has_extracted_text").over(ahead),
        "n_before": F.count("*").over(before),
        "n_ahead": F.count("*").over(ahead),
    }
    wide = events.select("session_id", "idx", *(c.alias(name) for name, c in cols.items()))
    after = [F.lead(name).over(w).alias(name.replace("_ahead", "_after")) for name in cols if name.endswith("_ahead")]
    return wide.select("session_id", "idx", *(c for c in cols if c.endswith("_before")), *after).where("n_after IS NOT NULL")


def trajectories(window_rows: DataFrame) -> DataFrame:
    """Jaccards of the sets before and after each transition."""
    return window_rows.select(
        "session_id",
        "idx",
        *(scalar.jaccard(F.col(f"{s}_before"), F.col(f"{s}_after")).alias(f"{s}_jaccard") for s in SETS),
        "duration_before",
        "duration_after",
        "text_before",
        "text_after",
    )


def drift(texts: DataFrame, n: int, keys: tuple[str, ...], by: str, text: str) -> DataFrame:
    """Content drift of the words of n texts up to each row and the n after it."""
    w = Window.partitionBy(*keys).orderBy(by)
    words = texts.withColumn("_w", scalar.tokens(F.coalesce(F.col(text), F.lit(""))))
    union = lambda frame: F.array_distinct(F.flatten(F.collect_list("_w").over(frame)))
    wide = words.select(*keys, by, union(w.rowsBetween(-(n - 1), 0)).alias("a"), union(w.rowsBetween(0, n - 1)).alias("ahead"))
    wide = wide.withColumn("b", F.lead("ahead").over(w)).where("b IS NOT NULL")
    return wide.select(*keys, by, scalar.content_drift(F.col("a"), F.col("b")).alias("d")).select(*keys, by, "d.drift", "d.available")


def cluster_sizes(flags: DataFrame, flag: str) -> DataFrame:
    """Length of the run of true flags that a transition is in; 0 when its flag is false."""
    marked = with_runs(flags, F.col(flag))
    size = F.count("*").over(Window.partitionBy(*SESSION, "run_no"))
    return marked.withColumn("cluster_size", F.when(F.col(flag), size).otherwise(0)).drop("run_no")


def return_edges(events: DataFrame, column: str, reach: int) -> DataFrame:
    """Leave and return edges of each transition for one value column: (session_id, idx, is_leave, is_return, pair).

    A transition leaves a value that comes back within ``reach`` events, or arrives at one that was there within them; its pair is the other
    edge's transition. No arrays: the next and previous place of the same value, and of any value, are window lookups."""
    known = events.where(F.col(column).isNotNull())
    w, same = ordered(), ordered("session_id", column)
    known = known.select(
        "session_id",
        "idx",
        F.lead("idx").over(same).alias("next_same"),
        F.lag("idx").over(same).alias("prev_same"),
        (F.lead(column).over(w) != F.col(column)).alias("next_differs"),
        (F.lag(column).over(w) != F.col(column)).alias("prev_differs"),
    )
    leave = known.where(F.col("next_differs") & (F.col("next_same") <= F.col("idx") + reach)).select("session_id", "idx", (F.col("next_same") - 1).alias("leave_pair"))
    back = known.where(F.col("prev_differs") & (F.col("prev_same") >= F.col("idx") - reach)).select("session_id", (F.col("idx") - 1).alias("idx"), F.col("prev_same").alias("return_pair"))
    return leave.join(back, ["session_id", "idx"], "full").select(
        "session_id",
        "idx",
        F.col("leave_pair").isNotNull().alias("is_leave"),
        F.col("return_pair").isNotNull().alias("is_return"),
        F.coalesce("return_pair", "leave_pair").alias("pair"),
    )


def demoted_edges(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Both edges of each pattern that touches a candidate transition: (session_id, idx)."""
    touched = edges.join(candidates, ["session_id", "idx"], "left_semi")
    return touched.select("session_id", F.explode(F.array("idx", "pair")).alias("idx")).distinct()


def segments(events: DataFrame, cuts: DataFrame, flag: str = "boundary") -> DataFrame:
    """Events with ``seg_no``: the number of cuts before them. cuts: (session_id, idx, flag) per transition."""
    w = ordered()
    joined = events.join(cuts.select("session_id", "idx", F.col(flag).alias("_cut")), ["session_id", "idx"], "left")
    before = F.coalesce(F.lag("_cut").over(w), F.lit(False)).cast("long")
    return joined.withColumn("_step", before).withColumn("seg_no", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut", "_step")


def surrounding(events: DataFrame, spans: DataFrame) -> DataFrame:
    """The nearest event strictly before and strictly after each span (session_id, span_id, start_ms, end_ms), by one sort of the union."""
    e = events.select("session_id", F.col("timestamp_ms").alias("t"), F.lit(1).alias("kind"), F.struct("timestamp_ms", "event_id").alias("e"), F.lit(None).cast("string").alias("span_id"))
    none = F.lit(None).cast(e.schema["e"].dataType)
    starts = spans.select("session_id", F.col("start_ms").alias("t"), F.lit(0).alias("kind"), none.alias("e"), "span_id")
    ends = spans.select("session_id", F.col("end_ms").alias("t"), F.lit(2).alias("kind"), none.alias("e"), "span_id")
    back = Window.partitionBy("session_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("session_id").orderBy("t", "kind").rowsBetween(0, Window.unboundedFollowing)
    found = e.unionByName(starts).unionByName(ends).select("session_id", "span_id", "kind", F.last("e", ignorenulls=True).over(back).alias("before"), F.first("e", ignorenulls=True).over(ahead).alias("after"))
    return found.where("kind <> 1").groupBy("session_id", "span_id").agg(
        F.max(F.when(F.col("kind") == 0, F.col("before")["timestamp_ms"])).alias("before_ms"),
        F.max(F.when(F.col("kind") == 2, F.col("after")["timestamp_ms"])).alias("after_ms"),
    )


def running_sums(rows: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, str], descending: bool = False, own: bool = True) -> DataFrame:
    """With the running sum of each column (new name -> column) over a number's order, within keys; with ``own`` the row itself counts.

    No task sees a key's whole order: values go to steps of 1/256 of a doubling of their size (scores between 0.5 and 1 to 256, between
    0 and 1 to some thousand), each step is summed by itself, and the sums of the steps before are added. Nulls come first."""
    v = F.col(order).cast("double")
    rows = rows.withColumn("_b", F.when(v == 0, 0).otherwise(F.floor(F.signum(v) * (F.log2(F.abs(v)) + 1100) * 256)))
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    inside = Window.partitionBy(*by, "_b").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    earlier = Window.partitionBy(*by).orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.groupBy(*by, "_b").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    steps = steps.select(*by, F.col("_b").alias("_step"), *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_p_{n}") for n in sums))
    local = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    keys = [f"_k_{k}" for k in by]
    steps = steps.withColumnsRenamed(dict(zip(by, keys, strict=True)))
    same = F.col("_b").eqNullSafe(F.col("_step"))
    for k, other in zip(by, keys, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(other))
    joined = local.join(steps, same)
    return joined.withColumns({n: F.col(n) + F.col(f"_p_{n}") for n in sums}).drop("_b", "_step", *keys, *(f"_p_{n}" for n in sums))


#: Letters of a key by which its order is cut into pieces.
_PREFIX = 4


def numbered(rows: DataFrame, key: str, rest: Sequence[str], name: str) -> DataFrame:
    """With each row's place from 1 on in the global order by (key, rest): a row's place in its key, the keys before it that begin
    with the same letters, and the rows of all earlier beginnings. No task sees more than one key or one beginning's keys."""
    start = F.substring(key, 1, _PREFIX)
    keys = rows.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_s", start)
    firsts = keys.groupBy("_s").agg(F.sum("_n").alias("_t"))
    firsts = firsts.select("_s", F.coalesce(F.sum("_t").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"))  # one row a beginning
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = keys.join(firsts, "_s").select(key, (before + F.col("_p")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key).orderBy(*rest))
    return rows.join(keys, key).withColumn(name, (own + F.col("_before")).cast("long")).drop("_before")
