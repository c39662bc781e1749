"""Process discovery: traces, variants, directly-follows graphs, profiles and trace similarity.

``rows`` are executions with process_id, operator, duration_ms and signature; ``step_rows`` are their ordered steps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from worktrace.operators.tables import written

TRACE = ("session_id", "seg_no")


def trace_steps(step_rows: DataFrame, activity: Column) -> DataFrame:
    """Steps of each trace without nulls and without consecutive repeats: (trace, step_no, activity)."""
    w = Window.partitionBy(*TRACE).orderBy("step_no")
    known = step_rows.select(*TRACE, "step_no", activity.alias("activity")).where("activity IS NOT NULL")
    return known.withColumn("_p", F.lag("activity").over(w)).where(~F.col("activity").eqNullSafe(F.col("_p"))).drop("_p")


def signatures(steps: DataFrame) -> DataFrame:
    """The trace as one string, in order of its steps."""
    ordered = F.array_sort(F.collect_list(F.struct("step_no", "activity")))
    return steps.groupBy(*TRACE).agg(F.concat_ws(">", F.transform(ordered, lambda x: x["activity"])).alias("signature"))


def follows(steps: DataFrame, keys: tuple[str, ...] = TRACE, order: str = "step_no") -> DataFrame:
    """Directly-follows edges with count and probability given the source. No arrays: one lead, two aggregates."""
    w = Window.partitionBy(*keys).orderBy(order)
    pairs = steps.select(F.col("activity").alias("source"), F.lead("activity").over(w).alias("target")).where("target IS NOT NULL")
    edges = pairs.groupBy("source", "target").agg(F.count("*").alias("n"))
    return edges.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source = target")


def ends(steps: DataFrame) -> DataFrame:
    """How many traces start and end with each activity."""
    per = steps.groupBy(*TRACE).agg(F.min_by("activity", "step_no").alias("first"), F.max_by("activity", "step_no").alias("last"))
    long = per.select(F.explode(F.array(F.struct(F.lit("start").alias("kind"), F.col("first").alias("activity")), F.struct(F.lit("end").alias("kind"), F.col("last").alias("activity")))).alias("x")).select("x.*")
    return long.groupBy("kind", "activity").agg(F.count("*").alias("n"))


def dominant_successors(edges: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "target"))
    return edges.withColumn("_r", rank).where("_r = 1").drop("_r")


def variants(rows: DataFrame) -> DataFrame:
    """Per process and signature: frequency, mean duration, share of the process."""
    out = rows.groupBy("process_id", "signature").agg(F.count("*").alias("frequency"), F.avg("duration_ms").alias("mean_ms"))
    return out.withColumn("share", F.col("frequency") / F.sum("frequency").over(Window.partitionBy("process_id")))


def profiles(rows: DataFrame) -> DataFrame:
    """Per process: executions, time, operators, variants, dominant share, mean manual share and systems touched.
    rows also carry manual_share and n_systems."""
    base = rows.groupBy("process_id").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.avg("manual_share").alias("manual_share"), F.avg("n_systems").alias("systems"), F.count_distinct("operator").alias("operators")
    )
    kinds = variants(rows).groupBy("process_id").agg(F.count("*").alias("n_variants"), F.max("share").alias("dominant_share"))
    return base.join(kinds, "process_id")


def step_time(rows: DataFrame, step_rows: DataFrame) -> DataFrame:
    """Frequency and time of each (process, system, category)."""
    named = step_rows.join(rows.select(*TRACE, "process_id"), list(TRACE))
    return named.groupBy("process_id", "system", "interaction_category").agg(F.count("*").alias("n_steps"), F.sum("n_events").alias("n_events"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


def time_analysis(rows: DataFrame) -> DataFrame:
    return rows.groupBy("process_id").agg(F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("mean_ms"), F.median("duration_ms").alias("median_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"))


def process_metrics(profile: DataFrame) -> DataFrame:
    """Shares of frequency and time, and the automation surface."""
    every = Window.partitionBy()  # one row per process
    return profile.select(
        "process_id", (F.col("n") / F.sum("n").over(every)).alias("frequency_share"), (F.col("total_ms") / F.sum("total_ms").over(every)).alias("time_share"), (F.col("dominant_share") * F.col("manual_share")).alias("surface")
    )


def effort(rows: DataFrame) -> DataFrame:
    """F, TD, AD and TS of each process, with the cross-check TD = F x AD."""
    out = rows.groupBy("process_id").agg(F.count("*").alias("f"), F.sum("duration_ms").alias("td"), F.avg("duration_ms").alias("ad"))
    return out.withColumn("ts", F.col("td") / F.sum("td").over(Window.partitionBy())).withColumn("consistent", F.abs(F.col("td") - F.col("f") * F.col("ad")) < 1)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def operator_variants(rows: DataFrame) -> DataFrame:
    """Per process and operator: the dominant variant's share with its Wilson interval, and the chi-square part against the
    process's pooled share."""
    top = variants(rows).withColumn("_r", F.row_number().over(Window.partitionBy("process_id").orderBy(F.desc("frequency"), "signature"))).where("_r = 1").select("process_id", F.col("signature").alias("dominant"), F.col("share").alias("pooled"))
    out = rows.join(top, "process_id").groupBy("process_id", "operator", "pooled").agg(F.count("*").alias("n"), F.count_if(F.col("signature") == F.col("dominant")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    expected = F.col("n") * F.col("pooled")
    chi = F.when((F.col("pooled") > 0) & (F.col("pooled") < 1), F.pow(F.col("hits") - expected, 2) / (expected * (1 - F.col("pooled"))))
    return out.select("process_id", "operator", "n", "hits", low.alias("low"), high.alias("high"), chi.alias("chi2_part"))


def concentration(rows: DataFrame) -> DataFrame:
    """Largest operator share and Herfindahl index of each process."""
    share = rows.groupBy("process_id", "operator").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("process_id")))
    return share.groupBy("process_id").agg(F.max("share").alias("largest"), F.sum(F.pow("share", F.lit(2))).alias("herfindahl"))


def classify(rows: DataFrame) -> DataFrame:
    """dominant, detour (passes all systems of the dominant path and more) or other."""
    top = variants(rows).withColumn("_r", F.row_number().over(Window.partitionBy("process_id").orderBy(F.desc("frequency"), "signature"))).where("_r = 1").select("process_id", F.col("signature").alias("dominant"))
    parts, main = F.split("signature", ">"), F.split("dominant", ">")
    kind = F.when(F.col("signature") == F.col("dominant"), "dominant").when(F.size(F.array_except(main, parts)) == 0, "detour").otherwise("other")
    return rows.join(top, "process_id").withColumn("path_class", kind).drop("dominant")


def routed(rows: DataFrame, allowed: list[str], most_ms: int) -> DataFrame:
    """With the automation routing of each execution: the first reason that applies; refused unless eligible."""
    systems = F.split("signature", ">")
    known = F.array(*map(F.lit, allowed))
    reason = (
        F.when(F.col("signature") == "", "no_evidence").when(F.size(F.array_except(systems, known)) > 0, "unknown_system").when(F.col("duration_ms") > most_ms, "too_long").when(F.size(systems) > 3, "too_many_steps").otherwise("eligible")
    )
    return rows.withColumn("reason", reason)


def route(rows: DataFrame, allowed: list[str], most_ms: int) -> DataFrame:
    return routed(rows, allowed, most_ms).groupBy("reason").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))


def top_aspects(events: DataFrame, keys: list[str], aspects: dict[str, tuple[str, str]], most: int | None = None) -> DataFrame:
    """(keys, aspect, value, n): all values of each aspect (condition, value), or the ``most`` frequent ones. An event is counted into its aspects in
    one pass; only the counts are ranked."""
    cells = F.array(*(F.when(F.expr(c), F.struct(F.lit(a).alias("aspect"), F.expr(v).alias("value"))) for a, (c, v) in aspects.items()))
    long = events.select(*keys, F.explode(F.array_compact(cells)).alias("x")).select(*keys, "x.aspect", "x.value").where("value IS NOT NULL")
    counted = long.groupBy(*keys, "aspect", "value").agg(F.count("*").alias("n"))
    if most is None:
        return counted
    place = F.row_number().over(Window.partitionBy(*keys, "aspect").orderBy(F.desc("n"), "value"))
    return counted.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def summary(rows: DataFrame, step_rows: DataFrame, top: int) -> DataFrame:
    """Compressed description of each process: its top systems."""
    counted = step_rows.join(rows.select(*TRACE, "process_id"), list(TRACE)).where("system IS NOT NULL").groupBy("process_id", "system").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("process_id").orderBy(F.desc("n"), "system"))).where(F.col("r") <= top)
    return ranked.groupBy("process_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("r", "system"))), lambda x: x["system"])).alias("top_systems"))


#: Activities that can be coded by one letter each: the code points from 256 on, without the surrogates.
MOST_LETTERS = 0x10FFFF - 0x100 - 0x800


def _letter(number: Column) -> Column:
    """The letter of an activity's number (from 0 on); more activities than letters are an error, not a wrong distance."""
    point = number + 0x100 + F.when(number + 0x100 >= 0xD800, 0x800).otherwise(0)
    bad = F.raise_error(F.lit("more activities than letters"))
    return F.when(number >= MOST_LETTERS, bad).otherwise(F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32"))


def coded(groups: DataFrame) -> DataFrame:
    """groups (.., signature) with ``code``: the signature with one letter for each step."""
    tokens = groups.select(F.explode(F.split("signature", ">")).alias("t")).distinct()
    letters = tokens.withColumn("c", _letter(F.row_number().over(Window.orderBy("t")) - 1))  # one row per distinct activity
    steps = groups.select("*", F.posexplode(F.split("signature", ">")).alias("i", "t")).join(F.broadcast(letters), "t")
    return steps.groupBy(*groups.columns).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"])).alias("code"))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of two strings, all of a's places at once in the bits of one number (Hyyro's form of
    the bit-parallel recurrence): a step of b costs a few operations on numbers of len(a) bits."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        met = row & masks.get(x, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """common_length of coded traces, in Arrow batches."""
    return pd.Series([common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


#: Blocks over which the pairs of one process are dealt.
BLOCKS = 16


def similar_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of distinct signatures of one process, each once (a <= b), with the edit, subsequence and set similarity of their steps. groups:
    (process_id, signature, path_class, frequency). Executions do not meet: their numbers are weights. The pairs of a process are dealt by
    blocks of their first signature, so that a large process is no single task."""
    rows, parts = written(coded(written(groups, "signatures")), "codes"), int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda n: rows.select("process_id", *(F.col(c).alias(x) for c, x in (("signature", n), ("path_class", f"c{n}"), ("frequency", f"f{n}"), ("code", f"k{n}"))))
    left = side("a").withColumn("block", F.pmod(F.xxhash64("a"), F.lit(BLOCKS)).cast("int")).repartition(parts, "process_id", "block")
    right = side("b").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).repartition(parts, "process_id", "block")
    pairs = left.join(right.hint("shuffle_hash"), ["process_id", "block"]).where("a <= b")
    p, q = F.split("a", ">"), F.split("b", ">")
    return pairs.select(
        "process_id",
        F.least("ca", "cb").alias("class_a"),
        F.greatest("ca", "cb").alias("class_b"),
        "a",
        "b",
        "fa",
        "fb",
        (1 - F.levenshtein("ka", "kb") / F.greatest(F.length("ka"), F.length("kb"))).alias("levenshtein"),
        (2 * lcs_length("ka", "kb") / (F.length("ka") + F.length("kb"))).alias("lcs"),
        (F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))).alias("jaccard"),
    )


def mean_similarities(pairs: DataFrame) -> DataFrame:
    """Means over ordered pairs of different executions, by process and pair of path classes."""
    weight = F.when(F.col("a") == F.col("b"), F.col("fa") * (F.col("fa") - 1)).otherwise(2 * F.col("fa") * F.col("fb"))
    mean = lambda c: F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum("w")).alias(f"mean_{c}")
    return pairs.withColumn("w", weight).groupBy("process_id", "class_a", "class_b").agg(mean("levenshtein"), mean("lcs"), mean("jaccard"), F.sum("w").alias("pairs"))
