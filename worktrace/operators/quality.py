"""Data-quality audit of raw event records. Raw records are JSON texts with the path's session and chunk beside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parsed(lines: DataFrame, column: str = "raw") -> DataFrame:
    """With ``v``, the record as a variant; null where the line is malformed. Blank lines go."""
    return lines.where(F.trim(column) != "").withColumn("v", F.try_parse_json(column))


def malformed(lines: DataFrame, column: str = "raw") -> DataFrame:
    """Quarantine: lines that are no JSON."""
    return parsed(lines, column).where("v IS NULL").drop("v")


def required(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Records with all required fields; see missing_fields for the others."""
    out = records
    for f in fields:
        out = out.where(F.try_variant_get("v", f"$.{f}", "string").isNotNull())
    return out


def missing_fields(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One issue row per record and missing field."""
    gone = F.filter(F.array(*(F.when(F.try_variant_get("v", f"$.{f}", "string").isNull(), f) for f in fields)), lambda x: x.isNotNull())
    return records.withColumn("field", F.explode(gone))


def missingness(records: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Per path: absent, null and empty counts and their percentages, from one pass."""
    cells = []
    for i, p in enumerate(paths):
        at = F.try_variant_get("v", p, "variant")
        text = F.try_variant_get("v", p, "string")
        cells += [F.count_if(at.isNull()).alias(f"a{i}"), F.count_if(F.is_variant_null(at)).alias(f"n{i}"), F.count_if(text.isin("", "{}", "[]")).alias(f"e{i}")]
    one = records.agg(F.count("*").alias("n"), *cells)
    pct = lambda c: F.try_divide(100 * F.col(c), "n")
    rows = F.array(
        *(
            F.struct(
                F.lit(p).alias("path"), F.col(f"a{i}").alias("absent"), F.col(f"n{i}").alias("nulls"), F.col(f"e{i}").alias("empty"), pct(f"a{i}").alias("pct_absent"), pct(f"n{i}").alias("pct_null"), pct(f"e{i}").alias("pct_empty")
            )
            for i, p in enumerate(paths)
        )
    )
    return one.select(F.explode(rows).alias("x")).select("x.*")


def exact_duplicates(records: DataFrame, key: str) -> DataFrame:
    """Groups of equal records whatever the order of keys; a hash is shuffled, not the text."""
    text = F.to_json("v")
    hashed = records.select(key, F.xxhash64(text).alias("h"), F.md5(text).alias("m"))
    return hashed.groupBy("h", "m").agg(F.count("*").alias("n"), F.min(key).alias(f"first_{key}")).where("n > 1").drop("h", "m")


def semantic_duplicates(events: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Same content under several ids."""
    return events.groupBy(*keys).agg(F.count_distinct(id_col).alias("n_ids"), F.min(id_col).alias("first_id")).where("n_ids > 1")


def sequential_duplicates(events: DataFrame, keys: Sequence[str], by: str = "idx") -> DataFrame:
    """Events equal to the one before them in all keys."""
    w = Window.partitionBy("session_id").orderBy(by)
    same = F.lit(True)
    for k in keys:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    return events.withColumn("_same", same & F.lag(by).over(w).isNotNull()).where("_same").drop("_same")


def timestamp_quality(events: DataFrame, buckets: Sequence[int]) -> DataFrame:
    """Per session: negative and zero gaps, the largest gap, and a histogram of gaps."""
    w = Window.partitionBy("session_id").orderBy("idx")
    gaps = events.select("session_id", (F.col("timestamp_ms") - F.lag("timestamp_ms").over(w)).alias("gap"))
    edges = [*buckets, None]
    low: int | None = None
    cells = []
    for i, high in enumerate(edges):
        inside = F.lit(True) if low is None else F.col("gap") >= low
        cells.append(F.count_if(F.col("gap").isNotNull() & inside & (F.lit(True) if high is None else F.col("gap") < high)).alias(f"bucket_{i}"))
        low = high
    return gaps.groupBy("session_id").agg(F.count_if(F.col("gap") < 0).alias("negative"), F.count_if(F.col("gap") == 0).alias("zero"), F.max("gap").alias("max_gap"), *cells)


def unknown_types(events: DataFrame, known: DataFrame) -> DataFrame:
    """(layer, event_type) pairs outside the dictionary, with counts. The dictionary is a small table."""
    return events.join(F.broadcast(known), ["layer", "event_type"], "left_anti").groupBy("layer", "event_type").agg(F.count("*").alias("n"))


def emptiness_by_type(events: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Share of events of a type where no known field holds anything."""
    empty = F.lit(True)
    for f in fields:
        empty = empty & (F.coalesce(F.col(f).cast("string"), F.lit("")) == "")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(empty).alias("n_empty")).withColumn("share", F.col("n_empty") / F.col("n"))


def text_profile(rows: DataFrame, text: str, by: str) -> DataFrame:
    """Presence and length of a text per key and overall (null key)."""
    length = F.length(text)
    has = F.coalesce(length > 0, F.lit(False))
    return rows.rollup(by).agg(F.count("*").alias("n"), F.count_if(has).alias("n_text"), F.min(F.when(has, length)).alias("shortest"), F.max(F.when(has, length)).alias("longest"), F.avg(F.when(has, length)).alias("mean_length"))


def identity_checks(events: DataFrame) -> DataFrame:
    """Sessions seen from more than one machine, or with records that name another session or chunk than the folder that they lie
    in. events: session_id, chunk_id, machine, session_dir, chunk_dir; a session is its folder's records and its own."""
    out = events.groupBy("session_id").agg(
        F.count_distinct("machine").alias("machines"),
        F.count_if(~F.col("session_id").eqNullSafe(F.col("session_dir"))).alias("other_session"),
        F.count_if(~F.col("chunk_id").eqNullSafe(F.col("chunk_dir"))).alias("other_chunk"),
    )
    return out.where("machines > 1 OR other_session > 0 OR other_chunk > 0")


def gt_coverage(events: DataFrame, spans: DataFrame, slack_ms: int) -> DataFrame:
    """Sessions whose events end long before their ground truth does."""
    last = events.groupBy("session_id").agg(F.max("timestamp_ms").alias("last_ms"))
    due = spans.groupBy("session_id").agg(F.max("end_ms").alias("gt_end_ms"))
    return due.join(last, "session_id", "left").where(F.coalesce(F.col("last_ms"), F.lit(0)) < F.col("gt_end_ms") - slack_ms)


def repeated_ids(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def out_of_order(events: DataFrame, natural: Sequence[str]) -> DataFrame:
    """Events whose time is before that of the event before them in natural order, per session."""
    w = Window.partitionBy("session_id").orderBy(*natural)
    late = F.col("timestamp_ms") < F.lag("timestamp_ms").over(w)
    return events.select("session_id", F.coalesce(late, F.lit(False)).alias("late")).groupBy("session_id").agg(F.count_if("late").alias("n_late"))


def chunk_linkage(chunks: DataFrame) -> DataFrame:
    """Chunks whose previous or next id names no chunk of their session. chunks: (session_id, chunk_id, previous_id, next_id)."""
    links = chunks.select("session_id", "chunk_id", F.explode(F.array(F.struct(F.lit("previous").alias("side"), F.col("previous_id").alias("target")), F.struct(F.lit("next").alias("side"), F.col("next_id").alias("target")))).alias("x"))
    links = links.select("session_id", "chunk_id", "x.side", "x.target").where("target IS NOT NULL")
    known = chunks.select("session_id", F.col("chunk_id").alias("target"))
    return links.join(known, ["session_id", "target"], "left_anti").select("session_id", "chunk_id", "side", "target")


def issue_summary(issues: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Issues (scope, kind) as one row per scope."""
    return issues.groupBy("scope").pivot("kind", list(kinds)).agg(F.count(F.lit(1))).na.fill(0)


def cleaned(events: DataFrame, content: Sequence[str], natural: Sequence[str]) -> DataFrame:
    """Exact repeats dropped (the first stays), with the new position and whether it moved against natural order."""
    first = Window.partitionBy("session_id", *content).orderBy(*natural)
    kept = events.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    before = F.row_number().over(Window.partitionBy("session_id").orderBy(*natural))
    after = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp_ms", *natural))
    return kept.withColumns({"position": after, "moved": before != after})


def profile(events: DataFrame) -> DataFrame:
    """Counts and duration per session, per session and type, and overall: one pass over grouping sets."""
    sets = [("session_id", "event_type"), ("session_id",), ()]
    return events.groupingSets([[F.col(c) for c in s] for s in sets], "session_id", "event_type").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("duration_ms"), F.count_if("has_extracted_text").alias("n_text")
    )


def health(events: DataFrame, sessions: DataFrame, least_coverage: float, least_domains: int) -> DataFrame:
    """Instrumentation health per session: domain coverage, distinct domains, degraded, warnings. Sessions without events count."""
    seen = events.groupBy("session_id").agg(F.count("*").alias("n_events"), F.avg(F.col("browser_domain").isNotNull().cast("double")).alias("coverage"), F.count_distinct("browser_domain").alias("n_domains"))
    out = sessions.join(seen, "session_id", "left").na.fill({"n_events": 0, "n_domains": 0})
    low = F.coalesce(F.col("coverage") < least_coverage, F.lit(True))
    warn = F.array_compact(F.array(F.when(F.col("n_events") == 0, "no_events"), F.when((F.col("n_events") > 0) & low, "low_domain_coverage"), F.when(F.col("n_domains") < least_domains, "few_domains")))
    return out.withColumn("warnings", F.concat_ws(",", warn)).withColumn("degraded", F.col("warnings") != "")


def agreement(rows: DataFrame, flag: Column, truth: Column) -> DataFrame:
    """tp, fp, fn, tn of a flag, with sensitivity and specificity."""
    counts = rows.agg(F.count_if(flag & truth).alias("tp"), F.count_if(flag & ~truth).alias("fp"), F.count_if(~flag & truth).alias("fn"), F.count_if(~flag & ~truth).alias("tn"))
    return counts.withColumns({"sensitivity": F.try_divide("tp", F.col("tp") + F.col("fn")), "specificity": F.try_divide("tn", F.col("tn") + F.col("fp"))})


def reference_gaps(refs: DataFrame, present: DataFrame) -> DataFrame:
    """Per chunk: references, those present, and whether the missing ones lie between present ones or after them.
    refs: (session_id, chunk_id, name, at_ms); present: (session_id, chunk_id, name)."""
    both = refs.join(present.withColumn("here", F.lit(True)), ["session_id", "chunk_id", "name"], "left")
    here = F.col("here").isNotNull()
    out = both.groupBy("session_id", "chunk_id").agg(F.count("*").alias("n_refs"), F.count_if(here).alias("n_present"), F.min(F.when(~here, F.col("at_ms"))).alias("first_missing"), F.max(F.when(here, F.col("at_ms"))).alias("last_present"))
    kind = F.when(F.col("n_refs") == F.col("n_present"), "complete").when(F.col("n_present") == 0, "all").when(F.col("first_missing") < F.col("last_present"), "interleaved").otherwise("tail")
    return out.select("session_id", "chunk_id", "n_refs", "n_present", kind.alias("gap_kind"))
