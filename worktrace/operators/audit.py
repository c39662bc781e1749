"""The whole audit of raw event records as one table of facts: a row per session, section and name, and the data set's totals.

Records are parsed once; neighbours in a session's order are looked up in one window pass, and what is counted by session comes from
one aggregate over it. Duplicates and dictionary look-ups are aggregates of their own, over hashes and not over texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrace.operators.quality import parsed
from worktrace.operators.tables import written

#: Upper bounds in ms of the pauses that are counted together. Fixed values.
PAUSES = {"under_100ms": 100, "100ms_to_1s": 1000, "1s_to_10s": 10_000, "10s_to_60s": 60_000, "over_60s": None}
#: A time in text may differ from the number by so many ms.
SLACK_MS = 1000
FACTS = ["session_id", "section", "name", "value"]


def records(lines: DataFrame) -> DataFrame:
    """Flat records of lines (session_dir, chunk_dir, raw): what the audit looks at; ``v`` is null where a line is malformed."""
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    payload = at("$.payload", "variant")
    return parsed(lines).select(
        F.col("session_dir").alias("session_id"),
        "chunk_dir",
        "v",
        at("$.session_id", "string").alias("own_session"),
        F.coalesce(at("$.correlation.chunk_id", "string"), F.col("chunk_dir")).alias("own_chunk"),
        at("$.event_id", "string").alias("event_id"),
        at("$.timestamp_ms", "long").alias("timestamp_ms"),
        at("$.timestamp_iso", "string").alias("timestamp_iso"),
        at("$.layer", "string").alias("layer"),
        at("$.event_type", "string").alias("event_type"),
        at("$.correlation.sequence_number", "long").alias("sequence_number"),
        F.md5(F.to_json(payload)).alias("payload"),
        F.coalesce(F.to_json(payload), F.lit("{}")).isin("{}", "[]", '""', "null").alias("no_payload"),
    )


def time_checks() -> dict[str, Column]:
    """Conditions on a record: its time as text is not UTC, or differs from the number by more than SLACK_MS."""
    utc = F.coalesce(F.col("timestamp_iso").endswith("Z"), F.lit(False))
    iso_ms = F.when(utc, F.unix_millis(F.try_to_timestamp("timestamp_iso")))
    return {"not_utc": ~utc | iso_ms.isNull(), "time_mismatch": F.coalesce(F.abs(iso_ms - F.col("timestamp_ms")) > SLACK_MS, F.lit(False))}


def _long(wide: DataFrame, section: str, names: Sequence[str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in names))
    return wide.select("session_id", F.lit(section).alias("section"), F.explode(rows).alias("x")).select("session_id", "section", "x.name", "x.value")


def facts(lines: DataFrame, known: DataFrame, fields: Mapping[str, str], repeats: Sequence[str] = ()) -> DataFrame:
    """(session_id, section, name, value) per session; rows without a session are the whole data set's: sums, and the largest pause.

    lines: session_dir, chunk_dir, raw. known: (layer, event_type), a small dictionary. fields: name -> path whose absent, null and
    empty values are counted; ``repeats`` are event types whose sequential repeats are expected and not counted. Sections: lines, times,
    pauses, missing, identity, duplicates; sequential and no_payload by event type; unknown by layer and layer/type. Sections by
    type have rows for what occurs only. Records without a time come first in their session and have no pause.
    """
    missing = {}
    for name, path in fields.items():
        there, text = F.try_variant_get("v", path, "variant"), F.try_variant_get("v", path, "string")
        missing |= {f"{name}_absent": there.isNull(), f"{name}_null": F.is_variant_null(there), f"{name}_empty": text.isin("", "{}", "[]")}
    w = Window.partitionBy("session_id", "good").orderBy("timestamp_ms", "sequence_number", "event_id")
    read_once = records(lines).withColumns({"good": F.col("v").isNotNull(), "whole": F.md5(F.to_json("v"))} | missing).drop("v")
    all_rows = read_once.withColumns(
        {
            "pause": F.col("timestamp_ms") - F.lag("timestamp_ms").over(w),
            "repeat": F.coalesce(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")) & F.lag("payload").over(w).eqNullSafe(F.col("payload")) & F.lag(F.lit(True)).over(w), F.lit(False)),
        }
    )
    # parsed and put in order once, not for each section and total
    all_rows = written(all_rows, "audited")
    good = all_rows.where("good")
    checks = time_checks() | {"negative": F.col("pause") < 0, "zero": F.col("pause") == 0}
    low, pauses = None, {}
    for name, high in PAUSES.items():
        pauses[name] = F.col("pause").isNotNull() & (F.lit(True) if low is None else F.col("pause") >= low) & (F.lit(True) if high is None else F.col("pause") < high)
        low = high
    identity = {"other_session": ~F.col("own_session").eqNullSafe(F.col("session_id")), "other_chunk": ~F.col("own_chunk").eqNullSafe(F.col("chunk_dir"))}
    counted = checks | pauses | {n: F.col(n) for n in missing} | identity
    wide = good.groupBy("session_id").agg(F.max("pause").alias("longest"), *(F.count_if(c).alias(n) for n, c in counted.items()))
    wide = wide.withColumn("longest", F.greatest("longest", F.lit(0)))
    sections = {"times": [*checks, "longest"], "pauses": pauses, "missing": missing, "identity": identity}
    flat = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("value")) for s, names in sections.items() for n in names))
    out = wide.select("session_id", F.explode(flat).alias("x")).select("session_id", "x.*")

    read = all_rows.groupBy("session_id").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("good")).alias("malformed"), F.count_if("good").alias("n_events"))
    out = out.unionByName(_long(read, "lines", ["n_lines", "malformed", "n_events"]))

    same = good.groupBy("session_id", "whole").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(_long(same.groupBy("session_id").agg(F.count("*").alias("exact_groups"), F.sum(F.col("n") - 1).alias("exact_repeats")), "duplicates", ["exact_groups", "exact_repeats"]))
    alike = good.groupBy("session_id", "timestamp_ms", "event_type", "payload").agg(F.count_distinct("event_id").alias("n")).where("n > 1")
    out = out.unionByName(_long(alike.groupBy("session_id").agg(F.count("*").alias("semantic_groups")), "duplicates", ["semantic_groups"]))

    expected = F.coalesce(F.col("event_type").isin(*repeats), F.lit(False)) if repeats else F.lit(False)
    by_type = good.groupBy("session_id", F.coalesce("event_type", F.lit("none")).alias("name")).agg(F.count_if(F.col("repeat") & ~expected).alias("sequential"), F.count_if("no_payload").alias("no_payload"))
    for section in ("sequential", "no_payload"):
        out = out.unionByName(by_type.select("session_id", F.lit(section).alias("section"), "name", F.col(section).alias("value")).where("value > 0"))

    layers = F.broadcast(known.select("layer").distinct())
    odd = good.groupBy("session_id", "layer", "event_type").agg(F.count("*").alias("value"))
    strange = odd.join(layers, "layer", "left_anti").groupBy("session_id", F.coalesce("layer", F.lit("none")).alias("name")).agg(F.sum("value").alias("value"))
    foreign = odd.join(layers, "layer", "left_semi").join(F.broadcast(known), ["layer", "event_type"], "left_anti").select("session_id", F.concat_ws("/", "layer", F.coalesce("event_type", F.lit("none"))).alias("name"), "value")
    out = out.unionByName(strange.unionByName(foreign).select("session_id", F.lit("unknown").alias("section"), "name", "value"))

    out = written(out.select(FACTS), "facts")
    total = out.groupBy("section", "name").agg(F.when(F.col("name") == "longest", F.max("value")).otherwise(F.sum("value")).alias("value"))
    return out.select(FACTS).unionByName(total.select(F.lit(None).cast("string").alias("session_id"), "section", "name", "value"))


def session_profiles(events: DataFrame, ground_truth: DataFrame, top: int = 20) -> DataFrame:
    """Per session: chunks, events, duration, texts, whether it has ground truth, counts by type and layer, and its ``top`` applications as
    maps. A session without events is no row. events: session_id, chunk_id, timestamp_ms, event_type, layer, application, has_text."""

    def counts(column: str, most: int | None) -> DataFrame:
        n = events.where(F.col(column).isNotNull()).groupBy("session_id", F.col(column).alias("x")).agg(F.count("*").alias("n"))
        if most is not None:
            n = n.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "x"))).where(F.col("r") <= most)
        return n.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("x", "n")))).alias(f"by_{column}"))

    base = events.groupBy("session_id").agg(
        F.count_distinct("chunk_id").alias("n_chunks"), F.count("*").alias("n_events"), ((F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000).alias("duration_s"), F.count_if("has_text").alias("n_text")
    )
    truth = ground_truth.select("session_id").distinct().withColumn("has_ground_truth", F.lit(True))
    out = base.withColumn("text_rate", F.col("n_text") / F.col("n_events")).join(truth, "session_id", "left").na.fill({"has_ground_truth": False})
    for column, most in (("event_type", None), ("layer", None), ("application", top)):
        out = out.join(counts(column, most), "session_id", "left")
    return out
