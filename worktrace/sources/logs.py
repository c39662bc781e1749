"""Readers of a dataset folder: <session>/<chunk>/events.jsonl, manifest.json, gt.jsonl, gt_manifest.json."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = r"([^/]+)/([^/]+)/[^/]+$"


def listing(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, size) of files by name; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"))


def _placed(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("path", _PLACE, 1).alias("session_dir"), F.regexp_extract("path", _PLACE, 2).alias("chunk_dir"), "path", "size")


def chunks_of(files: DataFrame) -> DataFrame:
    """(session_dir, chunk_dir, path, size) of the chunks that hold events, among files (path, size)."""
    return _placed(files).where(F.col("path").endswith("/events.jsonl"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    return chunks_of(listing(spark, root, "events.jsonl"))


def screenshot_folders(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with the folder of their screenshots: their own, or the sibling chunk_HHMM with the chunk's four digits; null if
    neither has any. chunks: session_dir, chunk_dir; files (path, size)."""
    shots = _placed(files.where(F.col("path").rlike("[.](png|jpg)$"))).groupBy("session_dir", "chunk_dir").agg(F.count("*").alias("n_shots"))
    own = shots.select("session_dir", "chunk_dir", F.col("n_shots").alias("own_shots"))
    digits = F.regexp_extract("chunk_dir", r"(\d{4})$", 1)
    sibling = shots.where(F.col("chunk_dir").rlike(r"^chunk_\d{4}$")).select("session_dir", digits.alias("digits"), F.col("chunk_dir").alias("sibling_dir"), F.col("n_shots").alias("sibling_shots"))
    both = chunks.join(own, ["session_dir", "chunk_dir"], "left").withColumn("digits", digits).join(sibling, ["session_dir", "digits"], "left")
    folder = F.when(F.col("own_shots") > 0, F.col("chunk_dir")).otherwise(F.col("sibling_dir"))
    return both.select("session_dir", "chunk_dir", folder.alias("shots_dir"), F.coalesce("own_shots", "sibling_shots", F.lit(0)).alias("n_shots"))


def resolved(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (session_dir, chunk_dir, filename) with the size of the file that is there, null if none is."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    there = _placed(files).select("session_dir", "chunk_dir", name.alias("filename"), F.col("size").alias("file_size"))
    return refs.join(there, ["session_dir", "chunk_dir", "filename"], "left").withColumn("present", F.col("file_size").isNotNull())


def _lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root)
    return text.select(F.col("value").alias("raw"), F.regexp_extract(path, _PLACE, 1).alias("session_dir"), F.regexp_extract(path, _PLACE, 2).alias("chunk_dir")).where(F.trim("raw") != "")


def events(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(records with the variant v, malformed lines)."""
    lines = _lines(spark, root, "events.jsonl").withColumn("v", F.try_parse_json("raw"))
    return lines.where("v IS NOT NULL"), lines.where("v IS NULL").drop("v")


def typed(records: DataFrame, *keep: str) -> DataFrame:
    """Flat events: the fields that the operators use, and the columns to keep."""
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    return records.select(
        at("$.event_id", "string").alias("event_id"),
        at("$.session_id", "string").alias("session_id"),
        at("$.timestamp_ms", "long").alias("timestamp_ms"),
        at("$.event_type", "string").alias("event_type"),
        at("$.layer", "string").alias("layer"),
        at("$.context.active_app.app_name", "string").alias("application"),
        at("$.context.active_app.window_title", "string").alias("window_title"),
        at("$.context.active_browser_tab.url", "string").alias("browser_url"),
        at("$.context.extracted_text.text", "string").alias("text"),
        at("$.correlation.sequence_number", "long").alias("sequence_number"),
        F.coalesce(at("$.correlation.chunk_id", "string"), F.col("chunk_dir")).alias("chunk_id"),
        *keep,
    )


def merged(typed_events: DataFrame) -> DataFrame:
    """One chronological stream per session: idx by (time, chunk, sequence, id)."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("timestamp_ms", "chunk_id", "sequence_number", "event_id")
    return typed_events.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


MANIFEST = "chunk_id string, session_id string, time_range struct<start_ms:bigint,end_ms:bigint>, previous_chunk_id string, next_chunk_id string, is_session_start boolean, is_session_end boolean, _corrupt_record string"


def manifests_from(texts: DataFrame, column: str = "raw") -> DataFrame:
    """Chunk manifests from their texts, one each; malformed ones have nulls and their text in _corrupt_record."""
    return texts.select(F.from_json(column, MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("m")).select("m.*")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Chunk manifests; malformed ones have nulls and their text in _corrupt_record."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(root)


#: Fields of a ground-truth log record that are texts. Fixed values.
RECORD = ("event", "ts_utc", "process_code", "process_name", "case_id", "from", "to", "split_id", "task_id", "current_process", "process_variant")


def records_from(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ground-truth records in typed columns, malformed lines) of lines with ``raw``; other columns stay. Blank lines go."""
    parsed = lines.where(F.trim("raw") != "").withColumn("v", F.try_parse_json("raw"))
    at = lambda n: F.try_variant_get("v", f"$.{n}", "string").alias(n)
    rest = [c for c in lines.columns if c != "raw"]
    good = parsed.where("v IS NOT NULL").select(*rest, *map(at, RECORD)).withColumn("at_ms", F.unix_millis(F.try_to_timestamp("ts_utc")))
    return good, parsed.where("v IS NULL").drop("v")


def ground_truth_log(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Records and malformed lines of the gt.jsonl files. Order is the files' order: rec_no grows with it inside a file."""
    return records_from(_lines(spark, root, "gt.jsonl").withColumn("rec_no", F.monotonically_increasing_id()))


GT_MANIFEST = "processes array<struct<code:string,family_name:string,executions:array<struct<code:string,variant:string,case_id:string,start_ts:timestamp,end_ts:timestamp,apps:array<string>,split_id:string>>>>"


def executions_from(manifests_: DataFrame) -> DataFrame:
    """Executions of ground-truth manifests (session_dir, processes): one row each; the process's code where an execution has none,
    and a split id marks a suspended one."""
    flat = manifests_.select("session_dir", F.explode("processes").alias("p")).select("session_dir", "p.code", F.explode("p.executions").alias("e"))
    return flat.select("session_dir", F.coalesce("e.code", "code").alias("process_code"), "e.case_id", "e.variant", F.unix_millis("e.start_ts").alias("start_ms"), F.unix_millis("e.end_ts").alias("end_ms"), "e.apps", "e.split_id", F.col("e.split_id").isNotNull().alias("suspended"))


def ground_truth(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.schema(GT_MANIFEST).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "gt_manifest.json").json(root)
    return executions_from(raw.select(F.regexp_extract(F.col("_metadata.file_path"), _PLACE, 1).alias("session_dir"), "processes"))
