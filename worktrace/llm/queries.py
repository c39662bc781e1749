"""Registered queries of the operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from worktrace.llm.bpe import encode

    return encode(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), ids=False, digests=True)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.decontaminate import decontaminate

    found = decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.neardup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), k=2, percent=80)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.fingerprint import compare_edited

    return compare_edited(_docs(spark, sf_dir))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.substrings import dedup_substrings

    return dedup_substrings(_docs(spark, sf_dir), length=35)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.sharding import kd_shards

    dealt = kd_shards(_docs(spark, sf_dir), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _fold(k: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.quality import score_quality

    return score_quality(_docs(spark, sf_dir), _labels(spark, sf_dir), learn=_fold(5) != 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) mod 5 is not 0; the others are marked held_out."""
    from worktrace.llm.toxicity import score_toxicity

    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return score_toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir), learn=part != 0).withColumn("held_out", part == 0)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.langid import identify

    docs = _docs(spark, sf_dir)
    return identify(docs, docs, learn=_fold(4) != 2)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.html import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.whitening import whiten

    return whiten(_vectors(spark, sf_dir))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.simhash import simhash_components

    return simhash_components(_docs(spark, sf_dir), k=4)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrace.llm.centroids import cluster_centroids

    return cluster_centroids(_vectors(spark, sf_dir), k=16, rounds=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_neardup": op5_neardup,
    "op6_fingerprints": op6_fingerprints,
    "op7_substrings": op7_substrings,
    "op8_shards": op8_shards,
    "op9_langid": op9_langid,
    "op10_html": op10_html,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_clusters": op13_clusters,
}



def _placed(r: int) -> str:
    """Each vector's nearest centroid of round r: squared distances from products of whole numbers."""
    product = lambda a, b: f"list_inner_product({a}, {b})"
    return f"""a{r} AS MATERIALIZED (SELECT rid, vec_id, x, c, CAST(d AS BIGINT) AS distance FROM (
    SELECT rid, vec_id, x, c, {product("x", "x")} - 2 * {product("x", "m")} + {product("m", "m")} AS d FROM kept CROSS JOIN c{r})
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""


def _moved(r: int) -> str:
    """The centroids of round r: floors of the means; those without vectors stay."""
    return f"""c{r} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{r - 1} o LEFT JOIN (
    SELECT c, list(v ORDER BY j) AS m FROM (SELECT c, j, floor(sum(e) / count(*)) AS v FROM (SELECT c, unnest(x) AS e, unnest(range(1, 65)) AS j FROM a{r - 1}) GROUP BY c, j) GROUP BY c) n USING (c))"""


ORACLE_SQL: dict[str, str] = {
    "op13_clusters": f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: floor(64 * CAST(v AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x AS m FROM kept QUALIFY c < 16),
{_placed(0)}, {_moved(1)}, {_placed(1)}, {_moved(2)}, {_placed(2)}, {_moved(3)}, {_placed(3)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(m, lambda v: CAST(v AS BIGINT)), ',')) AS centroid_sha256 FROM a3 JOIN c3 USING (c)""",
    "op5_neardup": r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, x FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM doc WHERE len(w) >= 2
    UNION ALL SELECT doc_id, w[1] FROM doc WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM doc UNION SELECT l.v, r.c FROM reach r JOIN links l ON l.u = r.doc_id)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, min(c) = doc.doc_id AS kept
FROM doc JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY doc.doc_id, n""",
    "op7_substrings": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS c FROM win) WHERE c > 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
gone AS (SELECT doc_id, p FROM (SELECT word.doc_id, p, x, max(i) OVER (PARTITION BY word.doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS last
         FROM word LEFT JOIN dup ON dup.doc_id = word.doc_id AND dup.i = p) WHERE p - last < 35),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)""",
    "op3_decontaminate": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x
        FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.x = win.x),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
