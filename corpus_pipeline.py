"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of ``documents``; n_chars follows the text.

Nulls, empty texts and repeated rows: a document without text is clean, alone, and keeps its null to the end, where it
has no tokens. Rows that repeat are one document to near-dedup, which keeps all rows of an id or none. The other stages
judge each row. Columns besides doc_id and text are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.llm.store import forget, keep


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    from worktrace.llm.toxicity import drop_toxic

    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    from worktrace.llm.neardup import drop_near_duplicates

    return drop_near_duplicates(docs, k=5, percent=80)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur twice are cut out."""
    from worktrace.llm.substrings import remove_repeats

    return _sized(remove_repeats(docs, length=35))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that share ten words with a benchmark item are cut out."""
    from worktrace.llm.decontaminate import remove_contamination

    return _sized(remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as token ids: doc_id, n_tokens, ids."""
    import public_tokenizers

    from worktrace.llm.bpe import encode

    return encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The toxicity model and the tokens are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over documents. A stage's table is deleted when the next one's is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        if held is not None:
            forget(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
