"""Substring deduplication by seed and extend.

Seeds are winnowed anchors (Schleimer, Wilkerson and Aiken): of the hashes of SEED consecutive words, each
window of ``length`` words keeps the least one, leftmost on a tie. Equal windows keep the same seed at the same
place, so every repeated window belongs to exactly one seed, and a seed that occurs once owns none.

A seed is extended both ways over all windows that it owns: its block. Seeds whose whole block occurs again
are done. Where the blocks of one anchor differ (a repeat begins or ends there), one copy of each different
block is opened and its windows are compared by hash, which gives the maximal repeats word by word. No pairs
of documents are formed: a passage in thousands of documents costs as many rows as it has occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm.store import fits, forget, keep
from worktrace.llm.text import SPACED, Words, chunks, mix, ragged, ranges, word_windows, words_of

_U = np.uint64


def _seeds(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each seed: (text, its first word, first and last start of the windows that it owns, hash).

    All positions count from the first word of the chunk."""
    size = max(1, length // 3)
    span = length - size + 1
    hashes = words.hashes()
    starts, doc, grams = word_windows(hashes, words.off, size)
    # least hash among the span grams from each on, leftmost on a tie, by doubling
    value, place, width = grams, np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        ahead = np.minimum(np.arange(len(grams)) + step, max(len(grams) - 1, 0))
        right = value[ahead] < value
        value, place = np.where(right, value[ahead], value), np.where(right, place[ahead], place)
        width += step
    count = np.diff(words.off)
    first = np.concatenate(([0], np.cumsum(np.maximum(count - size + 1, 0))))[:-1]
    windows = np.maximum(count - length + 1, 0)
    at = ranges(first, windows)  # gram that begins each window
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    chosen = place[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[at[1:]] != doc[at[:-1]])
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(at)) - 1
    return doc[at[i]], starts[chosen[i]], starts[at[i]], starts[at[j]], grams[chosen[i]]


def _sketch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = words_of(batch.column(1), SPACED, lower=False)
            doc, place, _, _, anchor = _seeds(words, length)
            n = np.bincount(doc, minlength=batch.num_rows)
            texts = batch.column(1).to_pylist()
            kept = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(words.counts, pa.int64()), pa.array(kept), ragged(place - words.off[doc], n, pa.int32()), ragged(anchor.view(np.int64), n, pa.int64())],
                names=["doc_id", "key", "t", "n_words", "kept_sha256", "places", "anchors"],
            )

    return run


def _extend(length: int):
    """Rows (key, text, t, places): the owned windows of each seed at one of the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = words_of(batch.column(1), SPACED, lower=False)
            doc, place, s0, s1, anchor = _seeds(words, length)
            lists = batch.column(3)
            n = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), n)
            wanted = words.off[owner] + lists.flatten().to_numpy()
            use = np.isin(place, wanted)
            doc, place, s0, s1, anchor = doc[use], place[use], s0[use], s1[use], anchor[use]
            hashes = words.hashes()
            _, of, windows = word_windows(hashes, words.off, length)
            # index of a window: its start less the words that begin none in the texts before
            less = np.concatenate(([0], np.cumsum(words.counts - np.maximum(words.counts - length + 1, 0))))[:-1]
            owned = s1 - s0 + 1
            each = windows[ranges(s0 - less[doc], owned)]
            # a block is its first and last window and what lies between, seen from the seed
            digest = np.add.reduceat(mix(each + ranges(np.zeros(len(s0), np.int64), owned).astype(np.uint64) * _U(0x9E3779B97F4A7C15)), np.cumsum(owned) - owned) if len(each) else np.zeros(0, np.uint64)
            block = mix(digest + mix((place - s0).astype(np.uint64)) + owned.astype(np.uint64))
            cols = [
                batch.column(0).take(pa.array(doc)),
                batch.column(2).take(pa.array(doc)),
                pa.array(s0 - words.off[doc], pa.int32()),
                pa.array(s1 - words.off[doc], pa.int32()),
                pa.array(anchor.view(np.int64)),
                pa.array(block.view(np.int64)),
                ragged(each.view(np.int64), owned, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "t", "s0", "s1", "anchor", "block", "windows"])

    return run


def _cut(length: int):
    """Rows (key, text, t, spans of window starts): the words left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            removed, kept = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts = text.encode().split()
                gone = np.zeros(len(parts) + 1, dtype=np.int64)
                a = np.array([s["a"] for s in spans])
                b = np.array([s["b"] for s in spans]) + length
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
                left = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                removed.append(len(parts) - len(left))
                kept.append(b" ".join([parts[i] for i in left]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["key", "t", "n_removed", "kept_text"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """With key and t, which tell rows apart by id and text, whatever the ids."""
    text = F.col(text_col).cast("string")
    return docs.select(*more, F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("key"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("t"))


def _find(docs: DataFrame, length: int, text: bool, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with key, t, n_words and kept_sha256; rows that lose words with key, t, n_removed, cut_sha256 and kept_text)."""
    source = _keyed(docs, id_col, text_col, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    row = ["key", "t"]
    sketches = keep(source.mapInArrow(_sketch(length), "doc_id long, key long, t long, n_words long, kept_sha256 string, places array<int>, anchors array<long>"), "seeds")

    occurring = sketches.select(*row, F.explode(F.arrays_zip("places", "anchors")).alias("x")).select(*row, "x.places", "x.anchors").withColumnsRenamed({"places": "place", "anchors": "anchor"})
    # aggregates are written before they are joined: both sides of the join are then shuffled for it, and a hot key can be split
    repeated = keep(occurring.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated")
    hits = keep(occurring.join(repeated, "anchor").groupBy(*row).agg(F.collect_set("place").alias("places")), "hits")
    n_hits = hits.count()
    few = F.broadcast(hits.select(*row)) if fits(n_hits, 2) else None
    candidates = source.select("key", "text", "t")
    if few is not None:  # else the join below shuffles all texts
        candidates = candidates.join(few, row, "left_semi").select("key", "text", "t")
    seeds = keep(candidates.join(hits, row).select("key", "text", "t", "places").mapInArrow(_extend(length), "key long, t long, s0 int, s1 int, anchor long, block long, windows array<long>"), "blocks")

    blocks = keep(seeds.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(F.struct("key", "t", "s0")).alias("first")), "kinds")
    whole = seeds.drop("windows").join(blocks.where("n > 1").select("anchor", "block"), ["anchor", "block"], "left_semi")
    spans = whole.select(*row, F.struct(F.col("s0").alias("a"), F.col("s1").alias("b")).alias("span"))
    # anchors with several different blocks: one copy of each is opened
    mixed = keep(blocks.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"), "mixed")
    firsts = blocks.join(mixed, "anchor", "left_semi").select("anchor", "block", "n", "first.*")
    copies = seeds.join(firsts, ["anchor", "block", "key", "t", "s0"]).drop_duplicates(["key", "t", "s0"])
    opened = keep(copies.select(*row, "s0", "n", F.posexplode("windows").alias("i", "window")), "opened")
    shared = keep(opened.groupBy("window").agg(F.count("*").alias("m")).where("m > 1").select("window"), "shared")
    single = opened.where("n = 1").join(shared, "window", "left_semi").select(*row, (F.col("s0") + F.col("i")).alias("a"))
    spans = spans.unionByName(single.select(*row, F.struct("a", F.col("a").alias("b")).alias("span")))
    gone = keep(spans.groupBy(*row).agg(F.collect_set("span").alias("spans")), "spans")
    cut = candidates.join(gone, row).select("key", "text", "t", "spans").mapInArrow(_cut(length), "key long, t long, n_removed long, kept_text string")
    cut = cut.withColumn("cut_sha256", F.sha2("kept_text", 256))
    cut = keep((cut if text else cut.drop("kept_text")).drop_duplicates(row), "kept")
    for table in (repeated, hits, seeds, blocks, mixed, opened, shared, gone):
        forget(table)

    return sketches.select("doc_id", *row, "n_words", "kept_sha256"), cut


def dedup_substrings(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one space).

    Words are runs without ASCII white space. Every word is removed that a window of ``length`` consecutive
    words covers whose words also start anywhere else, in the same text too; windows are judged on the input.
    Null, empty and short texts lose nothing. Rows that repeat, with one id or several, repeat each other's
    windows. Ids may be null or shared by several texts. Other columns are not read.
    """
    rows, cut = _find(docs, length, False, id_col, text_col)
    return rows.join(cut, ["key", "t"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns; a text that loses words becomes the words left, joined by one space. No row is
    dropped."""
    _, cut = _find(docs, length, True, id_col, text_col)
    cut = cut.selectExpr("key AS cut_key", "t AS cut_t", "kept_text")
    keyed = _keyed(docs, id_col, text_col, F.struct(*docs.columns).alias("row"))
    joined = keyed.join(cut, (F.col("key") == F.col("cut_key")) & (F.col("t") == F.col("cut_t")), "left")
    return joined.withColumn("row", F.col("row").withField(text_col, F.coalesce("kept_text", f"row.{text_col}"))).select("row.*")
