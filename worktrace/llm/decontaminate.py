"""Benchmark decontamination by an FM-index per shard of the training text.

Words of the benchmark are the index's alphabet; any other document word can be part of no test phrase and
separates runs. Runs shorter than the shortest phrase are left out. Each shard (a bounded slice of a task's
rows) is indexed where it is read: the test phrases are found by backward search through wavelet-tree ranks,
their places by sampled suffix positions, and the removal spans are merged per document. Nothing is shuffled;
the phrases travel by broadcast, in blocks of bounded size. With several blocks the rows are written after each but
the last, with the spans and items found so far, so only one block is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.fmindex import FMIndex
from worktrace.llm.store import forget, keep
from worktrace.llm.text import ALNUM, chunks, ragged, ranges, words_of

#: Benchmark text whose phrases are broadcast at once (about twenty times as many bytes); a larger benchmark is worked through in
#: several blocks.
BLOCK_BYTES = 4 << 20
#: Text that makes one shard. Its arrays and index take about fifty times as much.
SHARD_BYTES = 1 << 20


@dataclass
class Phrases:
    """Distinct windows of the benchmark's items."""

    words: np.ndarray  # sorted hashes; symbol k is words[k - 1]
    known: np.ndarray  # by the hash's high bits: whether a word of the benchmark may have them
    patterns: np.ndarray  # (windows, n), symbols, right-aligned
    lengths: np.ndarray
    owner: np.ndarray  # items of window w: owner[owner_off[w]:owner_off[w + 1]]
    owner_off: np.ndarray
    items: np.ndarray  # item ids as strings; one may be None

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.known[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), max(len(self.words) - 1, 0))
        hit = self.words[at] == hashes[maybe] if len(self.words) else np.zeros(0, bool)
        out[maybe[hit]] = at[hit] + 1
        return out


def _id_order(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def _phrases(items: list[tuple[str | None, str]], n: int) -> Phrases:
    words = words_of(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
    hashes = words.hashes()
    vocabulary, symbol = np.unique(hashes, return_inverse=True)
    rows, owner = [], []
    ids = sorted({i for i, _ in items}, key=_id_order)
    number = {i: k for k, i in enumerate(ids)}
    for (item, _), a, b in zip(items, words.off[:-1], words.off[1:], strict=True):
        own = symbol[a:b] + 1
        if len(own):
            width = min(n, len(own))
            windows = np.lib.stride_tricks.sliding_window_view(own, width)
            rows.append(np.pad(windows, ((0, 0), (n - width, 0))))
            owner.append(np.full(len(windows), number[item]))
    table = np.concatenate(rows) if rows else np.zeros((0, n), np.int64)
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    patterns, which = np.unique(table, axis=0, return_inverse=True)
    pairs = np.unique(np.stack((which.reshape(-1), owner), axis=1), axis=0)
    known = np.zeros(1 << 20, dtype=bool)
    known[vocabulary >> np.uint64(44)] = True
    return Phrases(vocabulary, known, patterns, (patterns > 0).sum(1), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), np.array(ids, dtype=object))


def _runs(symbols: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of known words of one document with at least so many: (first word, length)."""
    mark = np.zeros(len(symbols) + 1, dtype=np.int8)
    mark[:-1] = symbols > 0
    edge = np.diff(mark, prepend=0) != 0
    begin = np.zeros(len(symbols) + 1, dtype=bool)
    begin[off] = True
    cuts = np.flatnonzero(edge | begin)
    length = np.diff(np.append(cuts, len(symbols)))
    good = (mark[cuts] > 0) & (length >= least)
    return cuts[good], length[good]


def _occurrences(phrases: Phrases, symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in the shard."""
    least = int(phrases.lengths.min(initial=1 << 30))
    first, length = _runs(symbols, off, least)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.zeros(int(length.sum()) + len(first) + 1, dtype=np.int64)
    places = np.cumsum(length + 1) - length  # where each run begins in the indexed text
    source = np.zeros(len(text), dtype=np.int64)
    slots, words = ranges(places, length), ranges(first, length)
    text[slots], source[slots] = symbols[words], words
    index = FMIndex(text, len(phrases.words))
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    window = np.repeat(found, (hi - lo)[found])
    return window, source[index.locate(ranges(lo[found], (hi - lo)[found]))]


def _scan(phrases: Phrases, batch: pa.RecordBatch, clean: bool, before: list[pa.Array] | None = None) -> pa.RecordBatch:
    """before: span_starts, span_ends and items that other blocks of the benchmark gave these rows; they are merged in."""
    words = words_of(batch.column(1), ALNUM, lower=True)
    n_docs, total = batch.num_rows, len(words.starts)
    window, at = _occurrences(phrases, phrases.symbols(words.hashes()), words.off)
    cover = np.zeros(total + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[window], -1)
    if before is not None:
        base = np.repeat(words.off[:-1], np.asarray(pc.list_value_length(before[0]), dtype=np.int64))
        np.add.at(cover, base + np.asarray(before[0].flatten(), dtype=np.int64), 1)
        np.add.at(cover, base + np.asarray(before[1].flatten(), dtype=np.int64), -1)
    hit = np.cumsum(cover)[:-1] > 0
    doc = words.doc
    # merged spans: runs of hit words of one document
    begin = hit & ~(np.concatenate(([False], hit[:-1])) & np.concatenate(([False], doc[1:] == doc[:-1]))[: total or None])
    close = hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((doc[1:] == doc[:-1], [False]))[: total or None])
    s, e = np.flatnonzero(begin), np.flatnonzero(close)
    spans = np.bincount(doc[s], minlength=n_docs)
    # items
    owners = phrases.owner_off[window + 1] - phrases.owner_off[window]
    pairs = np.unique(np.stack((np.repeat(doc[at], owners), phrases.owner[ranges(phrases.owner_off[window], owners)])), axis=1)
    per_doc = np.bincount(pairs[0], minlength=n_docs)
    cols = [
        batch.column(0),
        pa.array(words.counts, pa.int64()),
        pa.array(np.bincount(doc[hit], minlength=n_docs), pa.int64()),
        ragged(s - words.off[doc[s]], spans, pa.int32()),
        ragged(e - words.off[doc[e]] + 1, spans, pa.int32()),
        ragged(phrases.items[pairs[1]], per_doc, pa.string()),
    ]
    if before is not None:
        cols[5] = pa.array([sorted({*old, *new}, key=_id_order) if old else new for old, new in zip(before[2].to_pylist(), cols[5].to_pylist(), strict=True)], pa.list_(pa.string()))
    names = ["doc_id", "n_words", "n_hit", "span_starts", "span_ends", "items"]
    if clean:
        kept = batch.column(1).to_pylist()
        first = np.searchsorted(doc[s], np.arange(n_docs + 1))
        for i in np.flatnonzero(spans):
            raw, base, parts, done = kept[i].encode(), int(words.base[i]), [], 0
            for a, b in zip(words.starts[s[first[i] : first[i + 1]]], words.ends[e[first[i] : first[i + 1]]], strict=True):
                parts.append(raw[done : a - base])
                done = b - base
            kept[i] = b"".join([*parts, raw[done:]]).decode()
        cols.append(pa.array(kept, pa.string()))
        names.append("clean_text")
    return pa.RecordBatch.from_arrays(cols, names=names)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items, gathered block by block; a block has BLOCK_BYTES on average."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


_FOUND = "array<int>", "array<int>", "array<string>"


def _all_but_last(docs: DataFrame, text_col: str, blocks: Iterator[list[tuple[str | None, str]]], n: int) -> tuple[DataFrame, list[str], Broadcast]:
    """docs, row by row, with three columns more (spans and items of all blocks but the last), their names, and the last
    block's phrases. With one block there are no such columns and nothing is run."""
    context, held, written = docs.sparkSession.sparkContext, next(blocks), None
    rows, names = docs, []
    for more in blocks:
        if not names:
            stem = "found"
            while any(c.lower().startswith(stem) for c in docs.columns):
                stem = f"_{stem}"
            names = [f"{stem}_{x}" for x in ("starts", "ends", "items")]
            rows = docs.withColumns({x: F.array().cast(kind) for x, kind in zip(names, _FOUND, strict=True)})
        shipped = context.broadcast(_phrases(held, n))
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shipped: Broadcast = shipped, at: int = at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(iter([batch]), text=at, limit=SHARD_BYTES, rows=1 << 16):
                    found = _scan_column(shipped.value, part, at, False)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-3], *found.columns[3:6]], names=part.schema.names)

        last, written = written, keep(rows.mapInArrow(run, rows.schema), "decontaminate")
        if last is not None:
            forget(last)
        shipped.destroy()
        rows, held = written, more
    return rows, names, context.broadcast(_phrases(held, n))


def _scan_column(phrases: Phrases, part: pa.RecordBatch, at: int, clean: bool, carried: bool = True) -> pa.RecordBatch:
    """_scan of the text in column ``at``; where ``carried``, the last three columns are what other blocks gave."""
    texts = part.column(at).cast(pa.string())
    return _scan(phrases, pa.RecordBatch.from_arrays([texts, texts], names=["doc_id", "text"]), clean, part.columns[-3:] if carried else None)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, clean: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, span_starts, span_ends (word spans [start, end), merged),
    items (ids, as strings, of the items with an occurring window); with ``clean`` also clean_text, the text
    without the spans (from a span's first word to its last).

    A window is n consecutive words of an item; an item of fewer words, but not none, is one window. A null or
    empty text has no words and no hits. Items with one id are one item; all that have no id are one too, whose id
    is null; a null item text has no words; an empty benchmark hits nothing. Repeated rows are scanned each,
    whatever their ids; ids are cast to long; other columns are not read. Whole texts are scanned, a text longer than
    SHARD_BYTES as a shard of its own.
    """
    schema = "doc_id long, n_words long, n_hit long, span_starts array<int>, span_ends array<int>, items array<string>" + ", clean_text string" * clean
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    rows, names, shipped = _all_but_last(source, "text", _blocks(benchmark, item_col, item_text_col), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=SHARD_BYTES, rows=1 << 16):
            yield _scan(shipped.value, batch, clean, batch.columns[2:] if names else None)

    return rows.mapInArrow(run, schema)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with the removal spans (see decontaminate) cut out of the text. No row is dropped, ids
    are not looked at, null texts stay null. No shuffle of docs."""
    rows, names, shipped = _all_but_last(docs, text_col, _blocks(benchmark, item_col, item_text_col), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in chunks(iter([batch]), text=at, limit=SHARD_BYTES, rows=1 << 16):
                clean = _scan_column(shipped.value, part, at, True, bool(names)).column("clean_text")
                part = part.set_column(at, text_col, clean)
                yield part.select(part.schema.names[:-3]) if names else part

    return rows.mapInArrow(run, docs.schema)
