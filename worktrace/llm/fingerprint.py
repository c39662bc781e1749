"""Document fingerprints: improbable-feature digests (after Roussev's similarity digests).

Every window of WINDOW bytes is ranked by how rare its entropy is: the farther from the entropy that running
text typically has, the rarer. In each run of RUN consecutive windows the rarest one (leftmost on a tie) gets a
vote; windows with VOTES votes are the features, or the one with most votes (leftmost on a tie) where none has as many. Their hashes go into Bloom filters of FILTER_BITS bits, five bits a feature;
after PER_FILTER features the next filter of the chain begins. Two digests are compared by the overlap of their
filters' bits, normalised by what chance would give.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.text import CHUNK_BYTES, buffer_of, ranges, slice_hashes

WINDOW, RUN, VOTES = 64, 64, 16
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Entropy of a window of running text, in bits: the least rare.
TYPICAL = 4.2
#: Text of one range of ids, on average.
RANGE_BYTES = 64 << 20
#: Windows that are slid over in one lane.
_LANE = 256

_COUNT = np.arange(WINDOW + 1, dtype=np.float64)
_TERM = (_COUNT * np.log2(np.maximum(_COUNT, 1))).astype(np.float32)


def entropies(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shannon entropy of the WINDOW bytes at each start. The starts come in stretches of consecutive positions; these
    are cut into lanes, and all lanes slide at once, each with its own byte counts."""
    out = np.empty(len(starts), dtype=np.float32)
    if not len(starts):
        return out
    new = np.concatenate(([True], np.diff(starts) != 1))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(starts)))
    lanes = -(-length // _LANE)
    inside = ranges(np.zeros(len(first), np.int64), lanes) * _LANE
    slot = np.repeat(first, lanes) + inside
    size = np.minimum(np.repeat(length, lanes) - inside, _LANE)
    order = np.argsort(-size, kind="stable")
    slot, size = slot[order], size[order]
    at = starts[slot]
    rows = np.arange(len(slot)) * 256
    counts = np.zeros(len(slot) * 256, dtype=np.uint8)
    for i in range(WINDOW):
        counts[rows + buf[at + i]] += 1
    total = _TERM[counts.reshape(-1, 256)].sum(axis=1)
    out[slot] = total
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")  # lanes with more than t windows
    for t in range(1, int(size[0])):
        n = int(live[t])
        rows, at, total = rows[:n], at[:n], total[:n]
        gone, come = rows + buf[at + t - 1], rows + buf[at + t + WINDOW - 1]
        c = counts[gone]
        total = total + (_TERM[c - 1] - _TERM[c])
        counts[gone] = c - 1
        c = counts[come]
        total = total + (_TERM[c + 1] - _TERM[c])
        counts[come] = c + 1
        out[slot[:n] + t] = total
    return np.float32(np.log2(WINDOW)) - out / np.float32(WINDOW)


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of each text in order of place, and where each text's begin. A text shorter than a window is one feature."""
    buf, base = buffer_of(column)
    size = np.diff(base) - 1
    n = len(size)
    windows = np.maximum(size - WINDOW + 1, 0)
    starts = ranges(base[:-1], windows)
    owner = np.repeat(np.arange(n), windows)
    # rarest first; quantised so that equal windows tie whatever was slid over before
    rarity = np.rint(np.abs(entropies(buf, starts) - np.float32(TYPICAL)) * 256).astype(np.int64)
    value = ((2048 - rarity) << 40) + np.arange(len(starts))
    least, width = value, 1
    while width < RUN:
        shift = np.minimum(np.arange(len(least)) + width, max(len(least) - 1, 0))
        least = np.minimum(least, least[shift])
        width *= 2
    first = np.concatenate(([0], np.cumsum(windows)))
    full = np.maximum(windows - RUN + 1, 0)
    chosen = [least[ranges(first[:-1], full)] & ((1 << 40) - 1)]
    small = np.flatnonzero((windows > 0) & (full == 0))
    chosen += [np.array([int(value[first[i] : first[i + 1]].min()) & ((1 << 40) - 1)], dtype=np.int64) for i in small]
    votes = np.bincount(np.concatenate(chosen), minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    reached = votes >= np.minimum(VOTES, np.maximum(full, 1))[owner]
    for i in np.flatnonzero((windows > 0) & (np.bincount(owner[reached], minlength=n) == 0)):  # the votes are split
        reached[first[i] + votes[first[i] : first[i + 1]].argmax()] = True
    picked = np.flatnonzero(reached)
    short = np.flatnonzero((windows == 0) & (size > 0))
    at = np.concatenate((starts[picked], base[:-1][short]))
    ends = np.concatenate((starts[picked] + WINDOW, base[1:][short] - 1))
    order = np.argsort(at, kind="stable")
    doc = np.concatenate((owner[picked], short))[order]
    return slice_hashes(buf, at[order], ends[order]), np.searchsorted(doc, np.arange(n + 1))


def digests(column: pa.Array) -> list[np.ndarray]:
    """The filter chain of each text: (filters, FILTER_BITS / 8) bytes."""
    hashes, off = _features(column)
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        own = hashes[a:b]
        own = own[np.sort(np.unique(own, return_index=True)[1])]  # a feature counts once
        filters = np.zeros((-(-len(own) // PER_FILTER), FILTER_BITS), dtype=bool)
        where = np.arange(len(own)) // PER_FILTER
        for k in range(HASHES):
            filters[where, ((own >> np.uint64(12 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        out.append(np.packbits(filters, axis=1))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean, over the filters of the shorter chain, of the best normalised overlap with the other's. Two empty
    digests are alike, an empty one is like no other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    x, y = a.view(np.uint64), b.view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    total = 0.0
    for i in range(len(x)):
        both = np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
        chance = nx[i] * ny / FILTER_BITS
        most = np.maximum(nx[i], ny) if len(x) == len(y) == 1 else np.minimum(nx[i], ny)
        total += nx[i] * float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / float(nx.sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: the digest of each row's text in base64; empty for a null or empty text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from worktrace.llm.text import chunks

        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([base64.b64encode(d.tobytes()).decode() for d in digests(batch.column(1))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


_NO_ID = -(1 << 63)


def _with_next(docs: DataFrame) -> DataFrame:
    """(bucket, key, guest, doc_id, text), in partitions that are sorted by the first three and hold whole buckets: ranges of ids.
    The last row of a bucket is a guest: the first row of the next one. Only ids are looked at to find the ranges; one shuffle moves the texts."""
    spark = docs.sparkSession
    keys = docs.select("key")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    cuts = sorted({float(x) for x in keys.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts)}) or [0.0]
    # a range's number, by a search among the cuts
    ranges_of = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="key_double", outputCol="bucket_double")
    numbered = lambda df: ranges_of.transform(df.withColumn("key_double", F.col("key").cast("double"))).withColumn("bucket", F.col("bucket_double").cast("int")).drop("key_double", "bucket_double")
    heads = {r["bucket"]: r["k"] for r in numbered(keys).groupBy("bucket").agg(F.min("key").alias("k")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first one's guest row goes to the last
    guests = spark.createDataFrame([(heads[b], before[b]) for b in order], "key long, host int")
    placed = numbered(docs).join(F.broadcast(guests), "key", "left")
    copies = F.when(F.col("host").isNull(), F.array(F.struct("bucket", F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest")))
    )
    rows = placed.select("key", "doc_id", "text", F.explode(copies).alias("at")).select("at.bucket", "key", "at.guest", "doc_id", "text")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "key", F.xxhash64("text"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, int | None, str]] = []
    size = 0

    def emit(rows: list[tuple[int, int, int | None, str]]) -> pa.RecordBatch:
        """Each row but the last against the row after it, which is in its bucket unless the row is a guest."""
        texts = [r[3] for r in rows]
        edited = []
        for text, after in zip(texts[:-1], texts[1:], strict=True):
            quarter = len(text) // 4
            edited.append(text[: len(text) - quarter] + after[:quarter])
        own, new = digests(pa.array(texts, pa.string())), digests(pa.array(edited, pa.string()))
        use = [i for i in range(len(rows) - 1) if not rows[i][1]]
        show = lambda d: base64.b64encode(d.tobytes()).decode()
        cols = [
            pa.array([rows[i][2] for i in use], pa.int64()),
            pa.array([len(texts[i]) for i in use], pa.int64()),
            pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in use], pa.string()),
            pa.array([show(own[i]) for i in use], pa.string()),
            pa.array([show(new[i]) for i in use], pa.string()),
            pa.array([likeness(own[i], new[i]) for i in use], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in use], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), (t or "" for t in batch.column(4).to_pylist()), strict=True):
            held.append(row)
            size += len(row[3])
            if size > CHUNK_BYTES // 2 and len(held) > 1:
                yield emit(held)
                held, size = held[-1:], len(held[-1][3])
    if len(held) > 1:
        yield emit(held)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next document in ascending doc_id; the first one follows the last. near_edited and near_next are the
    likeness to the edited text and to the next document. Null texts count as empty; null ids come before all
    others; rows with equal ids follow one another by a hash of their texts; a single row is its own next; an
    empty table gives no rows. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(_NO_ID)))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(source).mapInArrow(_compare, schema)
