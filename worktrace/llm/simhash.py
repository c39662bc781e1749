"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Two fingerprints within ``RADIUS`` = 4 bits have a variant in common that is within 2 bits of both. So every distinct fingerprint emits
all its 1 + 64 + 2016 variants within half the radius, variants are shuffled, and fingerprints that meet at a variant are
verified and linked. Variants are shuffled by ``g`` of their bits, those in which the fingerprints are most evenly divided. Of one fingerprint's
variants, many go to one place (all 2081 to 37 places for g = 8); they travel packed, as the fingerprint itself, and are unpacked there, so that
a fingerprint costs 8 * (1 + g + g * (g - 1) / 2) bytes instead of 20,000. What meets at one variant is linked to its least
member, never pair by pair: all of it is within the radius of each other. A task sends on its links as the stars of what they connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.components import components
from worktrace.llm.store import forget, keep
from worktrace.llm.text import SPACED, Words, chunks, words_of

BITS, RADIUS, SEED = 64, 4, 42
#: Shingles whose bits are counted at once, fingerprints sent on at once, and variants unpacked at once.
SHINGLES, STEP, UNPACKED = 1 << 16, 1 << 14, 1 << 21
#: Bits by which variants are shuffled, at least, and fingerprints that one place receives on average, at most.
LEAST_BITS, PLACE = 8, 1 << 21


def flips(bits: list[int], radius: int = RADIUS // 2) -> np.ndarray:
    """Every choice of at most ``radius`` (0, 1 or 2) of the bits, as a number, none first."""
    one = np.uint64(1) << np.array(bits, dtype=np.uint64)
    i, j = np.triu_indices(len(bits), 1)
    return np.concatenate([np.zeros(1, np.uint64), one, one[i] ^ one[j]][: radius + 1])


def _spaced(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins and ends."""
    buf, inside = words.buf.copy(), np.zeros(len(words.buf) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    marked = np.cumsum(inside[:-1]).astype(bool)
    buf[words.ends], marked[words.ends] = 0x20, True
    ends = np.cumsum(words.ends - words.starts + 1) - 1
    return buf[marked].tobytes(), ends - (words.ends - words.starts), ends


def fingerprints(column: pa.Array, k: int = 4) -> np.ndarray:
    """SimHash of each text over its k-word shingles, repeats included: a bit is 1 if set in over half of the XXH64 hashes."""
    words = words_of(column, SPACED, lower=True)
    raw, starts, ends = _spaced(words)
    counts, first = words.counts, words.off[:-1]
    many = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)  # shingles of each text
    last = np.minimum(k, np.maximum(counts, 1)) - 1  # from a shingle's first word to its last
    cum = np.concatenate(([0], np.cumsum(many)))
    ones = np.zeros((len(column), BITS), np.int64)
    shift = np.arange(BITS, dtype=np.uint64)
    for lo in range(0, int(cum[-1]), SHINGLES):
        at = np.arange(lo, min(lo + SHINGLES, int(cum[-1])))
        text = np.searchsorted(cum, at, side="right") - 1
        word = first[text] + at - cum[text]
        spans = zip(starts[word].tolist(), ends[word + last[text]].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in spans], dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.diff(text, prepend=-1))
        ones[text[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return ((2 * ones > many[:, None]).astype(np.uint64) << shift).sum(axis=1, dtype=np.uint64)


def _sketch(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), k).view(np.int64))], names=["doc_id", "fp"])

    return run


def _gathered(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of each number, side by side."""
    out = np.zeros(len(x), np.uint64)
    for k, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _spread(x: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for k, b in enumerate(bits):
        out |= ((x >> np.uint64(k)) & np.uint64(1)) << np.uint64(b)
    return out


def _emit(bits: list[int]) -> Callable:
    """Rows (place, fps): the fingerprints of a step that have variants with these ``bits``."""
    near = flips(list(range(len(bits))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(all_fps), STEP):
                fps = all_fps[lo : lo + STEP]
                place = (_gathered(fps, bits)[:, None] ^ near).ravel()
                order = np.argsort(place, kind="stable")
                ordered = place[order]
                begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                edges = 8 * np.append(begin, len(order)).astype(np.int64)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(fps[order // len(near)])])
                yield pa.RecordBatch.from_arrays([pa.array(ordered[begin].astype(np.int32)), packed.cast(pa.binary())], names=["place", "fps"])

    return run


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (node, least node connected with it), for all nodes but the least ones."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        before, least = top.copy(), np.minimum(top[a], top[b])
        for end in (top[a], top[b]):
            np.minimum.at(top, end, least)
        while (top[top] != top).any():
            top = top[top]
        if (top == before).all():
            break
    moved = top != np.arange(len(nodes))
    return nodes[moved], nodes[top[moved]]


#: Numbers that cut variants into slices: a slice is given by the parities of the bits that a variant shares with them.
_PARITIES = [(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) for k in range(20)]


def _slice_of(x: np.ndarray, r: int) -> np.ndarray:
    """A number of r bits; that of x ^ y is the one of x ^ the one of y."""
    out = np.zeros(len(x), np.int64)
    for k in range(r):
        out |= (np.bitwise_count(x & np.uint64(_PARITIES[k])).astype(np.int64) & 1) << k
    return out


def _unpacked(place: int, fps: np.ndarray, bits: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variants, number of their fingerprint) of one place, slice by slice: what meets is in one slice."""
    rest = [b for b in range(BITS) if b not in bits]
    own = _gathered(fps, bits) ^ np.uint64(place)
    base, used = fps ^ _spread(own, bits), np.bitwise_count(own)
    kinds = [(np.flatnonzero(used == w), flips(rest, RADIUS // 2 - w)) for w in range(RADIUS // 2 + 1)]
    r = min(len(_PARITIES), (sum(len(at) * len(m) for at, m in kinds) // UNPACKED).bit_length())
    sliced = [(at, _slice_of(base[at], r), m, _slice_of(m, r)) for at, m in kinds]
    for s in range(1 << r):
        variants, owners = [], []
        for at, of_base, masks, of_mask in sliced:
            for a in np.unique(of_base):
                one, two = at[of_base == a], masks[of_mask == a ^ s]
                variants.append((base[one][:, None] ^ two).ravel())
                owners.append(np.repeat(one, len(two)))
        yield np.concatenate(variants), np.concatenate(owners)


def _meet(bits: list[int]) -> Callable:
    """Links among the fingerprints that meet at the variants of one place."""

    def run(table: pa.Table) -> pa.Table:
        fps = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("fps")])
        found = [np.zeros((0, 2), np.uint64)]
        for variants, owners in _unpacked(table.column("place")[0].as_py(), fps, bits):
            order = np.argsort(variants)
            variants = variants[order]
            same = np.flatnonzero(variants[1:] == variants[:-1])
            together = np.zeros(len(order), bool)
            together[same] = together[same + 1] = True
            met, ordered = fps[owners[order[together]]], variants[together]
            if len(met):
                begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                least = np.repeat(np.minimum.reduceat(met, begin), np.diff(np.append(begin, len(met))))
                pairs = np.unique(np.column_stack((least, met))[least != met], axis=0)
                found.append(pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS])
        pairs = np.concatenate(found)
        u, v = stars(pairs[:, 0], pairs[:, 1])
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return run


def near_links(fps: DataFrame, n: int) -> DataFrame:
    """Distinct fingerprints (fp), n of them -> links (u, v) that connect what is within the radius, and nothing else."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ones = fps.agg(*(F.sum(F.shiftright("fp", b).bitwiseAND(1)).alias(f"b{b}") for b in range(BITS))).first()
    even = sorted(range(BITS), key=lambda b: (abs(2 * (ones[b] or 0) - n), b))
    g = max(LEAST_BITS, (2 * parts - 1).bit_length())
    while g < 24 and n * (1 + g + g * (g - 1) // 2) > PLACE << g:
        g += 1
    bits = even[: min(g, 24)]
    spread = fps.repartition(max(parts, n // 1_000_000), "fp")
    return spread.mapInArrow(_emit(bits), "place int, fps binary").groupBy("place").applyInArrow(_meet(bits), "u long, v long")


def simhash_components(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; the fingerprint is over the k-word shingles, repeats included (with fewer
    words: the whole sequence). Texts that are null, empty or blank have fingerprint zero. Fingerprints link at 4 or fewer differing
    bits, zero like any other; component_id is the least id reachable, the row's own included. Equal fingerprints are one node, whatever
    their number. Rows with equal ids are versions of one document, which links where one of them does; each comes back. A row with a null id
    has its fingerprint and a null component_id and links nothing. An empty table gives no rows. Ids are cast to long; other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = keep(source.mapInArrow(_sketch(k), "doc_id long, fp long"), "simhash")
    classes = keep(sketches.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    spread = sketches.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id", "lo")
    versions = sketches.join(spread, "doc_id").where("fp <> lo").selectExpr("lo AS u", "fp AS v")
    links = keep(near_links(classes.select("fp"), classes.count()).unionAll(versions).distinct(), "links")
    found = keep(components(links), "components")
    placed = classes.join(found.withColumnRenamed("id", "fp"), "fp").select("fp", "rep", "component")
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    named = keep(placed.join(least, "component").select("fp", "least"), "named")
    resolved = keep(classes.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "resolved")
    for table in (classes, links, found, named):
        forget(table)
    out = sketches.join(resolved, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own.alias("component_id"))
