"""MinHash near-deduplication with tensored banding.

Tables are keyed by pairs of half keys: from ``HALVES`` collections of ``ROWS`` minhashes each, every pair of
collections makes one table, so HALVES * ROWS = 32 minhashes serve HALVES * (HALVES - 1) / 2 = 120 tables of
four minhashes (Andoni and Indyk's tensoring). A pair of sets with similarity s shares a table unless fewer
than two of its half keys agree: at s = 0.8 that has a chance of 2.4e-6.

Work is done on distinct shingle sets: equal sets are one class with the least id as its representative. A
table's bucket is never expanded into pairs. Each document is first verified against the best pivot of its
buckets, then buckets whose members are not yet in one component against their best linked member (the hub).
Buckets that are still open form families by hub: what is outside a family's main component is compared with
the family, in blocks of bounded size through an inverted index, so that only links leave a task. As the answer
is the component, what is inside the main component is never compared with itself. Every link is confirmed on
the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm.components import components
from worktrace.llm.store import fits, forget, keep, semi_by_id
from worktrace.llm.text import SPACED, chunks, mix, ragged, ranges, sums, word_windows, words_of

HALVES, ROWS = 16, 2
#: Shingles and rows that one verification group holds besides its pivot's.
GROUP_SHINGLES, GROUP_ROWS = 200_000, 1024

_U = np.uint64
_SEEDS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (i << 40)) % (1 << 64) | 1 for i in range(1, HALVES * ROWS + 1)], dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted 64-bit hashes, and where each text's begin (n + 1).

    Words are lower-cased (A-Z) runs without ASCII white space. A text of fewer words is one shingle, a text
    without words none."""
    words = words_of(column, SPACED, lower=True)
    hashes, counts, n = words.hashes(), words.counts, len(column)
    _, doc, shingles = word_windows(hashes, words.off, k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([word_windows(hashes[words.off[i] : words.off[i + 1]], np.array([0, counts[i]]), int(counts[i]))[2][0] for i in short], dtype=np.uint64)
        doc, shingles = np.concatenate((doc, short)), np.concatenate((shingles, whole))
    order = np.lexsort((shingles, doc))
    doc, shingles = doc[order], shingles[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    return shingles[new], np.searchsorted(doc[new], np.arange(n + 1))


def half_keys(shingles: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, HALVES) keys, each of ROWS minhashes; texts without shingles have zeros."""
    full = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, HALVES), dtype=np.uint64)
    if len(full):
        for h in range(HALVES):
            key = np.zeros(len(full), dtype=np.uint64)
            for seed in _SEEDS[h * ROWS : (h + 1) * ROWS]:
                x = shingles * seed
                x ^= x >> _U(32)
                x *= _U(0xD6E8FEB86659FD93)
                key = mix(key * _U(31) + np.minimum.reduceat(x, off[:-1][full]))
            out[full, h] = key
    return out


_PAIRS = [(i, j) for i in range(HALVES) for j in range(i + 1, HALVES)]


def table_keys(halves: np.ndarray) -> np.ndarray:
    """(texts, tables): each pair of half keys, mixed with the table's number."""
    i, j = np.array(_PAIRS).T
    return mix(halves[:, i] * _U(0x9E3779B97F4A7C15) + mix(halves[:, j]) + np.arange(len(_PAIRS), dtype=np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            shingles, off = shingle_sets(batch.column(1), k)
            halves = half_keys(shingles, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(_signed(sums(shingles, off))), pa.array(_signed(sums(mix(shingles), off))), ragged(_signed(halves).ravel(), np.full(len(halves), HALVES), pa.int64())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "halves"],
            )

    return run


def _buckets(bits: int):
    """Rows (key, id, n). Keys are cut to ``bits`` bits, as a chance collision only adds a pair to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, HALVES)
            for lo in range(0, len(halves), 2048):
                keys = table_keys(halves[lo : lo + 2048]) >> _U(64 - bits)
                n = keys.shape[1]
                part = batch.slice(lo, 2048)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(keys.ravel())), pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(part.column(1).to_numpy(), n))],
                    names=["key", "id", "n"],
                )

    return run


def _confirm(k: int, percent: int):
    """Links of one group: rows (pivot, salt, is_pivot, id, text); the pivot's set against each member's."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_pivot = table.column("is_pivot").to_numpy()
        pivot_rows = table.filter(pa.array(is_pivot)).column("text")
        members = table.filter(pa.array(~is_pivot))
        if not len(pivot_rows) or not len(members):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        own, own_off = shingle_sets(pivot_rows.combine_chunks(), k)
        # rows of the pivot's id with different texts are different sets
        versions = list({own[a:b].tobytes(): own[a:b] for a, b in zip(own_off[:-1], own_off[1:], strict=True) if b > a}.values())
        pivot = table.column("pivot")[0].as_py()
        linked = [np.zeros(0, np.int64)]
        for batch in chunks(members.select(["id", "text"]).to_batches()):
            shingles, off = shingle_sets(batch.column(1), k)
            for base in versions:
                at = np.minimum(np.searchsorted(base, shingles), len(base) - 1)
                shared = sums((base[at] == shingles).astype(np.int64), off)
                union = len(base) + np.diff(off) - shared
                linked.append(batch.column(0).to_numpy()[(100 * shared >= percent * union) & (shared > 0)])
        v = np.unique(np.concatenate(linked))
        return pa.table({"u": pa.array(np.full(len(v), pivot), pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _parts(size: Column, rows: Column) -> Column:
    """Into how many groups so many shingles and rows go."""
    return F.greatest(F.ceil(size / GROUP_SHINGLES), F.ceil(rows / GROUP_ROWS), F.lit(1)).cast("int")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs(pivot, id, n) -> links(u, v) confirmed on full sets. The members of a large group are salted into
    several, each with its own copy of the pivot's text."""
    ids = keep(pairs.selectExpr("id AS doc_id").unionAll(pairs.selectExpr("pivot AS doc_id")).distinct(), "ids")
    texts = semi_by_id(docs, ids, ids.count(), "doc_id")
    parts = keep(pairs.groupBy("pivot").agg(_parts(F.sum("n"), F.count("*")).alias("parts")), "parts")
    salt = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    salted = pairs.join(parts, "pivot").select("pivot", salt.alias("salt"), F.lit(False).alias("is_pivot"), "id")
    pivots = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("is_pivot"), F.col("pivot").alias("id"))
    rows = salted.unionAll(pivots).join(texts.withColumnRenamed("doc_id", "id"), "id").select("pivot", "salt", "is_pivot", "id", "text")
    out = keep(rows.groupBy("pivot", "salt").applyInArrow(_confirm(k, percent), "u long, v long"), "confirmed")
    forget(ids)
    forget(parts)
    return out


def _confirm_block(k: int, percent: int):
    """Links of one block: rows (pivot, part, side, outside, id, text); each text outside against each one of the part."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        outside = table.column("outside").to_numpy()
        rows, others = table.filter(pa.array(~outside)), table.filter(pa.array(outside))
        u, v = [], []
        if len(rows) and len(others):
            ids, other_ids = rows.column("id").to_numpy(), others.column("id").to_numpy()
            shingles, off = shingle_sets(rows.column("text").combine_chunks(), k)
            size = np.diff(off)
            order = np.argsort(shingles, kind="stable")
            index, owner = shingles[order], np.repeat(np.arange(len(rows)), size)[order]
            own, own_off = shingle_sets(others.column("text").combine_chunks(), k)
            lo, hi = np.searchsorted(index, own), np.searchsorted(index, own, side="right")
            for i, (a, b) in enumerate(zip(own_off[:-1], own_off[1:], strict=True)):
                shared = np.bincount(owner[ranges(lo[a:b], hi[a:b] - lo[a:b])], minlength=len(rows))
                linked = ids[(100 * shared >= percent * (size + (b - a) - shared)) & (shared > 0)]
                linked = linked[linked != other_ids[i]]
                u.append(np.full(len(linked), other_ids[i]))
                v.append(linked)
        none = np.zeros(0, np.int64)
        return pa.table({"u": pa.array(np.concatenate([none, *u]), pa.int64()), "v": pa.array(np.concatenate([none, *v]), pa.int64())})

    return run


def _family_links(family: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """family(pivot, id, n, c) -> links(u, v) between what is outside a family's main component and all of the family. Both
    sides are dealt into parts of GROUP_SHINGLES and GROUP_ROWS; a group holds one part of each."""
    main = family.groupBy("pivot", "c").agg(F.count("*").alias("m")).groupBy("pivot").agg(F.max(F.struct("m", "c")).alias("main"), F.count("*").alias("comps")).where("comps > 1").selectExpr("pivot", "main.c AS main")
    main = keep(main, "main")
    marked = family.join(main, "pivot").select("pivot", "id", "n", (F.col("c") != F.col("main")).alias("outside"))
    sizes = keep(marked.groupBy("pivot").agg(_parts(F.sum("n"), F.count("*")).alias("parts"), _parts(F.sum(F.when(F.col("outside"), F.col("n"))), F.count_if("outside")).alias("sides")), "sizes")
    dealt = keep(marked.join(sizes, "pivot").withColumn("h", F.xxhash64("id")), "dealt")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = dealt.select("pivot", F.pmod("h", F.col("parts").cast("long")).cast("int").alias("part"), upto("sides").alias("side"), F.lit(False).alias("outside"), "id")
    others = dealt.where("outside").select("pivot", upto("parts").alias("part"), F.pmod("h", F.col("sides").cast("long")).cast("int").alias("side"), F.lit(True).alias("outside"), "id")
    ids = keep(dealt.select(F.col("id").alias("doc_id")).distinct(), "ids")
    texts = semi_by_id(docs, ids, ids.count(), "doc_id").withColumnRenamed("doc_id", "id")
    rows = inside.unionAll(others).join(texts, "id").select("pivot", "part", "side", "outside", "id", "text")
    out = keep(rows.groupBy("pivot", "part", "side").applyInArrow(_confirm_block(k, percent), "u long, v long"), "confirmed")
    for table in (dealt, ids, main, sizes):
        forget(table)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents link where the similarity of their sets of k-word shingles is at least percent / 100;
    component_id is the least id reachable (the id itself if none), kept says whether that is the row's own.
    Null, empty and blank texts have no shingles and link with nothing. Rows with equal ids are versions of
    one document, which links where one of them does; each comes back, and so do rows that repeat. A row with a
    null id stays alone: its component_id is null and it is kept. Ids are cast to long; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = source.where("doc_id IS NOT NULL AND text IS NOT NULL")
    sketches = keep(source.mapInArrow(_sketches(k), "doc_id long, n_shingles long, set_a long, set_b long, halves array<long>"), "sketches")
    sets = ["n_shingles", "set_a", "set_b"]
    # half keys follow from the set
    classes = keep(sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves")), "classes")
    n_reps = classes.count()
    # ids that repeat: with one set, its rows count once; with several, the classes of the id's versions belong together
    spread = [(F.min(c) < F.max(c)).alias(f"differ_{c}") for c in sets]
    several = keep(sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), *spread).where("rows > 1"), "several")
    versions = sketches.join(several.where(" OR ".join(f"differ_{c}" for c in sets)), "doc_id", "left_semi").join(classes, sets).where("rep <> doc_id").selectExpr("rep AS u", "doc_id AS v").distinct()
    if several.count():
        known = known.dropDuplicates(["doc_id", "text"])
    # enough partitions that the rows of the tables (120 a document) need no spill
    reps = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "halves").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_reps // 50_000), "doc_id")
    bits = min(63, 8 + (n_reps * len(_PAIRS)).bit_length())
    rows = reps.mapInArrow(_buckets(bits), "key long, id long, n long")
    # aggregates are written before they are joined: both sides of the join are then shuffled for it, and a hot key can be split
    shared = keep(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "shared")
    buckets = keep(rows.join(shared, "key").select("key", "id", "n"), "buckets")

    pivots = keep(buckets.groupBy("key").agg(F.min("id").alias("pivot")), "pivots")

    # 1: each document against the pivot that most of its buckets have
    best = buckets.join(pivots, "key").where("pivot <> id").groupBy("id", "n", "pivot").agg(F.count("*").alias("tables"))
    best = best.groupBy("id", "n").agg(F.max(F.struct("tables", F.negative("pivot").alias("p"))).alias("best"))
    tried = keep(best.selectExpr("-best.p AS pivot", "id", "n"), "pairs")
    links = _verified(tried, known, k, percent)
    found = keep(components(links.unionAll(versions)), "components")
    forget(several)

    def open_buckets(found: DataFrame) -> DataFrame:
        """Buckets whose members are in several components: (key, id, n, c)."""
        placed = buckets.join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
        split = keep(placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"), "split")
        return keep(placed.join(split, "key", "left_semi"), "open")

    def hubs(open_: DataFrame, links: DataFrame) -> DataFrame:
        """The member of each open bucket with the most links: (key, pivot, pc, pn)."""
        degree = links.unionAll(links.selectExpr("v AS u", "u AS v")).groupBy("u").agg(F.count("*").alias("degree"))
        ranked = open_.join(degree.withColumnRenamed("u", "id"), "id", "left")
        best = F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.negative("id").alias("p"), "c", "n")).alias("hub")
        return keep(ranked.groupBy("key").agg(best).selectExpr("key", "-hub.p AS pivot", "hub.c AS pc", "hub.n AS pn"), "hubs")

    # 2: open buckets against their hub
    open_ = open_buckets(found)
    pairs = open_.join(hubs(open_, links), "key").where(f"c <> pc AND 100 * least(n, pn) >= {percent} * greatest(n, pn)").select("pivot", "id", "n").distinct()
    second = keep(pairs.join(tried, ["pivot", "id"], "left_anti"), "pairs")
    links2 = _verified(second, known, k, percent)
    found2 = keep(components(found.selectExpr("id AS u", "component AS v").unionAll(links2)), "components")
    forget(open_)

    # 3: families that are still open
    open_ = open_buckets(found2)
    family = keep(open_.join(hubs(open_, links.unionAll(links2)), "key").select("pivot", "id", "n", "c").distinct(), "family")
    links3 = _family_links(family, known, k, percent)
    final = keep(components(found2.selectExpr("id AS u", "component AS v").unionAll(links3)), "components")
    for table in (open_, shared, pivots, buckets, tried, second, family, links, links2, links3, found, found2):
        forget(table)

    resolved = classes.drop("halves").join(final.withColumnRenamed("id", "rep"), "rep", "left").select(*sets, F.coalesce("component", "rep").alias("c"))
    out = sketches.drop("halves").join(resolved, sets, "left")
    own = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, but for those of documents that near_duplicates does not keep: of each group the
    document with the least id stays, as do rows without words or without an id."""
    found = near_duplicates(docs, k, percent, id_col, text_col)
    gone = keep(found.where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), "removed")
    return docs.join(F.broadcast(gone) if fits(gone.count()) else gone, id_col, "left_anti").select(*docs.columns)
