"""K-d tree sharding by distributed weighted medians.

The rows are points: size in bytes, the text's CRC-32 and whatever further integer columns are given. A node is
split at the weighted median (weight: bytes) of its widest dimension, until there are as many leaves as shards
or the leaves reach the target bytes. A level is one pass: every node's histogram over its current interval is
aggregated by Spark, and the interval around the median is narrowed (HISTOGRAM bins at a time) until it holds
one value. What reaches the driver is HISTOGRAM numbers a node, whatever the number of rows.

Rows with one value in the cut dimension stay together as long as the halves then differ by less than
TOLERANCE of the node; a larger group is cut by doc_id (and then by the rows' places).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm.store import forget, keep

HISTOGRAM = 2048
#: Part of a node's bytes by which its halves may differ to keep rows of one value together.
TOLERANCE = 0.001
#: Rows that one task numbers when slots are dealt.
SLOT_ROWS = 1_000_000


@dataclass
class _Cut:
    """State of one node's search: which share of its bytes goes left, and the interval that holds the cut."""

    node: int
    share: float
    dim: str = ""
    lo: int = 0
    hi: int = 0
    total: int = 0
    below: int = 0  # bytes left of the interval
    fixed: list[tuple[str, int]] = field(default_factory=list)  # dimensions already held at one value


def _widest(bounds, whole, dims: list[str]) -> str:
    """The dimension with the largest part of its whole range inside the node."""
    spread = lambda d: (bounds[f"hi_{d}"] - bounds[f"lo_{d}"]) / max(1, whole[f"hi_{d}"] - whole[f"lo_{d}"])
    return max(dims, key=lambda d: (spread(d), -dims.index(d)))


def _bin(cut: _Cut) -> Column:
    """Number of the interval's bin, computed with whole numbers."""
    width = (cut.hi - cut.lo) // HISTOGRAM + 1
    return F.floor((F.col(cut.dim) - F.lit(cut.lo)) / F.lit(width)).cast("long")


def _inside(cut: _Cut) -> Column:
    out = (F.col("node") == cut.node) & F.col(cut.dim).between(cut.lo, cut.hi)
    for d, v in cut.fixed:
        out &= F.col(d) == v
    return out


def _left(cut: _Cut, include: bool) -> Column:
    """Rows that go left: those before the cut value; with ``include`` also those at it."""
    out = (F.col(cut.dim) <= cut.lo) if include else (F.col(cut.dim) < cut.lo)
    for d, v in reversed(cut.fixed):
        out = (F.col(d) < v) | ((F.col(d) == v) & out)
    return out


def _cuts(points: DataFrame, nodes: dict[int, float], dims: list[str]) -> dict[int, Column]:
    """For each node a condition for its left half. Ties go on to the dimensions tie_id and tie_row."""
    every = [*dims, "tie_id", "tie_row"]
    ends = [f(d).alias(f"{n}_{d}") for d in every for n, f in (("lo", F.min), ("hi", F.max))]
    rows = {r["node"]: r for r in points.where(F.col("node").isin(list(nodes))).groupBy("node").agg(F.sum("size").alias("total"), *ends).collect()}
    whole = {f"{n}_{d}": f((r[f"{n}_{d}"] for r in rows.values()), default=0) for d in every for n, f in (("lo", min), ("hi", max))}
    open_, out = [], {}
    for node, share in nodes.items():
        if node in rows:
            r = rows[node]
            dim = _widest(r, whole, dims)
            open_.append(_Cut(node, share, dim, r[f"lo_{dim}"], r[f"hi_{dim}"], r["total"]))
        else:
            out[node] = F.lit(True)
    while open_:
        which, number = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, cut in enumerate(open_):
            here = _inside(cut)
            which, number = F.when(here, i).otherwise(which), F.when(here, _bin(cut)).otherwise(number)
        sums: dict[int, dict[int, int]] = {}
        for r in points.select(which.alias("i"), number.alias("b"), "size").where("i IS NOT NULL").groupBy("i", "b").agg(F.sum("size").alias("s")).collect():
            sums.setdefault(r["i"], {})[r["b"]] = r["s"]
        again = []
        for i, cut in enumerate(open_):
            goal, width = cut.share * cut.total, (cut.hi - cut.lo) // HISTOGRAM + 1
            hist = sorted(sums.get(i, {}).items())
            for b, s in hist:
                if cut.below + s >= goal or b == hist[-1][0]:
                    break
                cut.below += s
            if width > 1:
                cut.lo, cut.hi = cut.lo + b * width, min(cut.hi, cut.lo + (b + 1) * width - 1)
                again.append(cut)
                continue
            value = cut.lo + b
            cut.lo = cut.hi = value
            short, over = goal - cut.below, cut.below + s - goal
            depth = every.index(cut.dim) if cut.dim in ("tie_id", "tie_row") else -1
            if min(short, over) <= TOLERANCE * cut.total or cut.dim == "tie_row":
                out[cut.node] = _left(cut, include=over <= short)
            else:  # a large group of equal values: cut inside it
                cut.fixed.append((cut.dim, value))
                cut.dim = "tie_row" if depth >= 0 else "tie_id"
                cut.lo, cut.hi = rows[cut.node][f"lo_{cut.dim}"], rows[cut.node][f"hi_{cut.dim}"]
                again.append(cut)
        open_ = again
    return out


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus 1. Give the number of shards or the bytes that a shard
    should have. ``dims`` names further integer columns to split by. Shards have nearly equal bytes; rows with
    equal texts share a shard unless their group is too large for that. slot numbers a shard's rows from 0
    without gaps, by doc_id. Null ids come first; rows that repeat are told apart by their place in the table.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    points = docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(F.coalesce(F.col(d).cast("long"), F.lit(0)).alias(f"dim_{d}") for d in dims),
    )
    names = ["size", "text_crc32", *(f"dim_{d}" for d in dims)]
    points = points.withColumns({"tie_id": F.coalesce("doc_id", F.lit(-(1 << 62))), "tie_row": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40))})
    points = keep(points, "points")
    total = points.agg(F.sum("size")).first()[0] or 0
    wanted = shards or max(1, -(-total // (target_bytes or (128 << 20))))
    # a node is the first of the shards below it; wide[node] is how many those are
    wide, points = {0: wanted}, points.withColumn("node", F.lit(0))
    while splitting := {n: w for n, w in wide.items() if w > 1}:
        cuts = _cuts(points, {n: (w // 2) / w for n, w in splitting.items()}, names)
        node = F.col("node")
        for n, w in splitting.items():
            node = F.when((F.col("node") == n) & ~cuts[n], n + w // 2).otherwise(node)
            wide[n], wide[n + w // 2] = w // 2, w - w // 2
        points = points.withColumn("node", node)
    return _slots(points.select("doc_id", "size", "text_crc32", "tie_id", "tie_row", F.col("node").cast("int").alias("shard")))


def _slots(dealt: DataFrame) -> DataFrame:
    """Number each shard's rows from 0 in order of id: rows go to ranges of (shard, id), each range is numbered
    by itself, and the rows of the earlier ranges of its shard are added."""
    rows = dealt.count()
    order = ["shard", "tie_id", "tie_row"]
    ranged = dealt.repartitionByRange(max(1, -(-rows // SLOT_ROWS), dealt.sparkSession.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    # monotonically_increasing_id: the range's number in the high bits, the row's place in the low 33
    placed = keep(ranged.withColumn("at", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("part", part).withColumn("place", place)
    counts = sorted(tuple(r) for r in placed.groupBy("shard", "part").agg(F.count("*"), F.min("place")).collect())
    before: dict[int, int] = {}
    offsets = []
    for shard, number, n, first in counts:
        offsets.append((shard, number, before.get(shard, 0) - first))
        before[shard] = before.get(shard, 0) + n
    table = dealt.sparkSession.createDataFrame(offsets, "shard int, part long, offset long")
    return placed.join(F.broadcast(table), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("offset")).alias("slot"))
