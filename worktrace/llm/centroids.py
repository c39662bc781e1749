"""Centroid clustering with an incremental distance matrix, in whole numbers.

Every vector carries its exact dot product with every centroid in a table in the shared folder. When the centroids have moved, a
vector's product with one of them changes by its entries times the centroid's nonzero changes only; distances follow from the
products and the two squared lengths, and the least one is found anew. The sums of a cluster are made in tasks and added by
cluster and component, so that the driver sees centroids * dimensions numbers and no cluster is gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.store import forget, keep
from worktrace.llm.whitening import finite_rows, lists_of, matrix_of, slices, whole

SCALE = 64
#: A scaled component beyond this counts as this, so that a squared distance of 64 components is a long.
LARGEST = 1 << 27


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact x @ y of whole numbers: in floating point where no sum can pass 2**53."""
    if len(y) * int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    return x @ y


def _placed(ids: pa.Array, x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> pa.RecordBatch:
    """The table's rows: nearest centroid (ties: the smaller number) and squared distance beside the products."""
    distance = (x * x).sum(axis=1)[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)
    nearest = distance.argmin(axis=1)
    return pa.RecordBatch.from_arrays([ids, lists_of(x), lists_of(dots), pa.array(nearest.astype(np.int32)), pa.array(distance[np.arange(len(x)), nearest])], names=["vec_id", "x", "dots", "cluster", "distance"])


def _quantise(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size):
            at, values = finite_rows(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists_of(whole(values, SCALE, LARGEST))], names=["vec_id", "x"])

    return run


def _first(size: int, centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size + len(centroids)):
            x = matrix_of(batch.column(1), size)
            yield _placed(batch.column(0), x, _products(x, centroids.T), centroids)

    return run


def _moved(size: int, old: np.ndarray, new: np.ndarray) -> Callable:
    """The products after the centroids' moves, by their nonzero changes."""
    changes = [(c, np.flatnonzero(d), d[d != 0]) for c, d in enumerate(new - old) if d.any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size + len(new)):
            x, dots = matrix_of(batch.column(1), size), matrix_of(batch.column(2), len(new)).copy()
            for c, at, by in changes:
                dots[:, c] += _products(x[:, at], by)
            yield _placed(batch.column(0), x, dots, new)

    return run


def _sums(size: int, k: int) -> Callable:
    """Rows (cluster, j, total, n) of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in slices(batches, size):
            x, cluster = matrix_of(batch.column(0), size), batch.column(1).to_numpy()
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(axis=0)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, size).astype(np.int32)), pa.array(np.tile(np.arange(size, dtype=np.int32), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(n[used], size))], names=["cluster", "j", "total", "n"])

    return run


def cluster_centroids(rows: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another number of components than ``dimensions``, or hold null or non-finite ones are left out. A
    component x becomes floor(64 * x), held within 2**27. The first centroids are the k vectors with the least hexadecimal SHA-256 of
    ``1:<vec_id>`` (a null id: ``1:``; ties by the vector), in that order; with fewer vectors there are fewer centroids. Each round
    puts every vector to the nearest centroid (ties: the smaller number) and moves each centroid that has vectors to the floor of their mean; in
    the end the vectors are placed once more. distance is squared, cluster_inertia and inertia are its sums over the cluster and over
    all (null beyond a long), centroid_sha256 is of the final centroid's components joined by commas.

    Rows that repeat count and come back as often as they occur. An empty table gives no rows. Other columns are not read.
    """
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    quantised = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vector")).mapInArrow(_quantise(dimensions), f"vec_id {kind}, x array<long>")
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = quantised.select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in first], dtype=np.int64)
    schema = f"vec_id {kind}, x array<long>, dots array<long>, cluster int, distance long"
    table = keep(quantised.mapInArrow(_first(dimensions, centroids), schema), "dots")
    for _ in range(rounds):
        sums = table.select("x", "cluster").mapInArrow(_sums(dimensions, len(centroids)), "cluster int, j int, total long, n long")
        new = centroids.copy()
        for r in sums.groupBy("cluster", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            new[r["cluster"], r["j"]] = r["total"] // r["n"]
        if (new == centroids).all():  # nothing moves any more
            break
        after = keep(table.mapInArrow(_moved(dimensions, centroids, new), schema), "dots")
        forget(table)
        table, centroids = after, new
    inertia = {r["cluster"]: int(r["s"]) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    known = lambda v: v if v < 1 << 63 else None
    info = [(c, known(v), known(total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, v in inertia.items()]
    told = spark.createDataFrame(info, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # one row a centroid
    return table.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
