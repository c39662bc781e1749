"""Whitening of embeddings by a mixed-precision eigensolver.

Entries become whole numbers, each distinct vector counts once, and the covariance of these vectors is made in Spark: sums of
whole numbers first, then products of the centred entries, both summed in tasks before they are shuffled. Only the d x d
covariance comes to the driver. There float32 eigenvectors are corrected by the iteration of Ogita and Aishima ("Iterative
refinement for symmetric eigenvalue decomposition", 2018), which is matrix products in higher precision and converges
quadratically. Eigenvalues too close to be told apart at the present accuracy are a cluster: its part of the covariance, shifted by the
cluster's mean and so of a size of its own, is solved in the same way (their second paper, 2019). The projection goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.store import keep

SCALE, SHIFT = 64, 1_000_000
#: A scaled entry beyond this counts as this.
LARGEST = 1 << 40
#: Numbers that a step inside a task holds at once.
BLOCK = 1 << 20
#: Corrections of one matrix, and levels of clusters within clusters.
ROUNDS, LEVELS = 20, 8

_HIGH = np.longdouble


def finite_rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the lists that have ``size`` entries, none of them null or not finite."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    flat = column.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)  # null: not a number
    good = np.isfinite(flat).all(axis=1)
    return np.flatnonzero(fits.to_numpy(zero_copy_only=False))[good], flat[good]


def whole(values: np.ndarray, scale: int, largest: int) -> np.ndarray:
    """floor(scale * value) as int64, held within +-largest."""
    return np.clip(np.floor(scale * values), -largest, largest).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The same rows, few enough at once that ``width`` numbers a row stay under BLOCK."""
    rows = max(1, BLOCK // max(1, width))
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    """A column of null-free lists of ``size`` long entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def lists_of(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def commonest_size(rows: DataFrame, vec_col: str) -> int:
    """The number of entries that most vectors have (ties: the larger); 0 without any."""
    sizes = rows.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("size")).agg(F.count("*").alias("n")).where("size > 0")
    found = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return found[0]["size"] if found else 0


# --- eigenvectors -----------------------------------------------------------------------------------------------------------


def _clusters(values: np.ndarray, delta: float) -> list[np.ndarray]:
    """Places of neighbouring values that are no more than delta apart, two or more together."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > delta) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def eigenpairs(matrix: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns) of a symmetric matrix, in extended precision, in no order.

    Where eigenvalues are equal to working precision, their vectors are some orthonormal basis of the space they share."""
    a = matrix.astype(_HIGH)
    size, scale = len(a), np.abs(matrix).max(initial=0)
    one = np.eye(size, dtype=_HIGH)
    if scale == 0:
        return np.zeros(size, _HIGH), one
    x = np.linalg.eigh((a / scale).astype(np.float32))[1].astype(_HIGH)
    weight, rest = np.linalg.norm(a.astype(np.float64)), np.inf
    tiny = np.finfo(_HIGH).eps * weight * size
    for step in range(ROUNDS):
        r, s = one - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        delta = 2 * (np.sqrt((off * off).sum()) + weight * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > delta
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        solved = False
        if step and level < LEVELS:  # from the second step on the columns are orthogonal enough for a part to stand for itself
            for part in _clusters(values, float(delta)):
                own = x[:, part]
                inner = own.T @ (a @ own) - values[part].mean() * (own.T @ own)
                if np.abs(inner - np.diag(np.diag(inner))).max() > tiny:
                    x[:, part] = own @ eigenpairs((inner + inner.T) / 2, level + 1)[1]
                    solved = True
        change = np.abs(e).max()
        square = np.abs(r).max() <= 8 * size * np.finfo(_HIGH).eps
        if not solved and square and step > 1 and (change <= np.finfo(_HIGH).eps or change >= rest / 2):
            break
        rest = np.inf if solved else change
    for _ in range(2):  # what the last step has left
        x = x + x @ ((one - x.T @ x) / 2)
    return ((x.T @ a) * x.T).sum(axis=1), x


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit vectors as columns, in double precision; a vector's largest entry is positive."""
    values, vectors = eigenpairs(covariance)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values[order].astype(np.float64), (vectors * np.where(signs == 0, 1, signs)).astype(np.float64)


# --- distributed sums -------------------------------------------------------------------------------------------------------


def _quantise(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size):
            at, values = finite_rows(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists_of(whole(values, SCALE, LARGEST) + SHIFT)], names=["vec_id", "x"])

    return run


def _totals(size: int) -> Callable:
    """Rows (j, n, total): what a task's vectors add up to, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, dtype=object)
        for batch in slices(batches, size):
            x = matrix_of(batch.column(0), size)
            n, total = n + len(x), total + x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)), pa.array([*total], pa.decimal128(38))], names=["j", "n", "total"])

    return run


def _products(size: int, made: Callable[[np.ndarray], np.ndarray], width: int) -> Callable:
    """Rows (i, j, v), i <= j: sums over a task's vectors of the products of two of their ``width`` made numbers; j = width holds the
    sums of the numbers themselves."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, total, n = np.zeros((width, width)), np.zeros(width), 0
        for batch in slices(batches, size):
            z = made(matrix_of(batch.column(0), size))
            square, total, n = square + z.T @ z, total + z.sum(axis=0), n + len(z)
        if n:
            i, j = (np.concatenate(p).astype(np.int32) for p in ((upper[0], np.arange(width)), (upper[1], np.full(width, width))))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate((square[upper], total)))], names=["i", "j", "v"])

    return run


def _covariance(fit: DataFrame, n: int, size: int, made: Callable, width: int) -> np.ndarray:
    """Covariance (divisor n) of the made numbers; width * (width + 3) / 2 sums come to the driver."""
    rows = fit.mapInArrow(_products(size, made, width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    square, mean = np.zeros((width, width)), np.zeros(width)
    for i, j, v in rows:
        if j == width:
            mean[i] = v / n
        else:
            square[i, j] = square[j, i] = v / n
    return square - np.outer(mean, mean)  # the numbers are centred already: what is taken away is rounding


def _project(size: int, n: int, centre: np.ndarray, over: np.ndarray, projection: np.ndarray, known: np.ndarray, explained: list, error: float) -> Callable:
    """centre + over / n is the mean; unknown components get a null."""
    k = projection.shape[1]

    def deviations(y: np.ndarray) -> pa.Array:
        if size * ((int(np.abs(y).max(initial=0)) + 1) * n) ** 2 < 1 << 63:
            return pa.array(((n * y - over) ** 2).sum(axis=1))
        exact = ((n * y.astype(object) - over.astype(object)) ** 2).sum(axis=1)
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(size, 8 * k)):
            y = matrix_of(batch.column(1), size) - centre
            rows = np.repeat(np.arange(len(y)), k)
            white = pa.array(((y - over / n) @ projection).ravel(), mask=np.tile(~known, len(y)))
            columns = [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(rows), n)), deviations(y).take(pa.array(rows)), white, pa.array(explained * len(y), pa.float64()), pa.array(np.full(len(rows), error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(rows: DataFrame, components: int = 16, dimensions: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, hold null or non-finite entries, or have another number of entries than ``dimensions`` (None: the number
    that most vectors have) are left out. An entry c becomes x = floor(64 * c) + 1000000, with 64 * c held within 2**40. Means S / n and the
    covariance V are over the n distinct vectors x; components are the unit eigenvectors of V by falling eigenvalue e, up to
    ``components`` or the number of entries. whitened is (x - S / n) on the component over sqrt(e); deviation is the sum of (n * x - S)**2, exact, null
    where it is no long; explained is e / trace(V); identity_error is the largest entry of the whitened fit vectors' covariance minus the
    identity, measured over them.

    Components without variance (e at most d * 2**-52 of the largest) have whitened null and are not part of identity_error, which is 0 if
    there is none; if V is zero, explained is null. Rows that repeat and null ids come back as they are. An empty table, or one without a
    vector that counts, gives no rows. Other columns are not read. The driver holds d * d numbers, in extended precision where the machine has it.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    size = commonest_size(rows, vec_col) if dimensions is None else dimensions
    if not size:
        return spark.createDataFrame([], schema)
    quantised = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vector")).mapInArrow(_quantise(size), f"vec_id {kind}, x array<long>")
    fit = keep(quantised.select("x").distinct(), "fit")
    sums = fit.mapInArrow(_totals(size), "j int, n long, total decimal(38,0)").groupBy("j").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("j").collect()
    if not sums:
        return spark.createDataFrame([], schema)
    n = sums[0]["n"]
    parts = [divmod(int(r["total"]), n) for r in sums]
    centre, over = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    covariance = _covariance(fit, n, size, lambda x: (x - centre) - over / n, size)
    values, vectors = principal(covariance)
    k = min(components, size)
    known = values[:k] > max(values[0], 0) * size * np.finfo(np.float64).eps
    projection = vectors[:, :k] / np.sqrt(np.where(known, values[:k], 1))
    white = _covariance(fit, n, size, lambda x: ((x - centre) - over / n) @ projection, k)
    error = float(np.abs(white - np.eye(k))[np.ix_(known, known)].max(initial=0))
    trace = float(np.trace(covariance))
    explained = [float(v / trace) if trace > 0 else None for v in values[:k]]
    return quantised.mapInArrow(_project(size, n, centre, over, projection, known, explained, error), schema)
