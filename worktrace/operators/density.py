"""Density clusters of vectors: core points, border points and noise at any number of radii and least neighbourhoods (DBSCAN, Ester et al. 1996).

Equal vectors are one point with a weight, so copies are never compared. Points lie in the cells of a k-d tree over turned coordinates
(principal directions of a sample), cells are dealt into blocks, and only those pairs of blocks meet whose boxes are within the largest radius, with only the
points that are within it of the other's box. A task puts the rows of its two blocks into leaves of neighbours and compares only leaves whose boxes are within a radius, by
one matrix product in single precision; what its rounding leaves open is summed again. From it go counts, and for links those between parts that are connected
inside their blocks. Points with as many neighbours as any setting asks for are core in all of them: their parts are joined once for each radius, leaf by leaf, and rows that are of one
part already are not compared again. The others have few neighbours, so their links are taken one by one. All settings (radius, least weight) are columns of the same jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.operators.tables import dropped, written


def standard_vectors(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(kept columns, features): each column less its mean, over its deviation (divisor n). A null or NaN is the mean, a column without spread 0."""
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    stats = rows.agg(*(f(known[c]).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    value = lambda i, c: F.coalesce(known[c] - F.lit(stats[f"m{i}"]), F.lit(0.0)) / F.lit(stats[f"s{i}"])
    return rows.select(*keep, F.array(*(value(i, c) if stats[f"s{i}"] else F.lit(0.0) for i, c in enumerate(columns))).alias("features"))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all x to all y, some rows of x at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, 2_000_000 // max(1, y.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.sqrt(((x[i : i + step, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    return out


#: Rows of a leaf, and columns that a leaf is compared with at once.
LEAF, COLUMNS = 256, 4096


def _turn(x: np.ndarray) -> np.ndarray:
    """Orthogonal directions by falling spread of the rows; the columns themselves where numbers are too large to be turned."""
    if len(x) < 2 or not x.shape[1] or not np.abs(x).max() < 1e100:
        return np.eye(x.shape[1])
    return np.linalg.eigh(np.atleast_2d(np.cov(x, rowvar=False)))[1][:, ::-1]


def _split(z: np.ndarray, rows: np.ndarray) -> tuple[int, float, np.ndarray] | None:
    """(column of most spread, its middle, which rows are beyond it); None if all are equal."""
    with np.errstate(over="ignore", invalid="ignore"):
        c = int(np.nan_to_num(z[rows].var(axis=0), nan=np.inf).argmax())
    v = z[rows, c]
    at = np.partition(v, len(v) // 2)[len(v) // 2]
    beyond = v >= at
    if beyond.all():
        beyond = v > at
        if not beyond.any():
            return None
        at = v[beyond].min()
    return c, float(at), beyond


def _leaves(z: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows in leaves of at most ``most`` neighbours, halves of halves; more only where rows are equal."""
    todo, out = [np.arange(len(z))], []
    while todo:
        rows = todo.pop()
        cut = _split(z, rows) if len(rows) > most else None
        if cut is None:
            out.append(rows)
        else:
            todo += [rows[cut[2]], rows[~cut[2]]]
    return out


def _gaps(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances of boxes (one a row) from one box or, with low = high, a point each."""
    with np.errstate(over="ignore"):
        return np.sqrt((np.maximum(np.maximum(lo - high, low - hi), 0) ** 2).sum(axis=-1))


def _slack(r: float, size: float, columns: int) -> float:
    """A radius with what turning numbers of this size can add to a distance."""
    return r * (1 + 1e-9) + 64 * (columns + 1) * np.finfo(float).eps * size


def _dealt(points: DataFrame, reach: float, pivots: int, block: int) -> DataFrame:
    """(id, features, weight, block, to): each point with its block and the blocks in which it may be within ``reach`` of a point.

    Cells are a k-d tree over a sample by hash. The driver holds 64 points of the sample a cell, and one count and box per cell."""
    centre = np.array([r.features for r in points.orderBy(F.xxhash64("features"), "id").limit(64 * pivots).select("features").collect()])
    size = points.agg(F.max(F.array_max(F.transform("features", F.abs)))).first()[0] or 0.0
    turn = _turn(centre) if size < 1e100 else np.eye(centre.shape[1])
    z, cuts, open_, cells_ = centre @ turn, [], [(0, np.arange(len(centre)))], 1
    # cuts: (cell, column, at, new cell): rows of the cell at or beyond the cut go to the new one; the fullest cell is cut next
    while cells_ < pivots and open_:
        cell, rows = open_.pop(max(range(len(open_)), key=lambda i: len(open_[i][1])))
        cut = _split(z, rows) if len(rows) > 1 else None
        if cut is not None:
            cuts.append((cell, cut[0], cut[1], cells_))
            open_ += [(cell, rows[~cut[2]]), (cells_, rows[cut[2]])]
            cells_ += 1

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z, cell = np.stack(b.features) @ turn, np.zeros(len(b), dtype="int32")
                for old, c, at, new in cuts:
                    cell[(cell == old) & (z[:, c] >= at)] = new
                yield b.assign(cell=cell, turned=list(z))

    cells = written(points.mapInPandas(placed, "id long, features array<double>, weight long, cell int, turned array<double>"), "cells")
    sides = [f(F.col("turned")[i]) for f in (F.min, F.max) for i in range(len(turn))]
    sizes = {r[0]: r for r in cells.groupBy("cell").agg(F.count("*"), *sides).collect()}
    parts = np.array([-(-sizes[c][1] // block) if c in sizes else 0 for c in range(cells_)])
    boxes = {c: np.array(r[2:], dtype=float).reshape(2, -1) for c, r in sizes.items()}
    first = np.concatenate([[0], np.cumsum(parts)])
    slack = _slack(reach, size, len(turn))

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            cell, z = b.cell.to_numpy(), np.stack(b.turned)
            may = np.zeros((len(b), first[-1]), dtype=bool)
            for c, (lo, hi) in boxes.items():
                may[:, first[c] : first[c + 1]] = ((_gaps(lo, hi, z, z) <= slack) | (cell == c))[:, None]
            own = first[cell] + (b.salt.to_numpy() % parts[cell])
            yield pd.DataFrame({"id": b.id, "features": b.features, "weight": b.weight, "block": own, "to": [np.flatnonzero(m) for m in may]})

    salted = cells.select("id", "features", "weight", "cell", "turned", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt"))
    return salted.mapInPandas(sent, "id long, features array<double>, weight long, block long, to array<long>")


def _pieces(x: np.ndarray, y: np.ndarray, radii: Sequence[float], rows: int = 256, columns: int = 4096) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, first column, for each radius which pairs are within it) of all x against all y, piece by piece, as ``_apart`` has it.

    Squared distances come from one product; where its rounding could put a pair on the other side of a radius, the pair's own sum decides."""
    if not len(x) or not len(y):
        return
    middle = x.mean(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        u, v = x - middle, y - middle
        uu, vv = (u**2).sum(axis=1), (v**2).sum(axis=1)
        left, right = np.column_stack([u, uu, np.ones(len(u))]), np.column_stack([-2 * v, np.ones(len(v)), vv]).T
        rounding = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (uu.max() + vv.max() + max(radii) ** 2)
        for i in range(0, len(x), rows):
            for j in range(0, len(y), columns):
                square = left[i : i + rows] @ right[:, j : j + columns]
                out = []
                for r in radii:
                    near, not_far = square <= r * r - rounding, ~(square > r * r + rounding)
                    if np.count_nonzero(near) != np.count_nonzero(not_far):
                        p, q = np.nonzero(not_far & ~near)
                        near[p, q] = np.sqrt(((x[i + p] - y[j + q]) ** 2).sum(axis=1)) <= r
                    out.append(near)
                yield i, j, out


class _Ordered:
    """Rows in leaves of neighbours with their boxes: x and its turned coordinates z in their order, ``rows`` their places before it, leaf p at starts[p] .. starts[p + 1].
    Distances in z are those in x but for ``off`` at most."""

    def __init__(self, x: np.ndarray, z: np.ndarray, rows: np.ndarray, starts: np.ndarray, off: float) -> None:
        self.x, self.z, self.rows, self.starts, self.off = x, z, rows, starts, off
        self.lo, self.hi = (f.reduceat(z, starts[:-1], axis=0) if len(x) else z for f in (np.minimum, np.maximum))

    @classmethod
    def of(cls, x: np.ndarray, z: np.ndarray, off: float) -> _Ordered:
        leaves = _leaves(z, LEAF) if len(x) else []
        rows = np.concatenate(leaves) if leaves else np.arange(0)
        return cls(x[rows], z[rows], rows, np.cumsum([0, *map(len, leaves)]), off)

    def only(self, kept: np.ndarray) -> _Ordered:
        """The leaves with those rows (places before the order) that are kept."""
        at = kept[self.rows]
        left = np.add.reduceat(at, self.starts[:-1], dtype=np.int64) if len(at) else np.arange(0)
        return _Ordered(self.x[at], self.z[at], self.rows[at], np.concatenate([[0], np.cumsum(left[left > 0])]).astype(int), self.off)


def _both(x: np.ndarray, y: np.ndarray) -> tuple[_Ordered, _Ordered]:
    """The rows of both, turned alike; directions in which they hardly spread are left out."""
    every = np.concatenate([x, y])
    z = every @ _turn(every)
    wide = np.ptp(z, axis=0) if len(z) else np.zeros(z.shape[1])
    kept = ~(wide <= 1e-9 * wide.max(initial=0))
    off = _slack(0, np.abs(every).max(initial=0), x.shape[1]) + float(wide[~kept].sum())
    return _Ordered.of(x, z[: len(x), kept], off), _Ordered.of(y, z[len(x) :, kept], off)


def _places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.nonzero of a table, several times faster where most rows have none."""
    rows = np.flatnonzero(found.any(axis=1))
    p, q = np.divmod(np.flatnonzero(found[rows]), max(1, found.shape[1]))
    return rows[p], q


def _within(a: _Ordered, rows: slice | np.ndarray, b: _Ordered, columns: np.ndarray, radii: Sequence[float], widths: Sequence[int]) -> list[np.ndarray]:
    """For each radius, which of a's rows and the first so many of b's columns are within it, as ``_apart`` has it: from one product in single precision about the middle of
    the rows; where its rounding could put a pair on the other side, the pair's own sum decides."""
    with np.errstate(over="ignore", invalid="ignore"):
        u, v = a.z[rows], b.z[columns]
        middle = u.mean(axis=0)
        u, v = u - middle, v - middle
        uu, vv = (u**2).sum(axis=1), (v**2).sum(axis=1)
        left, right = np.column_stack([u, uu, np.ones(len(u))]).astype(np.float32), np.column_stack([-2 * v, np.ones(len(v)), vv]).astype(np.float32)
        square = left @ right.T
        out = []
        for r, width in zip(radii, widths, strict=True):
            part, r2 = square[:, :width], np.float64(r) ** 2
            size = float(uu.max() + vv[:width].max(initial=0) + r2 + np.finfo(np.float32).tiny)
            rounding = 4 * (u.shape[1] + 6) * float(np.finfo(np.float32).eps) * size + (2 * r + a.off) * a.off if size < 1e36 else np.inf
            near, far = part <= np.float32(r2 - rounding), part > np.float32(r2 + rounding)
            if np.count_nonzero(near) + np.count_nonzero(far) != near.size:
                p, q = _places(near == far)
                near[p, q] = np.sqrt(((a.x[rows][p] - b.x[columns[q]]) ** 2).sum(axis=1)) <= r
            out.append(near)
    return out


def _close(a: _Ordered, b: _Ordered, radii: Sequence[float], ahead: bool = False) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(first row, end, rows of b, for each radius which pairs with the first of them are within it) of leaves whose boxes are within a radius. With ``ahead`` (b is a) a leaf meets itself and later ones."""
    slack = [r * (1 + 1e-9) + a.off for r in radii]
    for p in range(len(a.starts) - 1):
        start, end = a.starts[p : p + 2]
        gap = _gaps(b.lo, b.hi, a.lo[p], a.hi[p])
        if ahead:
            gap[:p] = np.inf
        leaves = np.argsort(gap, kind="stable")
        leaves = leaves[: np.searchsorted(gap[leaves], max(slack), side="right")]
        if not len(leaves):
            continue
        sizes = b.starts[leaves + 1] - b.starts[leaves]
        runs = np.flatnonzero(np.diff(np.cumsum(sizes) // COLUMNS, prepend=-1))
        for k, until in zip(runs, [*runs[1:], len(leaves)], strict=True):
            own = leaves[k:until]
            columns = np.concatenate([np.arange(b.starts[q], b.starts[q + 1]) for q in own])
            widths = [int(sizes[k:until][gap[own] <= s].sum()) for s in slack]
            yield start, end, columns, _within(a, slice(start, end), b, columns, radii, widths)


def _found(a: _Ordered, b: _Ordered, r: float, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (rows of a, rows of b) within r, as places before the order, some pieces' at a time: ``most`` and what one piece adds."""
    us, vs, n = [], [], 0
    for start, _, columns, (near,) in _close(a, b, [r]):
        u, v = _places(near)
        us.append(a.rows[start + u])
        vs.append(b.rows[columns[v]])
        n += len(u)
        if n >= most:
            yield np.concatenate(us), np.concatenate(vs)
            us, vs, n = [], [], 0
    if n:
        yield np.concatenate(us), np.concatenate(vs)


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each place's part (root) after the parts of u and v are joined."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _bridged(a: _Ordered, b: _Ordered, r: float, part_a: np.ndarray, part_b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """root after the parts of rows of a and b within r of each other are joined; part_a, part_b: the parts of all rows, by their places before the order.
    What is of one part already is not compared."""
    pa, pb = part_a[a.rows], part_b[b.rows]
    slack = r * (1 + 1e-9) + a.off
    for p in range(len(a.starts) - 1):
        rows = slice(a.starts[p], a.starts[p + 1])
        now = root[pb]
        lo, hi = (f.reduceat(now, b.starts[:-1]) for f in (np.minimum, np.maximum)) if len(now) else (now, now)
        own, n = np.unique(root[pa[rows]], return_counts=True)
        most = own[n.argmax()]
        near = _gaps(b.lo, b.hi, a.lo[p], a.hi[p]) <= slack
        if len(own) == 1:
            near &= (lo != most) | (hi != most)
        leaves = np.flatnonzero(near)
        for k in range(0, len(leaves), 16):
            columns = np.concatenate([np.arange(b.starts[q], b.starts[q + 1]) for q in leaves[k : k + 16]])
            mine, other = root[pa[rows]], root[pb[columns]]
            most = root[most]
            alone, rest = np.flatnonzero(mine != most) + a.starts[p], np.flatnonzero(mine == most) + a.starts[p]
            if len(alone):
                (hit,) = _within(a, alone, b, columns, [r], [len(columns)])
                u, v = _places(hit)
                root = _joined(root, pa[alone[u]], pb[columns[v]])
            left = columns[root[other] != root[most]]
            if len(rest) and len(left):
                (hit,) = _within(a, rest, b, left, [r], [len(left)])
                v = left[hit.any(axis=0)]
                root = _joined(root, np.full(len(v), most), pb[v])
    return root


def _paired(dealt: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, tasks: int) -> DataFrame:
    """f(rows of one block, rows of the other, whether both are one block) for each pair of blocks. The pairs are dealt to ``tasks`` tasks: they are few bytes and
    much work, so they are not to be put together by size."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    rows = dealt.withColumn("to", F.explode("to")).select("*", F.least("block", "to").alias("lo"), F.greatest("block", "to").alias("hi")).drop("to")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        a, b = group[group.block == group.lo], group[group.block == group.hi]
        if a.empty or b.empty:
            return pd.DataFrame(columns=names)
        return f(a, b, bool(a.lo.iat[0] == a.hi.iat[0]))[names]

    return rows.repartition(tasks, "lo", "hi").groupBy("lo", "hi").applyInPandas(run, schema)


def _least_reachable(links: DataFrame) -> DataFrame:
    """links(setting, u, v) -> (setting, id, part): the least node reachable, by large and small stars (Kiveris et al. 2014), a written table a round."""

    def star(arcs: DataFrame) -> DataFrame:
        return arcs.join(arcs.groupBy("setting", "u").agg(F.min("v").alias("m")).selectExpr("setting", "u", "least(u, m) AS m"), ["setting", "u"])

    held = written(links.where("u <> v").selectExpr("setting", "greatest(u, v) AS u", "least(u, v) AS v").distinct(), "parts")
    while True:
        large = star(held.unionAll(held.selectExpr("setting", "v AS u", "u AS v"))).where("v > u").selectExpr("setting", "v AS u", "m AS v")
        small = star(large)
        after = written(small.selectExpr("setting", "v AS u", "m AS v").unionAll(small.select("setting", "u", F.col("m").alias("v"))).where("u <> v").distinct(), "parts")
        nodes = after.groupBy("setting", "u").count().where("count > 1").select("setting", "u")
        loose = nodes.unionAll(after.select("setting", "u").join(after.selectExpr("setting", "v AS u"), ["setting", "u"], "left_semi"))
        done = loose.limit(1).count() == 0
        dropped(held)
        held = after
        if done:
            return held.selectExpr("setting", "u AS id", "v AS part").unionAll(held.selectExpr("setting", "v AS id", "v AS part").distinct())


def density_clusters(rows: DataFrame, key: str, radii: Sequence[float], least: Sequence[int], pivots: int | None = None, block: int | None = None, parts: bool = True) -> DataFrame:
    """rows(key, features) -> (key, radius, least, n_near, kind, cluster): one row a key and setting.

    ``n_near`` counts the rows within the radius, itself included. A row is ``core`` if they are ``least`` or more, ``border`` if it is none but
    within the radius of one, else ``noise``. Core rows within the radius of each other are one cluster; a border row goes with its
    nearest core vector (equally near ones: any of them). ``cluster`` is the least key of its rows, null for noise. Rows without features,
    or with a null or non-finite one, are dropped; repeated keys are rows of their own; an empty table gives no rows.

    Without ``parts`` there is no ``cluster``, and core rows are not linked.

    ``pivots`` (cells; None: one for 512 distinct vectors, at most 16, from 2 million on 32) and ``block`` (vectors a task compares with as many others; None: a 16th of all, at least 2,048) change the
    cost, never the rows. In very many dimensions without groups no box is ruled out, and the work grows with the square of the distinct vectors."""
    usable = rows.where("features IS NOT NULL AND NOT exists(features, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))")
    usable = written(usable.select(F.col(key).alias("_key"), F.transform("features", lambda v: v + F.lit(0.0)).alias("features")), "rows")
    points = written(usable.groupBy("features").agg(F.count("*").alias("weight")).select(F.monotonically_increasing_id().alias("id"), "features", "weight"), "points")
    settings = [(e, m) for e in range(len(radii)) for m in least]
    n_points = points.count()
    if not n_points:
        return usable.select(F.col("_key").alias(key), F.lit(0.0).alias("radius"), F.lit(0).alias("least"), F.lit(0).cast("long").alias("n_near"), F.lit("").alias("kind"), *([F.col("_key").alias("cluster")] if parts else []))
    pivots, block = min(n_points, pivots or min(16 if n_points < 2_000_000 else 32, 1 + n_points // 512)), block or max(2048, n_points // 16)
    dealt = written(_dealt(points, max(radii), pivots, block), "dealt")
    n_blocks = max(pivots, n_points // block)
    tasks = max(1, min(512, n_blocks * n_blocks))
    least_core, most_core = min(least), max(least)

    def counted(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        wa, wb = a.weight.to_numpy(), b.weight.to_numpy()
        whole = np.float32 if max(wa.sum(), wb.sum()) < 1 << 24 else np.float64  # sums stay exact
        fa, fb = wa.astype(whole), wb.astype(whole)
        x, y = np.stack(a.features), np.stack(b.features)
        left, right = _both(x, y)
        if same:
            right = left
        fa, fb = fa[left.rows], fb[right.rows]
        na, nb = np.zeros((len(radii), len(a))), np.zeros((len(radii), len(b)))
        for i, end, columns, each in _close(left, right, radii, ahead=same):
            for e, near in enumerate(each):
                if near.size:
                    ones, at = near.astype(whole), columns[: near.shape[1]]
                    na[e, left.rows[i:end]] += ones @ fb[at]
                    back = fa[i:end] @ ones
                    if same:
                        back[at < end] = 0  # its own leaf
                    nb[e, right.rows[at]] += back
        sides = [(a, na + nb)] if same else [(a, na), (b, nb)]
        return pd.concat(pd.DataFrame({"id": side.id, "near": list(n.T.astype(np.int64))}) for side, n in sides)

    each_radius = [F.sum(F.col("near")[e]) for e in range(len(radii))]
    counts = written(_paired(dealt, counted, "id long, near array<long>", tasks).groupBy("id").agg(F.array(*each_radius).alias("near")), "near")

    def alone(group: pd.DataFrame) -> pd.DataFrame:
        near, ids = np.stack(group.near), group.id.to_numpy()
        return pd.DataFrame({"id": ids, "own": list(np.column_stack([np.where(near[:, e] >= m, ids, -1) for e, m in settings]))})

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x, ids, near = np.stack(group.features), group.id.to_numpy(), np.stack(group.near)
        own, places = np.full((len(ids), len(settings)), -1), np.arange(len(ids))
        ordered, _ = _both(x, x[:0])
        for e, r in enumerate(radii):
            dense = ordered.only(near[:, e] >= most_core)
            root = _bridged(dense, dense, r, places, places, places.copy())
            cores = ordered.only(near[:, e] >= least_core)
            few = ordered.only((near[:, e] >= least_core) & (near[:, e] < most_core))
            roots = {s: root.copy() for s, (k, _) in enumerate(settings) if k == e}
            for u, v in _found(few, cores, r):
                for s in roots:
                    both = (near[u, e] >= settings[s][1]) & (near[v, e] >= settings[s][1])
                    roots[s] = _joined(roots[s], u[both], v[both])
            for s, found in roots.items():
                core = near[:, e] >= settings[s][1]
                own[core, s] = ids[found[core]]
        return pd.DataFrame({"id": ids, "own": list(own)})

    # own: for each setting the least core point that a core point reaches inside its block (itself without parts), -1 if it is none
    if parts:
        blocks = dealt.select("id", "features", "block").join(counts, "id")
        owned = blocks.repartition(n_blocks, "block").groupBy("block").applyInPandas(inside, "id long, own array<long>")
    else:
        owned = counts.mapInPandas(lambda batches: (alone(b) for b in batches if len(b)), "id long, own array<long>")
    parted = written(counts.join(owned, "id"), "parted")

    def linked(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        xa, xb, ida, idb, own_a, own_b = np.stack(a.features), np.stack(b.features), a.id.to_numpy(), b.id.to_numpy(), np.stack(a.own), np.stack(b.own)
        out = []

        def links(s: int, u: np.ndarray, v: np.ndarray) -> None:
            both = pd.DataFrame({"setting": s, "u": u, "v": v})[u != v].drop_duplicates()
            if len(both):
                out.append(both.assign(away=np.nan, at=-1))

        def borders(s: int, ids: np.ndarray, part: np.ndarray, away: np.ndarray, at: np.ndarray) -> None:
            if len(ids):
                found = pd.DataFrame({"setting": s, "u": ids, "v": part, "away": away, "at": at}).sort_values(["away", "at"])
                out.append(found.drop_duplicates("u"))

        left, right = _both(xa, xb)
        for e, r in enumerate(radii):
            at = [s for s, (k, _) in enumerate(settings) if k == e]
            last = next(s for s in at if settings[s][1] == most_core)
            dense_a, dense_b = own_a[:, last] >= 0, own_b[:, last] >= 0
            if parts and not same and dense_a.any() and dense_b.any():
                names, first, code = np.unique(np.concatenate([own_a[:, last], own_b[:, last]]), return_index=True, return_inverse=True)
                root = _bridged(left.only(dense_a), right.only(dense_b), r, code[: len(xa)], code[len(xa) :], np.arange(len(names)))
                joined, every = np.flatnonzero(root != np.arange(len(names))), np.concatenate([own_a, own_b])
                for s in at:
                    links(s, every[first[joined], s], every[first[root[joined]], s])
            # the others have few neighbours: each pair of one of them and a core point, once
            lowest = next(s for s in at if settings[s][1] == least_core)
            core_a, core_b = own_a[:, lowest] >= 0, own_b[:, lowest] >= 0
            sides = [(~dense_a, core_b)] + ([] if same else [(core_a, ~core_b), (dense_a, core_b & ~dense_b)])
            for rows_, columns in sides:
                for u, v in _found(left.only(rows_), right.only(columns), r):
                    away = np.sqrt(((xa[u] - xb[v]) ** 2).sum(axis=1))
                    for s in at:
                        pu, pv = own_a[u, s], own_b[v, s]
                        if parts and not same:
                            k = (pu >= 0) & (pv >= 0)
                            links(s, pu[k], pv[k])
                        k = (pu < 0) & (pv >= 0)
                        borders(s, ida[u[k]], pv[k], away[k], idb[v[k]])
                        k = (pv < 0) & (pu >= 0) & (not same)
                        borders(s, idb[v[k]], pu[k], away[k], ida[u[k]])
        return pd.concat(out) if out else pd.DataFrame(columns=["setting", "u", "v", "away", "at"])

    links = written(_paired(dealt.select("id", "features", "block", "to").join(parted.select("id", "own"), "id"), linked, "setting int, u long, v long, away double, at long", tasks), "links")
    borders = links.where("at >= 0").groupBy("setting", F.col("u").alias("id")).agg(F.min_by("v", F.struct("away", "at")).alias("beside"))
    beside = borders.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("setting", "beside"))).alias("beside"))
    each = parted.join(beside, "id", "left").select("id", F.explode(F.array(*(F.struct(F.lit(i).alias("setting"), F.lit(float(radii[e])).alias("radius"), F.lit(int(m)).alias("least"), F.col("near")[e].alias("n_near"), F.coalesce(F.nullif(F.col("own")[i], F.lit(-1)), F.try_element_at("beside", F.lit(i))).alias("at")) for i, (e, m) in enumerate(settings)))).alias("s")).select("id", "s.*")
    kind: Column = F.when(F.col("n_near") >= F.col("least"), "core").when(F.col("at").isNotNull(), "border").otherwise("noise")
    if not parts:
        out = usable.join(points.select("id", "features"), "features").select("id", F.col("_key").alias(key)).join(each.select("id", "radius", "least", "n_near", kind.alias("kind")), "id").drop("id")
        dropped(dealt, counts)
        return out
    joins = links.where("at < 0").select("setting", "u", "v")
    each = each.join(_least_reachable(joins).withColumnRenamed("id", "at"), ["setting", "at"], "left").withColumn("part", F.coalesce("part", "at"))
    each = each.select("id", "setting", "radius", "least", "n_near", kind.alias("kind"), "part")
    labelled = written(usable.join(points.select("id", "features"), "features").select("id", "_key").join(each, "id").drop("id"), "labelled")
    names = labelled.where("part IS NOT NULL").groupBy("setting", "part").agg(F.min("_key").alias("cluster"))
    out = labelled.join(names, ["setting", "part"], "left").select(F.col("_key").alias(key), "radius", "least", "n_near", "kind", "cluster")
    dropped(usable, points, dealt, counts, links)
    return out


def density_report(labelled: DataFrame, by: Sequence[str], cluster: str, truth: str) -> DataFrame:
    """One row a setting: rows, clusters, noise and its share, largest cluster, and how clusters agree with ``truth`` on the rows that have both
    (adjusted Rand index and normalised mutual information; null where either has fewer than two groups)."""
    by = list(by)
    sizes = labelled.groupBy(*by, cluster).agg(F.count("*").alias("n"))
    head = sizes.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count(cluster).alias("n_clusters"), F.coalesce(F.sum(F.when(F.col(cluster).isNull(), F.col("n"))), F.lit(0)).alias("n_noise"), F.max(F.when(F.col(cluster).isNotNull(), F.col("n"))).alias("largest"))
    both = labelled.where(F.col(cluster).isNotNull() & F.col(truth).isNotNull()).groupBy(*by, cluster, truth).agg(F.count("*").alias("n"))
    pairs, plogp = lambda n: F.sum(n * (n - 1) / 2), lambda n: F.sum(n * F.log(n))
    n = F.col("n")

    def side(column: str, name: str) -> DataFrame:
        return both.groupBy(*by, column).agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs(n).alias(f"c{name}"), plogp(n).alias(f"l{name}"), F.count("*").alias(f"k{name}"))

    t = both.groupBy(*by).agg(pairs(n).alias("cxy"), plogp(n).alias("lxy"), F.sum("n").cast("double").alias("t")).join(side(cluster, "x"), by).join(side(truth, "y"), by)
    # entropies as log t - sum(n log n) / t
    h = {s: F.log("t") - F.col(f"l{s}") / F.col("t") for s in ("x", "y", "xy")}
    chance = F.col("cx") * F.col("cy") / (F.col("t") * (F.col("t") - 1) / 2)
    ari = F.try_divide(F.col("cxy") - chance, (F.col("cx") + F.col("cy")) / 2 - chance)
    nmi = F.try_divide(2 * (h["x"] + h["y"] - h["xy"]), h["x"] + h["y"])
    whole = (F.col("kx") > 1) & (F.col("ky") > 1)
    t = t.select(*by, F.when(whole, ari).alias("ari"), F.when(whole, nmi).alias("nmi"))
    return head.join(t, by, "left").withColumn("noise_share", F.col("n_noise") / F.col("n_rows"))
