"""Multinomial regressions and forests of several sets of columns and folds, fitted together: a step of all regressions, or a level of
all forests, is one pass over blocks of rows (a forest's levels of very many nodes take a pass for as many trees as a task's counts may hold).

Rows are written once, as blocks of numbers. Tasks add up gradients, or counts of labels by node, column and bin; sums by node are made and split by tasks
as well. The driver gets labels, coefficients, splits, and a sample of about ``SAMPLE`` rows, from which come a forest's bins (as Spark's own do)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.operators.supervised import _numbered_labels, group_fold
from worktrace.operators.tables import written

#: Rows of the sample, about, and rows of a block at most.
SAMPLE, BLOCK = 20_000, 131_072
#: Steps of a regression at most, and its expected gain, as a share of the loss, at which it has ended.
STEPS, ENOUGH = 200, 1e-9
#: Bins of a column, nodes whose counts travel together, and bytes of counts that a task holds.
BINS, CHUNK, COUNTS = 32, 128, 256 << 20


# --- rows -------------------------------------------------------------------------------------------------------------------


def _blocks(names: list[str], size: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def block() -> pd.DataFrame:
            rows = pd.concat(held)
            x = np.ascontiguousarray(rows[names].to_numpy(float))
            return pd.DataFrame({"x": [x.tobytes()], "y": [rows["_y"].to_numpy(np.int32).tobytes()], "fold": [rows["fold"].to_numpy(np.int32).tobytes()], "n": [len(rows)]})

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= size:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return run


def _opened(batches: Iterator[pd.DataFrame], width: int, kind: type) -> Iterator[tuple]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            yield np.frombuffer(r.x, kind).reshape(-1, width), np.frombuffer(r.y, np.int32), np.frombuffer(r.fold, np.int32), getattr(r, "block", 0)


# --- regressions ------------------------------------------------------------------------------------------------------------


def _chances(z: np.ndarray, b: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The chances of the labels; labels that a fit has not seen have none."""
    m = z @ np.where(seen[:, None], b, 0.0).T
    m[:, ~seen] = -np.inf
    m -= m.max(axis=1, keepdims=True)
    np.exp(m, out=m)
    m /= m.sum(axis=1, keepdims=True)
    return m


def _loss(z: np.ndarray, y: np.ndarray, b: np.ndarray, seen: np.ndarray) -> tuple[float, np.ndarray]:
    p = _chances(z, b, seen)
    rows = np.arange(len(y))
    loss = -float(np.log(np.maximum(p[rows, y], 1e-300)).sum())
    p[rows, y] -= 1
    return loss, p.T @ z


def _gradients(width: int, centre: np.ndarray, scale: np.ndarray, jobs: list[tuple]) -> Callable:
    """Rows (fit, v) over a task's rows: loss and gradient. jobs: (number of the fit, places of its columns, fold, labels seen, coefficients)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {job[0]: np.zeros(1 + job[4].size) for job in jobs}
        for x, y, fold, _ in _opened(batches, width, float):
            z = np.column_stack(((x - centre) / scale, np.ones(len(x))))
            for i, places, own, seen, b in jobs:
                rows = slice(None) if own is None else np.flatnonzero(fold != own)
                loss, g = _loss(z[rows][:, places], y[rows], b, seen)
                total[i][0] += loss
                total[i][1:] += g.ravel()
        for i, v in total.items():
            yield pd.DataFrame({"fit": [i], "v": [v.tolist()]})

    return run


def _curvature(z: np.ndarray, p: np.ndarray) -> np.ndarray:
    k, d = p.shape[1], z.shape[1]
    h = np.zeros((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            h[a, :, b, :] = z.T @ (z * (p[:, a] * ((a == b) - p[:, b]))[:, None])
            h[b, :, a, :] = h[a, :, b, :].T
    return h.reshape(k * d, k * d)


def _descend(evaluate: Callable, state: Mapping[int, dict], enough: float) -> None:
    """Quasi-Newton steps of all fits, one evaluation of all a step, from ``x`` on with ``inv`` for the inverse curvature."""
    for s in state.values():
        s.update({"try": s["x"], "x": None, "past": [], "t": 1.0})
    open_ = dict(state)
    for _ in range(STEPS):
        if not open_:
            break
        sums = evaluate([(i, s["at"], s["own"], s["seen"], s["try"].reshape(s["shape"])) for i, s in open_.items()])
        for i, s in list(open_.items()):
            x = s["try"]
            f, g = sums[i][0] + (s["ridge"] * x**2).sum() / 2, sums[i][1:] + s["ridge"] * x
            if s["x"] is not None:
                if not f <= s["f"] + 1e-4 * s["t"] * (s["g"] @ s["d"]) + 1e-13 * abs(s["f"]):  # too far
                    s["t"] /= 4
                    if s["t"] < 1e-6:
                        if not s["past"]:
                            del open_[i]
                            continue
                        s.update(past=[], t=1.0, d=-s["inv"] @ s["g"])
                    s["try"] = s["x"] + s["t"] * s["d"]
                    continue
                dx, dg = x - s["x"], g - s["g"]
                if dx @ dg > 0:
                    s["past"] = [*s["past"][-19:], (dx, dg)]
            q, turns = g.copy(), []
            for dx, dg in reversed(s["past"]):
                turns.append((dx @ q) / (dx @ dg))
                q = q - turns[-1] * dg
            q = s["inv"] @ q
            for (dx, dg), a in zip(s["past"], reversed(turns), strict=True):
                q = q + (a - (dg @ q) / (dx @ dg)) * dx
            s.update(x=x, f=f, g=g, d=-q, t=1.0)
            s["try"] = x - q
            if g @ q <= enough * (1 + abs(f)):
                del open_[i]


def regressions(blocks: DataFrame, width: int, k: int, n_of: Mapping, fits: Sequence[tuple], cost: float = 1.0) -> list[np.ndarray]:
    """Coefficients (labels x columns and 1, of the columns as they are) of each fit (places of its columns, fold): the unique minimum of the summed log loss and a penalty
    of 1 / (2 cost) on the coefficients of columns with deviation 1 among the fit's rows. Quasi-Newton steps of all fits in common passes:
    of all rows from the labels' shares on, then of the folds from there with its curvature, which decides how many steps there are, not where they end."""

    def moments(batches):
        total: dict = {}
        for x, _, fold, _ in _opened(batches, width, float):
            for f in np.unique(fold):
                own = x[fold == f]
                n, m = len(own), own.mean(axis=0)
                total.setdefault(int(f), []).append((n, m, ((own - m) ** 2).sum(axis=0)))
        for f, parts in total.items():
            for n, m, q in parts:
                yield pd.DataFrame({"fold": [f], "n": [n], "m": [m.tolist()], "q": [q.tolist()]})

    parts = blocks.mapInPandas(moments, "fold int, n long, m array<double>, q array<double>").collect()

    def spread(rows):
        n = sum(r["n"] for r in rows)
        mean = sum(r["n"] * np.array(r["m"]) for r in rows) / n
        return mean, np.sqrt(sum(np.array(r["q"]) + r["n"] * (np.array(r["m"]) - mean) ** 2 for r in rows) / max(1, n - 1))

    centre, scale = spread(parts)
    flat = scale <= 1e-12 * (1 + np.abs(centre))
    scale = np.where(flat, 1.0, scale)

    def products(batches):
        total: dict = {}
        for x, _, fold, _ in _opened(batches, width, float):
            z = np.column_stack(((x - centre) / scale, np.ones(len(x))))
            for f in np.unique(fold):
                total[int(f)] = total.get(int(f), 0) + z[fold == f].T @ z[fold == f]
        for f, v in total.items():
            yield pd.DataFrame({"fold": [f], "v": [v.ravel().tolist()]})

    squares = [(r["fold"], np.array(r["v"]).reshape(width + 1, width + 1)) for r in blocks.mapInPandas(products, "fold int, v array<double>").collect()]

    def started(places, own, x=None, curved=None):
        inner, at = list(places), [*places, width]
        deviation = spread([r for r in parts if r["fold"] != own])[1][inner] / scale[inner]
        ridge = np.tile(np.append(np.where((deviation > 1e-9) & ~flat[inner], deviation**2, 1e12) / cost, 0.0), k)
        n = np.array([sum(n for (f, y), n in n_of.items() if y == c and f != own) for c in range(k)])
        p = n / n.sum()
        if x is None:
            b = np.zeros((k, len(at)))
            b[n > 0, -1] = np.log(p[n > 0]) - np.log(p[n > 0]).mean()
            x, h = b.ravel(), np.kron(np.diag(p) - np.outer(p, p), sum(v for f, v in squares if f != own)[np.ix_(at, at)])
        else:
            x, h = np.where(np.repeat(n > 0, len(at)), x, 0.0), curved * (n.sum() / sum(n_of.values()))
        inv = np.linalg.inv(h + np.diag(ridge + 1e-6 * (1 + np.trace(h) / len(h))))
        return {"at": at, "own": own, "seen": n > 0, "ridge": ridge, "x": x, "inv": inv, "shape": (k, len(at))}

    def evaluate(jobs):
        sums: dict = {}
        for r in blocks.mapInPandas(_gradients(width, centre, scale, jobs), "fit int, v array<double>").collect():
            sums[r["fit"]] = sums.get(r["fit"], 0) + np.array(r["v"])
        return sums

    def bent(batches):
        total: dict = {}
        for x, _, _, _ in _opened(batches, width, float):
            z = np.column_stack(((x - centre) / scale, np.ones(len(x))))
            for places, s in whole.items():
                own = z[:, s["at"]]
                total[places] = total.get(places, 0) + _curvature(own, _chances(own, s["x"].reshape(s["shape"]), s["seen"]))
        for i, places in enumerate(whole):
            if places in total:
                yield pd.DataFrame({"fit": [i], "v": [total[places].ravel().tolist()]})

    # all rows first, then the folds from there
    whole = {places: started(places, None) for places, _ in fits}
    _descend(evaluate, dict(enumerate(whole.values())), 100 * ENOUGH)
    sums: dict = {}
    for r in blocks.mapInPandas(bent, "fit int, v array<double>").collect():
        sums[r["fit"]] = sums.get(r["fit"], 0) + np.array(r["v"])
    curved = {places: sums[i].reshape(len(s["ridge"]), -1) for i, (places, s) in enumerate(whole.items())}
    state = {i: started(places, own, whole[places]["x"], curved[places]) for i, (places, own) in enumerate(fits)}
    _descend(evaluate, state, ENOUGH)
    out = []
    for s in state.values():
        b = s["x"].reshape(s["shape"])
        own = b[:, :-1] / scale[s["at"][:-1]]
        out.append(np.where(s["seen"][:, None], np.column_stack((own, b[:, -1] - own @ centre[s["at"][:-1]])), np.append(np.zeros(own.shape[1]), -np.inf)))
    return out


# --- forests ----------------------------------------------------------------------------------------------------------------


def bin_edges(sample: np.ndarray) -> list[np.ndarray]:
    """Where each column is cut into at most BINS bins: between all its values if they are few, otherwise at quantiles."""
    out = []
    for c in sample.T:
        v = np.unique(c)
        if len(v) > BINS:
            v = np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="nearest"))
            out.append(v[v < c.max()])
        else:
            out.append((v[1:] + v[:-1]) / 2)
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A value's bin is the number of edges below it."""
    return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)


#: How often a row is drawn, by 16 random bits: Poisson with mean 1.
_DRAWN = np.searchsorted(np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _walk(bins: np.ndarray, base: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row (its place in the flat bins) comes to in so many levels; children of n are 2 n + 1 and 2 n + 2."""
    node = np.zeros(len(base), np.int32)
    for _ in range(levels):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + 1 + (bins[base + np.maximum(f, 0)] > cut[node]))
    return node


def _level(width: int, k: int, level: int, seed: int, shared, numbers: list[int]) -> Callable:
    """Rows (tree, chunk, kind, v): a task's counts by node, column of the node's choice, bin and label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = {g: shared.value[g] for g in numbers}
        counts = {g: np.zeros(len(t["nodes"]) * t["choice"].shape[1] * BINS * k, np.int32) for g, t in trees.items()}
        slots = {}
        for g, t in trees.items():
            slots[g] = np.full(2 ** (level + 1) - 1, -1, np.int32)
            slots[g][t["nodes"]] = np.arange(len(t["nodes"]))
        for x, y, fold, block in _opened(batches, width, np.uint8):
            flat, drawn = x.ravel(), {}
            for g, t in trees.items():
                if t["draw"] not in drawn:
                    drawn = {t["draw"]: _DRAWN[np.random.default_rng([seed, t["draw"], block]).integers(0, 1 << 16, len(x), np.uint16)]}
                w = drawn[t["draw"]]
                rows = np.flatnonzero((w > 0) & (fold != t["own"]))
                base = rows * width
                slot = slots[g][_walk(flat, base, t["feature"], t["cut"], level)]
                if (slot < 0).any():
                    rows, slot = rows[slot >= 0], slot[slot >= 0]
                    base = rows * width
                own, w = y[rows], w[rows].astype(np.int32)
                m = t["choice"].shape[1]
                for j in range(m):
                    np.add.at(counts[g], ((slot * m + j) * BINS + flat[base + t["choice"][slot, j]]) * k + own, w)
        for g, c in counts.items():
            step = CHUNK * trees[g]["choice"].shape[1] * BINS * k
            for i in range(0, len(c), step):
                part = c[i : i + step]
                top = part.max()
                kind = "u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "i4"
                if top:
                    yield pd.DataFrame({"tree": [g], "chunk": [i // step], "kind": [kind], "v": [part.astype(kind).tobytes()]})

    return run


def _split(k: int) -> Callable:
    """Of a chunk's counts, for each node: column, bin, whether it is split, labels on both sides. The split with the least Gini impurity."""

    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        m = int(key[2])
        total = sum(np.frombuffer(v, kind).astype(np.int64) for kind, v in zip(parts["kind"], parts["v"], strict=True)).reshape(-1, m, BINS, k)
        left = total.cumsum(axis=2)
        all_ = left[:, :, -1:, :]
        right = all_ - left
        nl, nr, n = left.sum(axis=3), right.sum(axis=3), all_.sum(axis=3)
        with np.errstate(all="ignore"):
            score = (left.astype(float) ** 2).sum(axis=3) / nl + (right.astype(float) ** 2).sum(axis=3) / nr
            gain = np.where((nl > 0) & (nr > 0), score / n - (all_.astype(float) ** 2).sum(axis=3) / n.astype(float) ** 2, -1.0)
        best = gain.reshape(len(gain), -1).argmax(axis=1)
        j, b, i = best // BINS, best % BINS, np.arange(len(best))
        out = np.column_stack((j, b, gain[i, j, b] > 1e-12, left[i, j, b], right[i, j, b])).astype(np.int32)
        return pd.DataFrame({"tree": [key[0]], "chunk": [key[1]], "v": [out.tobytes()]})

    return run


def forests(bins: DataFrame, width: int, k: int, fits: Sequence[tuple], trees: int, depth: int, seed: int = 0) -> list[list[dict]]:
    """The trees of each fit (places of its columns, fold). bins: blocks of bins. A tree draws each row as often as Poisson (mean 1) says; a node chooses among the root of the
    number of columns; a node is split while that lowers the Gini impurity, down to ``depth``. Each tree: feature (-1: leaf), cut, chance of the labels by node."""
    sc = bins.sparkSession.sparkContext
    forest = []
    for places, own in fits:
        for t in range(trees):
            n = 2 ** (depth + 1) - 1
            forest.append({"places": np.array(places), "own": own, "draw": t, "feature": np.full(n, -1, np.int16), "cut": np.zeros(n, np.uint8), "labels": np.zeros((n, k), np.int32), "nodes": np.array([0])})
    order = sorted(range(len(forest)), key=lambda g: (forest[g]["draw"], g))
    for level in range(depth):
        groups, size = [[]], 0
        for g in order:
            t = forest[g]
            m = int(np.ceil(np.sqrt(len(t["places"]))))
            rng = np.random.default_rng([seed, g, level, 1])
            t["choice"] = t["places"][np.argsort(rng.random((len(t["nodes"]), len(t["places"]))), axis=1)[:, :m]]
            own = t["choice"].size * BINS * k * 4
            if groups[-1] and size + own > COUNTS:
                groups, size = [*groups, []], 0
            if len(t["nodes"]):
                groups[-1].append(g)
                size += own
        for numbers in filter(None, groups):
            told = sc.broadcast({g: {c: forest[g][c] for c in ("own", "draw", "nodes", "choice")} | {c: forest[g][c][: 2**level - 1] if level else forest[g][c][:1] for c in ("feature", "cut")} for g in numbers})
            widths = {g: forest[g]["choice"].shape[1] for g in numbers}
            number = F.create_map(*(F.lit(v) for g, m in widths.items() for v in (g, m)))[F.col("tree")] if len(set(widths.values())) > 1 else F.lit(next(iter(widths.values())))
            parts = bins.mapInPandas(_level(width, k, level, seed, told, numbers), "tree int, chunk int, kind string, v binary")
            found = parts.withColumn("m", number).groupBy("tree", "chunk", "m").applyInPandas(_split(k), "tree int, chunk int, v binary").collect()
            told.destroy()
            for r in found:
                t = forest[r["tree"]]
                v = np.frombuffer(r["v"], np.int32).reshape(-1, 3 + 2 * k)
                nodes = t["nodes"][r["chunk"] * CHUNK :][: len(v)]
                choice = t["choice"][r["chunk"] * CHUNK :][: len(v)]
                if level == 0:
                    t["labels"][0] = v[0, 3 : 3 + k] + v[0, 3 + k :]
                yes = v[:, 2] > 0
                t["feature"][nodes[yes]] = choice[np.arange(len(v)), v[:, 0]][yes]
                t["cut"][nodes[yes]] = v[yes, 1]
                t["labels"][2 * nodes[yes] + 1], t["labels"][2 * nodes[yes] + 2] = v[yes, 3 : 3 + k], v[yes, 3 + k :]
        for t in forest:
            split = t["nodes"][t["feature"][t["nodes"]] >= 0]
            after = np.sort(np.concatenate((2 * split + 1, 2 * split + 2)))
            t["nodes"] = after[t["labels"][after].max(axis=1) < t["labels"][after].sum(axis=1)]
    for t in forest:
        t["chance"] = (t["labels"] / np.maximum(1, t["labels"].sum(axis=1, keepdims=True))).astype(np.float32)
    return [[{c: t[c] for c in ("feature", "cut", "chance")} for t in forest[i * trees : (i + 1) * trees]] for i in range(len(fits))]


# --- predictions ------------------------------------------------------------------------------------------------------------


def class_predictions(rows: DataFrame, sets: Mapping[str, Sequence[str]], label: str, group: str, folds: int, keys: Sequence[str], trees: int = 100, depth: int = 10, cost: float = 1.0, seed: int = 0) -> DataFrame:
    """(keys, fold, truth, variant, model, predicted, score) of every labelled row by models of each set of columns that have not seen the row's fold: a multinomial regression
    and a forest, as ``supervised.predictions`` has them. A null column counts as 0."""
    columns = list(dict.fromkeys(c for v in sets.values() for c in v))
    names, width = [f"_c{i}" for i in range(len(columns))], len(columns)
    filled = rows.where(F.col(label).isNotNull()).select(*keys, F.col(label).alias("_label"), group_fold(F.col(group).cast("string"), folds).alias("fold"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(columns, names, strict=True)))
    table, labels = _numbered_labels(written(filled, "columns"))
    spark, k = table.sparkSession, len(labels)
    n_of = {(r["fold"], int(r["_y"])): r["n"] for r in table.groupBy("fold", "_y").agg(F.count("*").alias("n")).collect()}
    n, tasks = sum(n_of.values()), max(1, spark.sparkContext.defaultParallelism)
    kinds = {v: tuple(columns.index(c) for c in of) for v, of in sets.items()}
    seen = {own: sorted({y for f, y in n_of if f != own}) for own in {f for f, _ in n_of}}
    fits = [(places, own) for places in kinds.values() for own in sorted(seen) if len(seen[own]) > 1]
    edges, linear, wood = [], [], []
    if fits:
        size = max(1, min(BLOCK, -(-n // tasks)))
        blocks = written(table.select("_y", "fold", *names).coalesce(tasks).mapInPandas(_blocks(names, size), "x binary, y binary, fold binary, n int").withColumn("block", F.monotonically_increasing_id()), "blocks").coalesce(tasks)
        part = table if n <= SAMPLE else table.sample(False, SAMPLE / n, seed)
        edges = bin_edges(part.select(*names).toPandas().to_numpy(float))
        linear = regressions(blocks, width, k, n_of, fits, cost)

        def binned(batches):
            for batch in batches:
                batch["x"] = [_binned(np.frombuffer(v, float).reshape(-1, width), edges).tobytes() for v in batch["x"]]
                yield batch

        bins = written(blocks.mapInPandas(binned, blocks.schema), "bins").coalesce(tasks)
        wood = forests(bins, width, k, fits, trees, depth, seed)
    models = spark.sparkContext.broadcast({fit: (b, w) for fit, b, w in zip(fits, linear, wood, strict=True)})

    def told(batches):
        for batch in batches:
            x, fold = batch[names].to_numpy(float), batch["fold"].to_numpy()
            bins = _binned(x, edges) if fits else None
            for variant, places in kinds.items():
                for own in np.unique(fold):
                    at = np.flatnonzero(fold == own)
                    for model in ("logistic_regression", "random_forest"):
                        if (places, own) not in models.value:
                            only = seen[own][0] if seen[own] else None
                            best = np.full(len(at), -1 if only is None else only)
                            score = np.full(len(at), np.nan if only is None else float(only == k - 1))
                        else:
                            b, of = models.value[places, own]
                            if model == "logistic_regression":
                                p = _chances(np.column_stack((x[at][:, places], np.ones(len(at)))), b, np.isfinite(b[:, -1]))
                            else:
                                flat, base = bins[at].ravel(), np.arange(len(at)) * width
                                p = sum(t["chance"][_walk(flat, base, t["feature"], t["cut"], depth)] for t in of) / len(of)
                            best, score = p.argmax(axis=1), p[:, -1].astype(float)
                        out = batch.iloc[at][[*keys, "fold", "_label"]].copy()
                        yield out.assign(variant=variant, model=model, _p=best.astype(np.int32), score=score)

    kept = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in (*keys, "fold", "_label"))
    found = table.select(*keys, "fold", "_label", *names).mapInPandas(told, f"{kept}, variant string, model string, _p int, score double")
    predicted = F.lit(None).cast(table.schema["_label"].dataType)
    if labels:
        predicted = F.when(F.col("_p") >= 0, F.element_at(F.array(*map(F.lit, labels)), F.greatest(F.col("_p"), F.lit(0)) + 1))
    return found.select(*keys, "fold", F.col("_label").alias("truth"), "variant", "model", predicted.alias("predicted"), F.when(~F.isnan("score"), F.col("score")).alias("score"))
