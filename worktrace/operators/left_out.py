"""Balanced logistic regressions that leave out one group each, all fitted together.

A fold's sums are all rows' less its group's own. All rows' sums are expanded once about the common model, up to third order in
how far a fold's model is from it, so that a fold is fitted where its own rows are: from the expansion less its own rows, which are exact. What the
expansion leaves out is bounded from fourth powers. Folds for which that is not small (their group holds a large part of all rows, so there are
few of them), and groups too large for one task, are fitted over all rows: each Newton step is a pass in which tasks add up gradients and curvatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.operators.tables import written

#: Folds whose chances a task holds at once, and Newton steps at most.
FOLDS_AT_ONCE, STEPS = 256, 25
#: Error of a score that an expansion may leave, rows of groups that a task takes at once, and rows of a group in one task.
ERROR, ROWS_AT_ONCE, ROWS_OF_A_GROUP = 1e-7, 100_000, 1_000_000


def _step_sums(columns: list[str], index: dict, folds: np.ndarray, beta: np.ndarray, weights: np.ndarray) -> Callable:
    """Rows (fold, k, v): gradient, then curvature, of each fold over a task's rows. Fold -1 leaves nothing out."""
    d = len(columns) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(folds), d + d * d))
        for batch in batches:
            z = np.column_stack((batch[columns].to_numpy(float), np.ones(len(batch))))
            y = batch["_y"].to_numpy(float)
            own = batch["_g"].map(index).fillna(-2).to_numpy()  # -2: of no fold here
            for lo in range(0, len(folds), FOLDS_AT_ONCE):
                part = slice(lo, lo + FOLDS_AT_ONCE)
                p = 1 / (1 + np.exp(-np.clip(z @ beta[part].T, -500, 500)))
                w = np.where(y[:, None] == 1, weights[part, 1], weights[part, 0]) * (own[:, None] != folds[part])
                total[part, :d] += (w * (p - y[:, None])).T @ z
                total[part, d:] += (w * p * (1 - p)).T @ (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
        yield pd.DataFrame({"fold": np.repeat(folds, d + d * d), "k": np.tile(np.arange(d + d * d), len(folds)), "v": total.ravel()})

    return run


def _expansion(columns: list[str], beta: np.ndarray) -> Callable:
    """Rows (y, k, v) of either label over a task's rows: gradient, curvature, third and fourth derivatives of the loss at beta, and fourth powers."""
    d = len(columns) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, d + d**2 + d**3 + 2 * d**4))
        for batch in batches:
            z_all, y_all = np.column_stack((batch[columns].to_numpy(float), np.ones(len(batch)))), batch["_y"].to_numpy(float)
            for label in (0, 1):
                z = z_all[y_all == label]
                p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
                u, zz = p * (1 - p), (z[:, :, None] * z[:, None, :]).reshape(len(z), d * d)
                third, fourth = u * (1 - 2 * p), u * (1 - 6 * u)
                total[label] += np.concatenate([v.ravel() for v in ((p - label) @ z, u @ zz, z.T @ (third[:, None] * zz), zz.T @ (fourth[:, None] * zz), zz.T @ zz)])
        yield pd.DataFrame({"y": np.repeat([0, 1], total.shape[1]), "k": np.tile(np.arange(total.shape[1]), 2), "v": total.ravel()})

    return run


def _beside(columns: list[str], beta: np.ndarray, sums: np.ndarray, all_rows: np.ndarray, largest: np.ndarray, cost: float) -> Callable:
    """Scores of the rows of whole groups by the models without them: f(z, y, starts of the groups) -> (scores, whether the expansion does not do).

    sums: of ``_expansion``; all_rows: numbers of either label, sums and squares of the columns; largest: sizes of the columns."""
    d, c = len(columns) + 1, len(columns)
    g1, g2, g3, g4, fours = np.split(sums, np.cumsum([d, d**2, d**3, d**4]), axis=1)
    g2, g3, g4 = g2.reshape(2, d, d), g3.reshape(2, d, d * d), g4.reshape(2, d * d, d * d)
    fours = fours.reshape(2, d * d, d * d)

    def run(z: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(z))))
        known, label = ~np.isnan(y), np.nan_to_num(y)
        added = lambda v: np.add.reduceat(v, starts, axis=0)
        x = z[:, :c] * known[:, None]
        rest = all_rows - np.column_stack((added((known & (label == 0)).astype(float)), added((known & (label == 1)).astype(float)), added(x), added(x * x)))
        n, both = rest[:, :2].sum(axis=1), (rest[:, :2] > 0).all(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(both[:, None], n[:, None] / (2 * rest[:, :2]), 0.0)
            squares = np.where(n[:, None] > 0, rest[:, 2 + c :] / n[:, None] - (rest[:, 2 : 2 + c] / n[:, None]) ** 2, 0.0)
            only = np.where(n > 0, rest[:, 1] / n, np.nan)
        ridge = np.column_stack((np.where(squares > 1e-12, squares, 1e12) / cost, np.zeros(len(n))))
        models, size = np.tile(beta, (len(starts), 1)), np.full(len(starts), np.inf)
        own_weight = np.where(label == 1, weight[group, 1], weight[group, 0]) * known
        zz = (z[:, :, None] * z[:, None, :]).reshape(len(z), d * d)
        for _ in range(STEPS):
            off = models - beta
            two = (off[:, :, None] * off[:, None, :]).reshape(-1, d * d)
            p = 1 / (1 + np.exp(-np.clip((z * models[group]).sum(axis=1), -500, 500)))
            gradient = ridge * models - added((own_weight * (p - label))[:, None] * z)
            curve = -added((own_weight * p * (1 - p))[:, None] * zz).reshape(-1, d, d)
            curve[:, np.arange(d), np.arange(d)] += ridge + 1e-12
            for k in (0, 1):
                by_two = (two @ g4[k]).reshape(-1, d, d)  # fourth derivatives along the way twice
                by_one = (off @ g3[k]).reshape(-1, d, d)
                gradient += weight[:, k, None] * (g1[k] + off @ g2[k] + np.einsum("sij,sj->si", by_one / 2 + by_two / 6, off))
                curve += weight[:, k, None, None] * (g2[k] + by_one + by_two / 2)
            curve[~both] = np.eye(d)
            step = np.linalg.solve(curve, np.where(both[:, None], gradient, 0.0)[:, :, None])[:, :, 0]
            size = np.abs(step).max(axis=1)
            models -= step * np.minimum(1.0, 5.0 / np.maximum(size, 1e-300))[:, None]
            if size.max() <= 1e-9:
                break
        off = models - beta
        two = (off[:, :, None] * off[:, None, :]).reshape(-1, d * d)
        # the fifth derivative of the loss is at most 0.13
        left = 0.13 / 24 * sum(weight[:, k] * np.einsum("si,si->s", two @ fours[k], two) for k in (0, 1))
        error = 0.25 * left * (np.abs(np.linalg.inv(curve)) @ largest @ largest)
        far = both & ~((error <= ERROR) & (size <= 1e-9))
        p = 1 / (1 + np.exp(-np.clip((z * models[group]).sum(axis=1), -500, 500)))
        return np.where(both[group], p, only[group]), far[group]

    return run


def left_out_scores(rows: DataFrame, columns: Sequence[str], label: str, group: str, cost: float = 1.0) -> DataFrame:
    """The rows with ``score``: the chance of a true label by the model of all other groups' rows. Every model standardises the columns over its own rows
    and weighs the labels to equal sums, with a penalty of 1 / (2 cost) on its coefficients.

    Null columns count as 0; rows without a label (and groups that are null, which are one group) are scored, and rows without a label are not learned
    from. Where the other groups have one label, its share is the score; where they have no rows, it is null. The driver holds columns**4 numbers, and columns**2 for each
    fold that is fitted over all rows."""
    names = [f"_c{i}" for i in range(len(columns))]
    filled = rows.select(*rows.columns, F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g"), F.col(label).cast("double").alias("_y"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(columns, names, strict=True)))
    table = written(filled, "rows")
    known = table.where("_y IS NOT NULL")
    spread = known.agg(*(f(n) for n in names for f in (F.avg, F.stddev_pop))).first() if names else []
    mean, dev = (np.array([v if v is not None else 0.0 for v in spread[i::2]]) for i in (0, 1))
    scaled = [((F.col(n) - float(m)) / float(s if s > 0 else 1)).alias(n) for n, m, s in zip(names, mean, dev, strict=True)]
    ready = table.select(*rows.columns, "_g", "_y", *scaled)
    labelled, d, kept = ready.where("_y IS NOT NULL"), len(names) + 1, list(rows.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    totals = labelled.agg(F.count_if(F.col("_y") == 0), F.count_if(F.col("_y") == 1), *(F.sum(n) for n in names), *(F.sum(F.col(n) * F.col(n)) for n in names), *(F.max(F.abs(n)) for n in names)).first()
    *all_rows, = (float(v or 0.0) for v in totals)
    all_rows, largest = np.array(all_rows[: 2 + 2 * len(names)]), np.array([*all_rows[2 + 2 * len(names) :], 1.0])
    wide = [r[0] for r in table.groupBy("_g").count().where(F.col("count") > ROWS_OF_A_GROUP).select("_g").collect()]
    beta = _models(labelled, names, [], all_rows, cost)[0]["beta"][-1]
    sums = np.zeros((2, d + d**2 + d**3 + 2 * d**4))
    for r in labelled.select("_y", *names).mapInPandas(_expansion(names, beta), "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect():
        sums[r["y"], r["k"]] = r["v"]
    scores = _beside(names, beta, sums, all_rows, largest, cost)

    def scored(part: pd.DataFrame) -> pd.DataFrame:
        g = part["_g"].to_numpy()
        z, starts = np.column_stack((part[names].to_numpy(float), np.ones(len(part)))), np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        out = part[[*kept, "_g"]].copy()
        out["score"], out["_far"] = scores(z, part["_y"].to_numpy(float), starts)
        return out

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > ROWS_AT_ONCE:
                part = pd.concat(held, ignore_index=True)
                ended = int((part["_g"] != part["_g"].iloc[-1]).to_numpy().sum())  # the last one may go on in the next batch
                if ended:
                    yield scored(part.iloc[:ended].reset_index(drop=True))
                held, size = [part.iloc[ended:]], len(part) - ended
        if size:
            yield scored(pd.concat(held, ignore_index=True))

    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism
    near = ready.where(~F.col("_g").isin(wide)) if wide else ready
    near = written(near.repartition(tasks, "_g").sortWithinPartitions("_g").mapInPandas(together, f"{schema}, _g string, score double, _far boolean"), "scores")
    far = sorted([r[0] for r in near.where("_far").select("_g").distinct().collect()] + wide)
    out = near.where("NOT _far").select(*kept, "score")
    if far:
        out = out.unionByName(_scored_over_all(ready, names, far, all_rows, cost, kept, schema))
    return out.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def _models(labelled: DataFrame, names: list[str], groups: list[str], all_rows: np.ndarray, cost: float) -> tuple[dict, dict]:
    """The models without each of the groups, fitted over all rows; the last one leaves nothing out. -> ({beta, both, only}, places of the groups)"""
    index, d = {g: i for i, g in enumerate(groups)}, len(names) + 1
    # of each group: rows of either label, sums and squares of the columns
    sums = labelled.where(F.col("_g").isin(groups)).groupBy("_g").agg(F.count_if(F.col("_y") == 0), F.count_if(F.col("_y") == 1), *(F.sum(n) for n in names), *(F.sum(F.col(n) * F.col(n)) for n in names)).collect() if groups else []
    own = np.zeros((len(groups), 2 + 2 * len(names)))
    for r in sums:
        own[index[r[0]]] = [float(v) for v in r[1:]]
    rest = np.vstack((all_rows - own, all_rows))
    n = rest[:, :2].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.nan_to_num(n[:, None] / (2 * rest[:, :2]), posinf=0.0)
        squares = rest[:, 2 + len(names) :] / n[:, None] - (rest[:, 2 : 2 + len(names)] / n[:, None]) ** 2
    # in columns of another scale, a fold's penalty is on its own deviations; a column without any takes no part
    ridge = np.column_stack((np.where(squares > 1e-12, squares, 1e12) / cost, np.zeros(len(n))))
    folds = np.append(np.arange(len(groups)), -1)
    both = (rest[:, :2] > 0).all(axis=1)
    beta = np.zeros((len(folds), d))

    def newton(at: np.ndarray) -> np.ndarray:
        """One step of the folds at these places; -> those that moved."""
        found = labelled.select("_g", "_y", *names).mapInPandas(_step_sums(names, index, folds[at], beta[at], weights[at]), "fold int, k int, v double").groupBy("fold", "k").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((len(folds), d + d * d))
        for r in found:
            total[r["fold"], r["k"]] = r["v"]  # -1 is the last one
        moved = []
        for a in at:
            gradient, curve = total[a, :d] + ridge[a] * beta[a], total[a, d:].reshape(d, d) + np.diag(ridge[a])
            step = np.linalg.solve(curve + 1e-12 * np.eye(d), gradient)
            size = np.abs(step).max()
            beta[a] -= step * min(1.0, 5.0 / size if size > 0 else 1.0)
            if size > 1e-9:
                moved.append(a)
        return np.array(moved, dtype=int)

    if both[-1]:
        at = np.array([len(groups)])
        for _ in range(STEPS):
            at = newton(at) if len(at) else at
        beta[:] = beta[-1]
        at = np.flatnonzero(both[:-1])
        for _ in range(STEPS):
            if not len(at):
                break
            at = newton(at)
    with np.errstate(divide="ignore", invalid="ignore"):
        only = np.where(n > 0, rest[:, 1] / n, np.nan)

    return {"beta": beta, "both": both, "only": only}, index


def _scored_over_all(ready: DataFrame, names: list[str], groups: list[str], all_rows: np.ndarray, cost: float, kept: list[str], schema: str) -> DataFrame:
    """Rows of these groups with their scores."""
    found, index = _models(ready.where("_y IS NOT NULL"), names, groups, all_rows, cost)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z, g = np.column_stack((batch[names].to_numpy(float), np.ones(len(batch)))), batch["_g"].map(index).to_numpy()
            p = 1 / (1 + np.exp(-np.clip((z * found["beta"][g]).sum(axis=1), -500, 500)))
            out = batch[kept].copy()
            out["score"] = np.where(found["both"][g], p, found["only"][g])
            yield out

    return ready.where(F.col("_g").isin(groups)).mapInPandas(score, f"{schema}, score double")
