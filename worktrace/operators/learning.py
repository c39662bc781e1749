"""Learning operators: feature vectors, held-out scores by group folds, baselines, segment models and clustering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrace.operators import regression as rg
from worktrace.operators.tables import written

FIRST = ("log1p_delta_t_ms", "density_before", "density_after", "application_changed", "window_title_changed", "browser_domain_changed", "interaction_category_changed", "extracted_text_at_transition", "chunk_boundary")
SECOND = ("types_jaccard", "apps_jaccard", "domains_jaccard", "duration_before", "duration_after", "text_before", "text_after", "log1p_delta_t_ms")


def vectors(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns as doubles, nulls as 0, beside the kept ones."""
    return rows.select(*keep, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))


def standardised(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean 0 and population deviation 1 over all rows or within keys; a constant column becomes 0."""
    if by:
        w = Window.partitionBy(*by)
        joined = rows.withColumns({f"{p}_{c}": f(c).over(w) for c in columns for p, f in (("m", F.avg), ("d", F.stddev_pop))})
    else:
        stats = rows.agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"d_{c}"))))
        joined = rows.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"d_{c}")), F.lit(0.0)) for c in columns}).drop(*(f"{p}_{c}" for c in columns for p in "md"))


def held_out_scores(rows: DataFrame, columns: Sequence[str], label: str, group: str, folds: int = 5, cost: float = 1.0) -> DataFrame:
    """Balanced logistic regression by group folds: every row with the score of the model that did not see its group. Groups go
    to folds by a hash, so the number of fits does not grow with them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    fold = F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")
    ready = VectorAssembler(inputCols=list(columns), outputCol="features").transform(standardised(rows, columns)).withColumns({"fold": fold, "y": F.col(label).cast("double")})
    known = ready.where("y IS NOT NULL").select("fold", "features", "y").persist()
    counts = known.groupBy("fold", "y").count().collect()
    out = None
    for k in range(folds):
        train = [r for r in counts if r["fold"] != k]
        n = {v: sum(r["count"] for r in train if r["y"] == v) for v in (0.0, 1.0)}
        if not all(n.values()):
            part = ready.where(F.col("fold") == k).withColumn("score", F.lit(n[1.0] / max(1, sum(n.values()))))
        else:
            total = sum(n.values())
            weighted = known.where(F.col("fold") != k).withColumn("w", F.when(F.col("y") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0])))
            model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1 / (cost * total), standardization=False, maxIter=60).fit(weighted)
            part = model.transform(ready.where(F.col("fold") == k)).withColumn("score", vector_to_array("probability")[1])
        part = part.select(*rows.columns, "fold", "score")
        out = part if out is None else out.unionByName(part)
    known.unpersist()
    return out


def fitted(rows: DataFrame, columns: Sequence[str], label: str, cost: float = 1.0) -> tuple[DataFrame, list[float]]:
    """(standardised rows, coefficients in the columns' order) of one balanced logistic regression over all rows."""
    ready = written(standardised(rows, columns), "standardised")
    known = ready.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), F.lit(0).alias("fold"), *columns)
    model = rg.fitted_together(known, [rg.Fit(tuple(columns))], cost=cost, own_scale=False)[0]
    return ready, [0.0] * len(columns) if model is None else [float(x) for x in model[0]]


def importance(rows: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, coefficient, rank) of the standardised features, largest size first."""
    _, found = fitted(rows, columns, label)
    order = sorted(range(len(columns)), key=lambda i: (-abs(found[i]), columns[i]))
    return rows.sparkSession.createDataFrame([(columns[i], found[i], k + 1) for k, i in enumerate(order)], "feature string, coefficient double, rank int")


def contributions(rows: DataFrame, columns: Sequence[str], label: str, keep: Sequence[str]) -> DataFrame:
    """Each row's part of its score by feature: z-value times coefficient."""
    ready, found = fitted(rows, columns, label)
    return ready.select(*keep, *((F.col(c) * F.lit(x)).alias(f"part_{c}") for c, x in zip(columns, found, strict=True)))


def operator_baselines(transitions: DataFrame, least: int) -> DataFrame:
    """Median and median absolute deviation of the log gap per operator; the global ones where it has fewer than ``least``
    gaps. Deviation is at least 1e-6. transitions: operator, log1p_delta_t_ms."""
    g = F.col("log1p_delta_t_ms")
    med = transitions.groupBy("operator").agg(F.median(g).alias("m"), F.count("*").alias("n"))
    own = transitions.join(F.broadcast(med), "operator").groupBy("operator", "m", "n").agg(F.median(F.abs(g - F.col("m"))).alias("d"))
    every = transitions.agg(F.median(g).alias("gm"))
    glob = transitions.crossJoin(F.broadcast(every)).groupBy("gm").agg(F.median(F.abs(g - F.col("gm"))).alias("gd"))  # one row
    few = F.col("n") < least
    return own.crossJoin(F.broadcast(glob)).select("operator", "n", F.when(few, F.col("gm")).otherwise(F.col("m")).alias("centre"), F.greatest(F.when(few, F.col("gd")).otherwise(F.col("d")), F.lit(1e-6)).alias("spread"))


def vocabulary(rows: DataFrame, value: str, top: int) -> DataFrame:
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)


def fractions(rows: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Share of each listed value in a group: behaviour features of executions."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg((F.coalesce(F.col(column), F.lit("")) == v).cast("double")).alias(f"share_{v}") for v in values))


def distinct_between(pairs: DataFrame, events: DataFrame, column: str) -> DataFrame:
    """Pairs (session_id, i, j) with the number of distinct values at i .. j: places whose value was last seen before i."""
    w = Window.partitionBy("session_id", column).orderBy("idx")
    places = events.where(F.col(column).isNotNull()).select("session_id", F.col("idx").alias("k"), F.coalesce(F.lag("idx").over(w), F.lit(-1)).alias("prev"))
    inside = pairs.select("session_id", "i", "j", F.explode(F.sequence("i", "j")).alias("k")).join(places, ["session_id", "k"], "left")
    return inside.groupBy("session_id", "i", "j").agg(F.count_if(F.col("prev") < F.col("i")).alias("n_distinct"))


def distinct_at_gaps(pairs: DataFrame, events: DataFrame, column: str, gaps: Sequence[int]) -> DataFrame:
    """``distinct_between`` of pairs (session_id, i, j, gap) whose j - i are few: a place k whose value was last seen at p counts
    for the pairs that begin at max(p + 1, k - gap) .. k, so running sums of +1 and -1 replace the places of every pair."""
    w = Window.partitionBy("session_id", column).orderBy("idx")
    places = events.where(F.col(column).isNotNull()).select("session_id", F.col("idx").alias("k"), F.coalesce(F.lag("idx").over(w), F.lit(-1)).alias("prev"))
    spans = places.withColumn("gap", F.explode(F.array(*map(F.lit, gaps))))
    steps = spans.select("session_id", "gap", F.explode(F.array(F.struct(F.greatest(F.col("prev") + 1, F.col("k") - F.col("gap")).alias("i"), F.lit(1).alias("step")), F.struct((F.col("k") + 1).alias("i"), F.lit(-1).alias("step")))).alias("at"))
    both = steps.select("session_id", "gap", "at.i", F.lit(None).cast("long").alias("j"), "at.step").unionByName(pairs.select("session_id", "gap", "i", "j", F.lit(0).alias("step")))
    summed = both.withColumn("n_distinct", F.sum("step").over(Window.partitionBy("session_id", "gap").orderBy("i").rangeBetween(Window.unboundedPreceding, 0)))
    return summed.where("j IS NOT NULL").select("session_id", "i", "j", "n_distinct")


def distinct_of_pairs(events: DataFrame, label: str, column: str, gaps: Sequence[int]) -> DataFrame:
    """(session_id, i, j, n_distinct) of all pairs (i, i + gap) of labelled events: distinct values at i .. j.

    A value is there if it has come in by j, at a place more than gap after its last one, and has not gone out before i, at a place more than gap
    before its next one: differences of running counts in the session's order. Pairs are neither joined nor listed before they are counted."""
    w, own = Window.partitionBy("session_id").orderBy("idx"), Window.partitionBy("session_id", column).orderBy("idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = events.select("session_id", "idx", F.col(label).isNotNull().alias("known"), F.col(column).isNotNull().alias("valued"), (F.col("idx") - F.lag("idx").over(own)).alias("last"), (F.lead("idx").over(own) - F.col("idx")).alias("next"))
    beyond = lambda side, g: F.col("valued") & F.coalesce(F.col(side) > g, F.lit(True))
    counts = marked.withColumns({f"in_{g}": F.count_if(beyond("last", g)).over(so_far) for g in gaps} | {f"out_{g}": F.count_if(beyond("next", g)).over(so_far) - beyond("next", g).cast("long") for g in gaps})
    ends = counts.withColumns({f"at_{g}": F.first(F.when(F.col("known"), F.col(f"in_{g}"))).over(w.rangeBetween(g, g)) for g in gaps}).where("known")
    found = F.filter(F.array(*(F.struct((F.col("idx") + g).alias("j"), (F.col(f"at_{g}") - F.col(f"out_{g}")).alias("n_distinct")) for g in gaps)), lambda x: x["n_distinct"].isNotNull())
    return ends.select("session_id", F.col("idx").alias("i"), F.explode(found).alias("p")).select("session_id", "i", "p.j", "p.n_distinct")


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings, from their contingency table."""
    cells = rows.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    x, y = cells.groupBy(a).agg(F.sum("n").alias("n")), cells.groupBy(b).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())

    def sums(t: DataFrame, name: str) -> DataFrame:
        p = F.col("n") / total
        return t.withColumn("h", p * F.log(p)).agg(pairs(F.col("n")).alias(f"c_{name}"), (-F.sum("h")).alias(f"h_{name}"))

    one = sums(cells, "xy").crossJoin(sums(x, "x")).crossJoin(sums(y, "y")).crossJoin(cells.agg(F.sum("n").alias("total")))  # one row each
    expected = F.col("c_x") * F.col("c_y") / (F.col("total") * (F.col("total") - 1) / 2)
    ari = F.try_divide(F.col("c_xy") - expected, (F.col("c_x") + F.col("c_y")) / 2 - expected)
    nmi = F.try_divide(2 * (F.col("h_x") + F.col("h_y") - F.col("h_xy")), F.col("h_x") + F.col("h_y"))
    return one.select(F.coalesce(ari, F.lit(1.0)).alias("ari"), F.coalesce(nmi, F.lit(1.0)).alias("nmi"))


@dataclass
class _Hmm:
    """A diagonal Gaussian HMM and what a run of places adds to its next estimate."""

    start: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    @classmethod
    def first(cls, points: np.ndarray, var: np.ndarray, seed: int) -> _Hmm:
        """Means at the given places (all but equal ones apart by a little noise), the whole deviation, states that mostly stay."""
        k, d = points.shape
        step = np.full((k, k), 0.1 / max(1, k - 1))
        np.fill_diagonal(step, 0.9)
        return cls(np.full(k, 1 / k), step, points + np.random.default_rng(seed).normal(0, 1e-3, (k, d)), np.tile(var + 1e-3, (k, 1)))

    @classmethod
    def of(cls, flat: np.ndarray, k: int, d: int) -> _Hmm:
        start, step, mean, var = np.split(flat, np.cumsum([k, k * k, k * d]))
        return cls(start, step.reshape(k, k), mean.reshape(k, d), var.reshape(k, d))

    def flat(self) -> np.ndarray:
        return np.concatenate((self.start, self.step.ravel(), self.mean.ravel(), self.var.ravel()))

    def log_emission(self, x: np.ndarray) -> np.ndarray:
        return -0.5 * (((x[:, None] - self.mean) ** 2 / self.var).sum(axis=2) + np.log(self.var).sum(axis=1))

    def emission(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(chances up to a factor a place, sum of the factors' logarithms)."""
        log_b = self.log_emission(x)
        top = log_b.max(axis=1)
        return np.exp(log_b - top[:, None]) + 1e-12, float(top.sum())

    def carried(self, x: np.ndarray) -> np.ndarray:
        """K x K: how chances before the places become chances after them, up to a factor."""
        b, _ = self.emission(x)
        out = np.eye(len(self.start))
        for t in range(len(x)):
            out = (out @ self.step) * b[t]
            out /= out.sum()
        return out

    def carried_best(self, x: np.ndarray) -> np.ndarray:
        """K x K: logarithm of the best path from a state before the places to a state at their end."""
        log_b, log_step = self.log_emission(x), np.log(self.step)
        out = np.where(np.eye(len(self.start), dtype=bool), 0.0, -np.inf)
        for t in range(len(x)):
            out = (out[:, :, None] + log_step).max(axis=1) + log_b[t]
        return out

    def counts(self, x: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected counts of the places, flattened (start, step, weight, sums, squares), and their log likelihood given what is before.

        before: chances of the states at the place before, None where the session begins; after: backward message at the last one."""
        n, k = len(x), len(self.start)
        b, top = self.emission(x)
        alpha, beta, scale = np.empty((n, k)), np.empty((n, k)), np.empty(n)
        for t in range(n):
            a = (alpha[t - 1] @ self.step if t else self.start if before is None else before @ self.step) * b[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        beta[-1] = after / after.sum()
        for t in range(n - 2, -1, -1):
            beta[t] = self.step @ (b[t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        one, two = (alpha[:-1], slice(1, None)) if before is None else (np.vstack((before, alpha[:-1])), slice(None))
        to = b[two] * beta[two]
        weight = np.einsum("ti,ij,tj->t", one, self.step, to)
        flow = np.einsum("ti,tj->ij", one / weight[:, None], to) * self.step
        first = gamma[0] if before is None else np.zeros(k)
        return np.concatenate((first, flow.ravel(), gamma.sum(axis=0), (gamma.T @ x).ravel(), (gamma.T @ (x * x)).ravel())), float(np.log(scale).sum()) + top

    def estimated(self, counts: np.ndarray) -> _Hmm:
        k, d = self.mean.shape
        first, flow, weight, sums, squares = np.split(counts, np.cumsum([k, k * k, k, k * d]))
        start, step, weight = first + 1e-9, flow.reshape(k, k) + 1e-6, weight[:, None] + 1e-9
        mean = sums.reshape(k, d) / weight
        return _Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), mean, squares.reshape(k, d) / weight - mean**2 + 1e-3)

    def states(self, x: np.ndarray, before: np.ndarray | None, last: int | None) -> np.ndarray:
        """Viterbi states. before: best scores at the place before, None where the session begins; last: the state at the end, if known."""
        n, k = len(x), len(self.start)
        log_b, log_step = self.log_emission(x), np.log(self.step)
        best, back = np.log(self.start) if before is None else (before[:, None] + log_step).max(axis=0), np.zeros((n, k), dtype=int)
        best = best + log_b[0]
        for t in range(1, n):
            via = best[:, None] + log_step
            back[t] = via.argmax(axis=0)
            best = via.max(axis=0) + log_b[t]
        out = np.empty(n, dtype=int)
        out[-1] = best.argmax() if last is None else last
        for t in range(n - 2, -1, -1):
            out[t] = back[t + 1, out[t + 1]]
        return out


def _stands_still(now: float, last: float) -> bool:
    return abs(now - last) < 1e-4 * max(1.0, abs(last))


@dataclass
class _Hmms:
    """Diagonal Gaussian HMMs of many sessions, the sessions along the last axis: ``_Hmm`` for all of them at once."""

    start: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    @classmethod
    def first(cls, sessions: Sequence[np.ndarray], k: int, seed: int) -> _Hmms:
        each = [_Hmm.first(x[np.linspace(0, len(x) - 1, k).astype(int)], x.var(axis=0), seed) for x in sessions]
        return cls(*(np.stack([getattr(m, f) for m in each], axis=-1) for f in ("start", "step", "mean", "var")))

    def only(self, keep: np.ndarray) -> _Hmms:
        return _Hmms(*(np.ascontiguousarray(v[..., keep]) for v in (self.start, self.step, self.mean, self.var)))

    def put(self, at: np.ndarray, other: _Hmms) -> None:
        for f in ("start", "step", "mean", "var"):
            getattr(self, f)[..., at] = getattr(other, f)

    def log_emission(self, x: np.ndarray) -> np.ndarray:
        """places x states x sessions"""
        out = np.log(self.var).sum(axis=1)
        for i in range(x.shape[1]):
            out = out + (x[:, i, None] - self.mean[:, i]) ** 2 / self.var[:, i]
        return -0.5 * out

    def estimated(self, x: np.ndarray, n: np.ndarray) -> tuple[_Hmms, np.ndarray]:
        """(the next estimate, log likelihood under this one). x: places x columns x sessions of falling lengths n, 0 beyond them."""
        t_all, k = len(x), len(self.start)
        live = n > np.arange(t_all)[:, None]
        there = live.sum(axis=1)  # the first sessions, as lengths fall
        log_b = self.log_emission(x)
        top = log_b.max(axis=1)
        b = np.exp(log_b - top[:, None]) + 1e-12
        alpha, beta, scale = np.zeros_like(b), np.full_like(b, 1 / k), np.ones_like(top)
        for t in range(t_all):
            s = there[t]
            a = (np.einsum("is,ijs->js", alpha[t - 1, :, :s], self.step[:, :, :s]) if t else self.start) * b[t, :, :s]
            scale[t, :s] = a.sum(axis=0)
            alpha[t, :, :s] = a / scale[t, :s]
        for t in range(t_all - 2, -1, -1):
            s = there[t + 1]
            v = np.einsum("ijs,js->is", self.step[:, :, :s], b[t + 1, :, :s] * beta[t + 1, :, :s])
            beta[t, :, :s] = v / v.sum(axis=0)
        gamma = alpha * beta
        held = gamma.sum(axis=1)
        weight = np.where(live[1:], scale[1:] * held[1:], np.inf)  # chance of a step's flow, from what comes out of it
        flow = np.einsum("tis,tjs->ijs", alpha[:-1] / weight[:, None], b[1:] * beta[1:]) * self.step
        gamma /= np.where(live, held, 1.0)[:, None]
        start, step, mass = gamma[0] + 1e-9, flow + 1e-6, gamma.sum(axis=0)[:, None] + 1e-9
        mean = np.einsum("tks,tds->kds", gamma, x) / mass
        var = np.einsum("tks,tds->kds", gamma, x * x) / mass - mean**2 + 1e-3
        found = np.where(live, np.log(scale) + top, 0.0).sum(axis=0)
        return _Hmms(start / start.sum(axis=0), step / step.sum(axis=1, keepdims=True), mean, var), found

    def states(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Viterbi states, places x sessions."""
        t_all, k = len(x), len(self.start)
        there = (n > np.arange(t_all)[:, None]).sum(axis=1)
        log_b, log_step = self.log_emission(x), np.log(self.step)
        best, back = np.log(self.start) + log_b[0], np.zeros((t_all, k, len(n)), dtype=np.int8)
        for t in range(1, t_all):
            s = there[t]
            via = best[:, None, :s] + log_step[:, :, :s]
            back[t, :, :s] = via.argmax(axis=0)
            best[:, :s] = via.max(axis=0) + log_b[t, :, :s]  # those that have ended keep their last scores
        out, at = np.empty((t_all, len(n)), dtype=int), best.argmax(axis=0)
        for t in range(t_all - 1, -1, -1):
            if t + 1 < t_all:
                s = there[t + 1]
                at[:s] = back[t + 1, at[:s], np.arange(s)]
            out[t] = at
        return out


def _hmm_states(sessions: Sequence[np.ndarray], k: int, rounds: int, seed: int, at_once: int = 32768) -> list[np.ndarray]:
    """Viterbi states of each session's diagonal Gaussian HMM, fitted by Baum-Welch, in scaled arithmetic, until its likelihood stands
    still (a ten-thousandth) or the rounds are over. Sessions of like lengths go together, ``at_once`` places of them at most."""
    out = [np.zeros(len(x), dtype=int) for x in sessions]
    order = [int(i) for i in np.argsort([-len(x) for x in sessions], kind="stable") if len(sessions[i]) >= 2 * k]
    while order:
        now = order[: max(1, at_once // len(sessions[order[0]]))]
        order = order[len(now) :]
        n = np.array([len(sessions[i]) for i in now])
        x = np.zeros((n[0], sessions[now[0]].shape[1], len(now)))
        for s, i in enumerate(now):
            x[: n[s], :, s] = sessions[i]
        models = _Hmms.first([sessions[i] for i in now], k, seed)
        last, todo = np.full(len(now), -np.inf), np.arange(len(now))
        for _ in range(rounds):
            part = x if len(todo) == len(now) else np.ascontiguousarray(x[: n[todo[0]], :, todo])
            found, likelihood = models.only(todo).estimated(part, n[todo])
            models.put(todo, found)
            going = [not _stands_still(a, b) for a, b in zip(likelihood, last[todo], strict=True)]
            last[todo] = likelihood
            todo = todo[going]
            if not len(todo):
                break
        states = models.states(x, n)
        for s, i in enumerate(now):
            out[i] = states[: n[s], s]
    return out


def _gaussian_hmm(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """The states of one session."""
    return _hmm_states([x], k, rounds, seed)[0]


def hmm_boundaries(rows: DataFrame, columns: Sequence[str], states: Sequence[int], rounds: int = 30, seed: int = 7, most: int = 4096, places_at_once: int = 250_000) -> DataFrame:
    """State changes of a Gaussian HMM per session, for each number of states: (session_id, k, idx, boundary). Sessions are fitted
    in parallel.

    A session of up to ``most`` places is fitted by one task, in step with others of like length. A longer one is cut into pieces of that many places, and its one model is fitted
    over all of them, with the same result: in each round every piece tells how it carries chances from its beginning to its end (K x K
    numbers), a session's pieces are put in a row to give each the chances before it and after it, and the pieces' expected counts are summed.
    The best path is found in the same way. No task holds more places than a piece has; a session's pieces meet as K x K numbers each."""
    ready = standardised(vectors(rows, columns, ["session_id", "idx"]), columns, ["session_id"])
    d, wide = len(columns), F.count("*").over(Window.partitionBy("session_id"))
    sized = ready.withColumns({"n": wide, "at": F.row_number().over(Window.partitionBy("session_id").orderBy("idx")) - 1})
    sized = written(sized, "places")
    short, long = sized.where(F.col("n") <= most), sized.where(F.col("n") > most)
    out_schema = "session_id string, k int, idx long, boundary boolean"
    spread = lambda t: t.withColumn("k", F.explode(F.array(*map(F.lit, states))))

    def fit(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Boundaries of whole sessions, one after the other in order of their places."""
        starts = np.flatnonzero(np.append(True, part["session_id"].to_numpy()[1:] != part["session_id"].to_numpy()[:-1]))
        sessions = np.split(part[list(columns)].to_numpy(float), starts[1:])
        for k in states:
            found = np.concatenate(_hmm_states(sessions, k, rounds, seed))
            changed = np.append(False, found[1:] != found[:-1])
            changed[starts] = False
            yield pd.DataFrame({"session_id": part["session_id"], "k": np.full(len(part), k, dtype=np.int32), "idx": part["idx"], "boundary": changed})

    def fitted_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sessions of a partition, some hundred thousand places of them at a time."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > places_at_once:
                part = pd.concat(held, ignore_index=True)
                ended = int((part["session_id"] != part["session_id"].iloc[-1]).to_numpy().sum())  # the last one may go on in the next batch
                if ended:
                    yield from fit(part.iloc[:ended].reset_index(drop=True))
                held, size = [part.iloc[ended:]], len(part) - ended
        if size:
            yield from fit(pd.concat(held, ignore_index=True))

    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism  # by number, as few bytes here are much work
    whole = short.select("session_id", "idx", *columns).repartition(tasks, "session_id").sortWithinPartitions("session_id", "idx").mapInPandas(fitted_together, out_schema)
    if not long.limit(1).count():
        return whole

    # one row a piece: its places' values one after the other
    values = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "idx", F.array(*columns).alias("x")))), lambda p: p["x"]))
    places = F.transform(F.array_sort(F.collect_list(F.struct("at", "idx"))), lambda p: p["idx"])
    pieces = written(long.withColumn("piece", F.floor(F.col("at") / most)).groupBy("session_id", "piece", "n").agg(values.alias("x"), places.alias("idx")), "pieces")
    pieces = spread(pieces)

    def begun(group: pd.DataFrame) -> pd.DataFrame:
        """The first model of a session: values at K places and the deviation over all of them."""
        k = int(group["k"].iloc[0])
        g = group.sort_values("at")
        points = np.array(g["x"].tolist())[np.searchsorted(g["at"].to_numpy(), np.linspace(0, int(g["n"].iloc[0]) - 1, k).astype(int))]
        return pd.DataFrame({"session_id": [g["session_id"].iloc[0]], "k": [k], "model": [_Hmm.first(points, np.array(g["var"].iloc[0]), seed).flat()], "likelihood": [-np.inf], "done": [False]})

    model_schema = "session_id string, k int, model array<double>, likelihood double, done boolean"
    deviation = long.groupBy("session_id").agg(F.array(*(F.var_pop(c) for c in columns)).alias("var"))
    wanted = spread(long.select("session_id", "n").distinct()).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.floor(i * (F.col("n") - 1) / F.greatest(F.col("k") - 1, F.lit(1))).cast("int"))))
    points = wanted.join(long.select("session_id", "at", F.array(*columns).alias("x")), ["session_id", "at"]).join(deviation, "session_id")
    models = written(points.groupBy("session_id", "k").applyInPandas(begun, model_schema), "models")

    def mapped(f, schema: str, *more: DataFrame) -> DataFrame:
        """f(x, model, row) of every piece that is still worked on; more: tables by (session_id, k, piece)."""
        joined = pieces.join(models, ["session_id", "k"])
        for t in more:
            joined = joined.join(t, ["session_id", "k", "piece"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = [f(np.asarray(r.x, float).reshape(-1, d), _Hmm.of(np.asarray(r.model, float), r.k, d), r) for r in batch.itertuples()]
                yield pd.DataFrame({"session_id": batch["session_id"], "k": batch["k"], "piece": batch["piece"]} | {c: [m[i] for m in made] for i, c in enumerate(names)})

        names = [c.split()[0] for c in schema.split(", ")]
        return joined.mapInPandas(run, f"session_id string, k int, piece long, {schema}")

    def borders(group: pd.DataFrame) -> pd.DataFrame:
        """What each piece has before it and after it, from what the pieces carry."""
        g = group.sort_values("piece")
        k = int(g["k"].iloc[0])
        carried = [np.asarray(c, float).reshape(k, k) for c in g["carried"]]
        before, after = [None], [np.ones(k)]
        v = np.asarray(g["first"].iloc[0], float)  # chances at the end of the first piece, which begins with the start's
        for c in carried[1:]:
            before.append(v / v.sum())
            v = before[-1] @ c
        for c in carried[:0:-1]:
            w = c @ after[-1]
            after.append(w / w.sum())
        return pd.DataFrame({"session_id": g["session_id"], "k": g["k"], "piece": g["piece"], "before": before, "after": after[::-1]})

    def end_of_first(x: np.ndarray, model: _Hmm) -> np.ndarray:
        b, _ = model.emission(x)
        a = model.start * b[0]
        for t in range(1, len(x)):
            a = a / a.sum() @ model.step * b[t]
        return a

    def updated(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["k"].iloc[0])
        likelihood, last = float(group["found"].sum()), float(group["likelihood"].iloc[0])
        counts = np.sum([np.asarray(c, float) for c in group.sort_values("piece")["counts"]], axis=0)
        model = _Hmm.of(np.asarray(group["model"].iloc[0], float), k, d).estimated(counts)
        return pd.DataFrame({"session_id": group["session_id"].iloc[:1], "k": [k], "model": [model.flat()], "likelihood": [likelihood], "done": [_stands_still(likelihood, last)]})

    finished = None
    for _ in range(rounds):
        told = mapped(lambda x, m, r: (m.carried(x).ravel(), end_of_first(x, m) if r.piece == 0 else None), "carried array<double>, first array<double>")
        told = told.groupBy("session_id", "k").applyInPandas(borders, "session_id string, k int, piece long, before array<double>, after array<double>")
        counted = mapped(lambda x, m, r: m.counts(x, None if r.before is None else np.asarray(r.before, float), np.asarray(r.after, float)), "counts array<double>, found double", written(told, "borders"))
        after = written(counted.join(models, ["session_id", "k"]).groupBy("session_id", "k").applyInPandas(updated, model_schema), "models")
        ended = after.where("done")
        finished = ended if finished is None else finished.unionByName(ended)
        models = after.where("NOT done")
        if not models.limit(1).count():
            break
    models = written(finished.unionByName(models), "models")

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        """The best scores before each piece and the state at its end, on the best path through all of them."""
        g = group.sort_values("piece")
        k = int(g["k"].iloc[0])
        best = [np.asarray(g["first"].iloc[0], float)]
        carried = [np.asarray(c, float).reshape(k, k) for c in g["carried"]]
        for c in carried[1:]:
            best.append((best[-1][:, None] + c).max(axis=0))
        last = [int(best[-1].argmax())]
        for i in range(len(carried) - 1, 0, -1):
            last.append(int((best[i - 1] + carried[i][:, last[-1]]).argmax()))
        return pd.DataFrame({"session_id": g["session_id"], "k": g["k"], "piece": g["piece"], "before": [None, *best[:-1]], "last": last[::-1], "previous": [-1, *last[:0:-1]]})

    def best_of_first(x: np.ndarray, model: _Hmm) -> np.ndarray:
        log_b, log_step = model.log_emission(x), np.log(model.step)
        best = np.log(model.start) + log_b[0]
        for t in range(1, len(x)):
            best = (best[:, None] + log_step).max(axis=0) + log_b[t]
        return best

    told = mapped(lambda x, m, r: (m.carried_best(x).ravel(), best_of_first(x, m) if r.piece == 0 else None), "carried array<double>, first array<double>")
    told = told.groupBy("session_id", "k").applyInPandas(ends, "session_id string, k int, piece long, before array<double>, last int, previous int")

    def changes(x: np.ndarray, m: _Hmm, r) -> tuple[list, list]:
        found = m.states(x, None if r.before is None else np.asarray(r.before, float), int(r.last))
        return list(r.idx), [bool(v) for v in np.append(r.previous not in (-1, found[0]), found[1:] != found[:-1])]

    each = mapped(changes, "places array<long>, flags array<boolean>", written(told, "ends"))
    flat = each.select("session_id", "k", F.explode(F.arrays_zip("places", "flags")).alias("p")).select("session_id", "k", F.col("p.places").alias("idx"), F.col("p.flags").alias("boundary"))
    return whole.unionByName(flat)


@dataclass
class _Starts:
    """Places that may begin a later segment of an optimum, with the best cost up to them and the sums there."""

    place: np.ndarray
    best: np.ndarray
    s: np.ndarray
    q: np.ndarray
    n: np.ndarray


def _onward(starts: _Starts, place: np.ndarray, s: np.ndarray, q: np.ndarray, n: np.ndarray, penalty: float) -> tuple[np.ndarray, _Starts]:
    """(start of the last segment up to each place, the starts that are left). A start whose cost up to here exceeds the best one up to
    here can begin no later segment of an optimum, as a cut never raises the cost of what it divides; so only the starts that
    are left are compared, without loss."""
    at = _Starts(starts.place.copy(), starts.best.copy(), starts.s.copy(), starts.q.copy(), starts.n.copy())
    back = np.empty(len(place), dtype=np.int64)
    for j in range(len(place)):
        cost = at.best + (q[j] - at.q) - (s[j] - at.s) ** 2 / np.maximum(n[j] - at.n, 1)
        k = int(cost.argmin())
        back[j], best = at.place[k], cost[k] + penalty
        keep = cost <= best + 1e-9 * (1 + abs(q[j]))  # room for rounding
        at = _Starts(*(np.append(old[keep], new) for old, new in ((at.place, place[j]), (at.best, best), (at.s, s[j]), (at.q, q[j]), (at.n, n[j]))))
    return back, at


def _none_yet() -> _Starts:
    return _Starts(np.array([-1]), np.zeros(1), np.zeros(1), np.zeros(1), np.zeros(1))


def _followed(place: np.ndarray, back: np.ndarray, at: int) -> tuple[list[int], int]:
    """(cuts, the first one's start) from a place of these backwards, as far as they reach."""
    cuts, where = [], {int(p): i for i, p in enumerate(place)}
    while at in where:
        cuts.append(at)
        at = int(back[where[at]])
    return cuts[::-1], at


def _cuts(s: np.ndarray, q: np.ndarray, n: np.ndarray, penalty: float) -> list[int]:
    """Numbers of the optimal cuts among candidates with the sums s[1:], q[1:], n[1:]; s[0], q[0] and n[0] are 0."""
    place = np.arange(1, len(s))
    return _followed(place, _onward(_none_yet(), place, s[1:], q[1:], n[1:], penalty)[0], len(s) - 1)[0]


def _cuts_together(sessions: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], penalties: Sequence[float]) -> list[list[list[int]]]:
    """Numbers of the optimal cuts of many short sessions (sums s, squares q and counts n of each), by session and penalty. A segment's cost is the same
    for all penalties, so each end is compared with all starts once for all sessions that reach it."""
    order = np.argsort([-len(s) for s, _, _ in sessions], kind="stable")
    size = np.array([len(sessions[i][0]) for i in order])
    sums = np.zeros((3, size[0] + 1, len(order)))
    for c, i in enumerate(order):
        for r in range(3):
            sums[r, 1 : size[c] + 1, c] = sessions[i][r]
    s, q, n = sums
    price = np.asarray(penalties, dtype=float)[:, None]
    best, back = np.zeros((len(price), size[0] + 1, len(order))), np.zeros((len(price), size[0] + 1, len(order)), dtype=np.int32)
    for j in range(1, size[0] + 1):
        m = int((size >= j).sum())
        cost = best[:, :j, :m] + ((q[j, :m] - q[:j, :m]) - (s[j, :m] - s[:j, :m]) ** 2 / np.maximum(n[j, :m] - n[:j, :m], 1))
        at = cost.argmin(axis=1)
        back[:, j, :m] = at
        best[:, j, :m] = np.take_along_axis(cost, at[:, None], axis=1)[:, 0] + price
    out: list = [None] * len(order)
    for c, i in enumerate(order):
        out[i] = []
        for p in range(len(price)):
            row, cuts, at = back[p, :, c], [], int(size[c])
            while at > 0:
                cuts.append(at)
                at = int(row[at])
            out[i].append(cuts[::-1])
    return out


def best_cuts(candidates: DataFrame, penalties: float | Sequence[float], most: int = 16384, few: int = 256, places_at_once: int = 100_000) -> DataFrame:
    """Optimal choice among candidate cuts: least sum of segment costs plus a penalty per segment. candidates: (session_id, place,
    value): cumulative sums s and squares q and counts n of the signal up to each candidate place, in order; a session's last one is always a cut.
    -> (session_id, place); with a list of penalties (session_id, penalty, place), all from one pass.

    A session with up to ``most`` candidates is solved by one task, those with up to ``few`` many at a time. A longer one goes on in pieces of that many: the starts that can still
    matter are handed from a piece to the next, and in the end the cuts are followed from the last piece back, so that the optimum
    is that of the whole session. There are as many rounds as the longest session has pieces."""
    single = isinstance(penalties, (int, float))
    swept = [float(penalties)] if single else [float(p) for p in penalties]
    w = Window.partitionBy("session_id").orderBy("place")
    numbered = candidates.select("session_id", F.col("place").cast("long").alias("place"), *(F.col(c).cast("double").alias(c) for c in ("s", "q", "n")))
    numbered = numbered.withColumns({"piece": F.floor((F.row_number().over(w) - 1) / most), "last": F.max("place").over(Window.partitionBy("session_id")), "many": F.count("*").over(Window.partitionBy("session_id"))})
    each = written(numbered, "candidates")
    known = each.withColumn("penalty", F.explode(F.array(*map(F.lit, swept))))
    keys, sums = ["session_id", "penalty"], ["s", "q", "n"]
    out_schema = "session_id string, penalty double, place long"

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        """Cuts of whole sessions, one after the other in order of their places."""
        names, place = part["session_id"].to_numpy(), part["place"].to_numpy()
        starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        own = [np.split(part[c].to_numpy(float), starts[1:]) for c in sums]
        sessions = list(zip(*own, strict=True))
        found: list = [None] * len(sessions)
        short = sorted((i for i, x in enumerate(sessions) if len(x[0]) <= few), key=lambda i: -len(sessions[i][0]))
        while short:  # those of like numbers of candidates together, within bounds of memory
            now = short[: max(1, 200_000 // (len(sessions[short[0]][0]) * len(swept)))]
            short = short[len(now) :]
            for i, cuts in zip(now, _cuts_together([sessions[i] for i in now], swept), strict=True):
                found[i] = cuts
        for i, x in enumerate(sessions):
            if found[i] is None:
                found[i] = [_cuts(*(np.append(0.0, v) for v in x), p) for p in swept]
        rows = [(i, p, c) for i, by in enumerate(found) for p, cuts in zip(swept, by, strict=True) for c in cuts]
        at = np.array([(i, c) for i, _, c in rows]).reshape(-1, 2)
        return pd.DataFrame({"session_id": names[starts][at[:, 0]], "penalty": [p for _, p, _ in rows], "place": place[starts[at[:, 0]] + at[:, 1] - 1]})

    def solved_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > places_at_once:
                part = pd.concat(held, ignore_index=True)
                ended = int((part["session_id"] != part["session_id"].iloc[-1]).to_numpy().sum())  # the last one may go on in the next batch
                if ended:
                    yield solve(part.iloc[:ended].reset_index(drop=True))
                held, size = [part.iloc[ended:]], len(part) - ended
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    tasks = 3 * candidates.sparkSession.sparkContext.defaultParallelism
    short = each.where(F.col("many") <= most).select("session_id", "place", *sums)
    out = short.repartition(tasks, "session_id").sortWithinPartitions("session_id", "place").mapInPandas(solved_together, out_schema)
    long = known.where(F.col("many") > most)
    rounds = (long.agg(F.max("piece")).first()[0] or 0) + 1

    # kind 0: a place and the start of its last segment; kind 1: a start that is left
    step_schema = "session_id string, penalty double, kind int, place long, back long, best double, s double, q double, n double"

    def onward(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        g, st = left.sort_values("place"), right.sort_values("place")
        if not len(g):
            return right[[c.split()[0] for c in step_schema.split(", ")]]
        starts = _Starts(*(st[c].to_numpy() for c in ("place", "best", *sums))) if len(st) else _none_yet()
        back, at = _onward(starts, g["place"].to_numpy(), *(g[c].to_numpy() for c in sums), float(g["penalty"].iloc[0]))
        solved = pd.DataFrame({"kind": 0, "place": g["place"].to_numpy(), "back": back, "best": 0.0, "s": 0.0, "q": 0.0, "n": 0.0})
        alive = pd.DataFrame({"kind": 1, "place": at.place, "back": -1, "best": at.best, "s": at.s, "q": at.q, "n": at.n})
        both = pd.concat([solved, alive], ignore_index=True)
        both.insert(0, "session_id", g["session_id"].iloc[0])
        both.insert(1, "penalty", g["penalty"].iloc[0])
        return both

    def backward(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """kind 0: a cut; kind 1: the place to go on from."""
        if not len(right):
            return pd.DataFrame({"session_id": [], "penalty": [], "kind": [], "place": []})
        cuts, at = _followed(left["place"].to_numpy(), left["back"].to_numpy(), int(right["place"].iloc[0]))
        return pd.DataFrame({"session_id": right["session_id"].iloc[0], "penalty": right["penalty"].iloc[0], "kind": [0] * len(cuts) + [1], "place": [*cuts, at]})

    if rounds > 1:
        spark = candidates.sparkSession
        state, solved = spark.createDataFrame([], step_schema), []
        for p in range(rounds):
            made = written(long.where(F.col("piece") == p).groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(onward, step_schema), "onward")
            state = made.where("kind = 1")
            solved.append(made.where("kind = 0"))
        at = long.select(*keys, F.col("last").alias("place")).distinct()
        for p in reversed(range(rounds)):
            made = written(solved[p].groupBy(*keys).cogroup(at.groupBy(*keys)).applyInPandas(backward, "session_id string, penalty double, kind int, place long"), "backward")
            at = made.where("kind = 1").select(*keys, "place")
            out = out.unionByName(made.where("kind = 0").select(*keys, "place"))
    return out.drop("penalty") if single else out


def clusters(rows: DataFrame, columns: Sequence[str], sizes: Sequence[int], keep: Sequence[str], seed: int = 5) -> DataFrame:
    """KMeans at several sizes: (kept columns, k, cluster)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = written(VectorAssembler(inputCols=list(columns), outputCol="features").transform(vectors(rows, columns, keep)), "vectors")
    out = None
    for k in sizes:
        part = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(ready).transform(ready).select(*keep, F.lit(k).alias("k"), "cluster")
        out = part if out is None else out.unionByName(part)
    return out
