"""Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A document is the average of its features' embeddings, so its class scores are the average of one number per
feature and class: after training, embeddings and output layer are folded into a table of ``buckets`` x
classes, and scoring is a table look-up per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.text import chunks, ragged

#: (buckets of all features, where each text's begin): the features of the texts of a column, without offsets
Features = Callable[[pa.Array], list[tuple[np.ndarray, np.ndarray]]]


@dataclass
class Model:
    classes: list
    table: np.ndarray  # (classes, buckets), float32
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(texts, classes); a text without features has the bias only."""
        n = len(features[0][1]) - 1
        total, count = np.zeros((n, len(self.classes))), np.zeros(n)
        for buckets, off in features:
            count += np.diff(off)
            for c, row in enumerate(self.table):
                run = np.concatenate((np.zeros(1), np.cumsum(row[buckets], dtype=np.float64)))
                total[:, c] += run[off[1:]] - run[off[:-1]]
        return (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature

    def probabilities(self, features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return softmax(self.logits(features))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


#: A text's distinct buckets and their share of its features.
Sparse = tuple[np.ndarray, np.ndarray]


def sparse(column: pa.Array, features: Features) -> list[Sparse]:
    found, out = features(column), []
    for i in range(len(column)):
        buckets, n = np.unique(np.concatenate([b[off[i] : off[i + 1]] for b, off in found]), return_counts=True)
        out.append((buckets.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(rows: list[Sparse], labels: list, buckets: int, dim: int = 8, epochs: int = 4, rate: float = 0.3, seed: int = 1) -> Model:
    """rows: the features of labelled texts. Every tenth is held back to set the temperature, so that the probabilities are calibrated."""
    classes = sorted(set(labels))
    if len(classes) < 2:
        return Model(classes or [None], np.zeros((max(1, len(classes)), buckets), np.float32), np.zeros(max(1, len(classes))))
    y = np.array([classes.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    output, bias = rng.normal(0, 0.5, (dim, len(classes))), np.log(np.bincount(y, minlength=len(classes)) / len(y))
    seen_in, seen_out = np.full(buckets, 1e-8, np.float32), np.full(dim, 1e-8)
    back = np.arange(len(y)) % 10 == 9
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(np.flatnonzero(~back)):
            at, share = rows[i]
            if not len(at):
                continue
            mean = share @ embedding[at]
            slope = softmax(mean @ output + bias)
            slope[y[i]] -= 1
            down, across = output @ slope, np.outer(mean, slope)
            size = float(down @ down) / dim
            seen_in[at] += share * share * size
            embedding[at] -= np.outer(step * share / np.sqrt(seen_in[at]), down).astype(np.float32)
            seen_out += (across * across).mean(axis=1)
            output -= (step / np.sqrt(seen_out))[:, None] * across
            bias -= 0.02 * step * slope
    model = Model(classes, (embedding @ output).T.astype(np.float32), bias)
    held = [i for i in np.flatnonzero(back) if len(rows[i][0])]
    if held:
        logits = np.array([(model.table[:, rows[i][0]] * rows[i][1]).sum(axis=1) + bias for i in held])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        model.temperature = min((0.25 * 1.25**k for k in range(16)), key=loss)
    return model


def drawn(docs: DataFrame, labels: DataFrame | None, label: str, most: int) -> DataFrame:
    """About ``most`` labelled rows at most, as (h, text, label): those of docs(doc_id, text) whose hash h of id and text falls into
    the part of all labelled rows that ``most`` is, whatever the length of their texts, each once. labels(doc_id, label);
    without it, docs has the label. Rows are drawn before they are joined or counted, so no task and no merge sees more than that part."""
    known = docs.where("text <> ''")
    have = known.where(f"{label} IS NOT NULL") if labels is None else known.select("doc_id").join(labels, "doc_id")
    share = min(1.0, most / max(1, have.count()))
    h = F.xxhash64("doc_id", "text")
    taken = known.withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    taken = taken.where(f"{label} IS NOT NULL") if labels is None else taken.join(labels, "doc_id")
    return taken.groupBy("h", label).agg(F.first("text").alias("text")).select("h", "text", label)


def featured(rows: DataFrame, label: str, features: Features) -> tuple[list[Sparse], list]:
    """The features of drawn rows and their labels, in order of h. Features are made where the rows are: a row sends
    at most as many numbers as there are buckets, however long its text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = sparse(batch.column(1), features)
            sizes = np.array([len(b) for b, _ in found])
            cols = [ragged(np.concatenate([x[k] for x in found]), sizes, kind) for k, kind in enumerate((pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["h", label, "buckets", "share"])

    kind = dict(rows.dtypes)[label]
    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    table = spread.mapInArrow(run, f"h long, {label} {kind}, buckets array<int>, share array<float>").toArrow()
    order = np.lexsort((np.array([str(x) for x in table.column(label).to_pylist()]), table.column("h").to_numpy()))
    table = table.take(pa.array(order)).combine_chunks()
    pairs = [(table.column("buckets")[i].values.to_numpy(), table.column("share")[i].values.to_numpy()) for i in range(table.num_rows)]
    return pairs, table.column(label).to_pylist()


def code_points(buf: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a buffer (see text.buffer_of) as code points, and where each text begins."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[base]


def char_grams(x: np.ndarray, base: np.ndarray, n: int, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the grams of n code points of the texts (see code_points): each text has as many grams as it and the space
    after it allow. The last grams of a text reach into nothing but that space."""
    h = np.full(len(x) - n + 1 if len(x) >= n else 0, n * 0x85EBCA6B & 0xFFFFFFFF, dtype=np.uint32)
    for i in range(n):
        h = (h ^ x[i : i + len(h)]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    inside = np.maximum(np.diff(base) - n + 1, 0)
    lost = np.diff(base) - inside  # grams that would reach into the next text
    keep = np.ones(len(h), dtype=bool)
    for d in range(1, int(lost.max(initial=0)) + 1):
        at = base[1:] - d
        keep[at[(lost >= d) & (at < len(h))]] = False
    return (h[keep] & np.uint32(mask)).astype(np.int64), np.concatenate(([0], np.cumsum(inside)))
