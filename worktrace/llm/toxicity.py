"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are words and beginnings of words, present in a document or not. The model has one weight per feature, shared
by all ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w.x). Grades: 0 for texts not labelled toxic;
toxic ones are graded 1 .. GRADES - 1 by how many different features they have that mark toxic texts in the
training sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm.store import forget, keep
from worktrace.llm.subwords import drawn
from worktrace.llm.text import ALNUM, Words, chunks, ragged, slice_hashes, words_of

GRADES = 3
#: Lengths in bytes of the beginnings of words.
STEMS = (4, 5, 6)
#: Rows of the training sample, features kept.
TRAIN_ROWS, FEATURES = 5000, 4096
#: Least z value of the difference in document frequency for a feature to be kept.
LEAST_Z = 5.0
#: Least ratio of the document frequencies (either way) for a feature to be kept.
LEAST_RATIO = 4.0
#: A document is toxic from this chance of a grade over 0 on; where the chance without any marking feature comes
#: near it (few labels), from three times that chance.
TOXIC = 0.1


def _features(words: Words) -> list[np.ndarray]:
    """One array of hashes for each kind of feature, all with an entry for each word."""
    out = [words.hashes()]
    for n in STEMS:
        out.append(slice_hashes(words.buf, words.starts, np.minimum(words.starts + n, words.ends)) * np.uint64(2 * n + 1))
    return out


@dataclass
class OrdinalModel:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, GRADES - 1
    known: np.ndarray  # by a hash's high bits

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of the kept features, each once."""
        words = words_of(column, ALNUM, lower=True)
        doc, found = [], []
        owner = words.doc
        for hashes in _features(words):
            maybe = np.flatnonzero(self.known[hashes >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[maybe]
            doc.append(owner[maybe[hit]])
            found.append(at[hit])
        pair = np.unique(np.concatenate(doc) * len(self.hashes) + np.concatenate(found))
        return pair // len(self.hashes), pair % len(self.hashes)

    @property
    def toxic_from(self) -> float:
        return max(TOXIC, min(0.5, 3 * (1 - self.grades(pa.array([""]))[0, 0])))

    def grades(self, column: pa.Array) -> np.ndarray:
        """(texts, GRADES) chances."""
        value = np.zeros(len(column))
        if len(self.hashes):
            doc, feature = self.present(column)
            value = np.bincount(doc, weights=self.weights[feature], minlength=len(column))
        up_to = 1 / (1 + np.exp(-np.clip(self.thresholds - value[:, None], -30, 30)))
        return np.diff(up_to, prepend=0, append=1, axis=1)


def _known(hashes: np.ndarray) -> np.ndarray:
    known = np.zeros(1 << 20, dtype=bool)
    known[hashes >> np.uint64(44)] = True
    return known


def distinct_features(column: pa.Array) -> list[np.ndarray]:
    """The features of each text, each once, sorted."""
    words = words_of(column, ALNUM, lower=True)
    kinds, off = _features(words), words.off
    return [np.unique(np.concatenate([k[a:b] for k in kinds])) for a, b in zip(off[:-1], off[1:], strict=True)]


def train(rows: list[np.ndarray], toxic: list[int], steps: int = 400, penalty: float = 1e-5) -> OrdinalModel:
    """rows: the distinct features of labelled texts. All of them at once: for texts that the caller holds."""
    y, none = np.array(toxic), np.zeros(0, np.uint64)
    clean, marked = (np.unique(np.concatenate([none, *(r for r, mark in zip(rows, y, strict=True) if mark == label)]), return_counts=True) for label in (0, 1))
    names = np.union1d(clean[0], marked[0])
    n0, n1 = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for n, (values, counts) in ((n0, clean), (n1, marked)):
        n[np.searchsorted(names, values)] = counts
    m1, m0 = int(y.sum()), int(len(y) - y.sum())
    z = _z(n0, n1, max(1, m0), max(1, m1))
    best = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    best = np.sort(best[np.abs(z[best]) >= LEAST_Z])  # by hash, as names are
    at = [np.flatnonzero(np.isin(names[best], r, assume_unique=True)) for r in rows]
    return fit(names[best], z[best] > 0, at, y, steps, penalty)


def _z(n0: np.ndarray, n1: np.ndarray, m0: int, m1: int) -> np.ndarray:
    """z values of the differences in document frequency among m0 clean and m1 toxic texts; texts differ in length and so in how
    many common words they have, so that only marked differences count, others are 0."""
    pooled = (n0 + n1) / (m0 + m1)
    z = (n1 / m1 - n0 / m0) / np.sqrt(pooled * (1 - pooled) * (1 / m0 + 1 / m1) + 1e-12)
    odds = ((n1 + 0.5) / (m1 + 1)) / ((n0 + 0.5) / (m0 + 1))
    return np.where((odds < LEAST_RATIO) & (odds > 1 / LEAST_RATIO), 0.0, z)


def telling(features: DataFrame, m0: int, m1: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, whether each marks toxic texts) of the FEATURES most telling features of features(label, features array<long>), in
    order of the hash without sign. Counted by Spark, with partial sums; only those that are kept come to the driver."""
    counts = features.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = (n0 + n1) / (m0 + m1)
    z = (n1 / m1 - n0 / m0) / F.sqrt(pooled * (1 - pooled) * (1 / m0 + 1 / m1) + 1e-12)
    odds = ((n1 + 0.5) / (m1 + 1)) / ((n0 + 0.5) / (m0 + 1))
    marked = counts.withColumn("z", z).where((F.abs("z") >= LEAST_Z) & ((odds >= LEAST_RATIO) | (odds <= 1 / LEAST_RATIO)))
    best = marked.orderBy(F.desc(F.abs("z")), F.col("f") < 0, "f").limit(FEATURES).select("f", "z").toArrow()
    hashes = best.column("f").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], best.column("z").to_numpy()[order] > 0


def fit(hashes: np.ndarray, marking: np.ndarray, at: list[np.ndarray], y: np.ndarray, steps: int = 400, penalty: float = 1e-5) -> OrdinalModel:
    """hashes: kept features, sorted, and whether each marks toxic texts; at: places in hashes of each text's features; y: toxic or not."""
    none = np.zeros(0, np.uint64)
    flat = OrdinalModel(none, np.zeros(0), np.linspace(6, 8, GRADES - 1), _known(none))
    if not len(y) or y.min() == y.max() or not len(hashes):
        return flat
    m1, m0 = int(y.sum()), int((1 - y).sum())
    model = OrdinalModel(hashes, np.zeros(len(hashes)), np.zeros(GRADES - 1), _known(hashes))
    doc, feature = np.repeat(np.arange(len(at)), list(map(len, at))), np.concatenate(at)
    # grades of toxic texts: equal parts by the number of different marking features
    markers = np.bincount(doc, weights=marking[feature], minlength=len(y))
    cuts = np.quantile(markers[y == 1], np.linspace(0, 1, GRADES)[1:-1])
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, markers, side="right"), 0)
    # gradient descent on the cumulative-link likelihood; thresholds stay ordered through their log gaps
    w, first, gaps = np.zeros(len(hashes)), np.log(m0 / m1), np.zeros(GRADES - 2)
    memory = [np.full_like(w, 1e-8), 1e-8, np.full_like(gaps, 1e-8)]
    for _ in range(steps):
        cut = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(doc, weights=w[feature], minlength=len(y))
        high = 1 / (1 + np.exp(-np.clip(np.append(cut, 1e9)[grade] - score, -30, 30)))
        low = np.where(grade > 0, 1 / (1 + np.exp(-np.clip(np.concatenate(([0.0], cut))[grade] - score, -30, 30))), 0.0)
        chance = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        d_high[grade == GRADES - 1] = 0
        by_cut = np.array([(d_high * (grade == k) - d_low * (grade == k + 1)).sum() for k in range(GRADES - 1)]) / len(y)
        d_w = np.bincount(feature, weights=(d_low - d_high)[doc], minlength=len(hashes)) / len(y) - penalty * w
        d_first, d_gaps = by_cut.sum(), np.array([by_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 2)])
        for i, g in enumerate((d_w, d_first, d_gaps)):
            memory[i] = memory[i] + g * g
        w = w + d_w / np.sqrt(memory[0])
        first = first + d_first / np.sqrt(memory[1])
        gaps = gaps + 0.3 * d_gaps / np.sqrt(memory[2])
    model.weights, model.thresholds = w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return model


def _pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _trained(docs: DataFrame, labels: DataFrame, learn: Column | None = None, texts_from: DataFrame | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text"):
    """The model, broadcast."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    base = _pick(docs if texts_from is None else texts_from, id_col, text_col)
    taken = drawn(base if learn is None else base.where(learn), known, "label", TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = distinct_features(batch.column(1))
            values = ragged(np.concatenate(found).view(np.int64), np.array(list(map(len, found))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), values], names=["h", "label", "features"])

    spark = docs.sparkSession
    spread = taken.repartition(spark.sparkContext.defaultParallelism)
    table = keep(spread.mapInArrow(run, "h long, label int, features array<long>"), "toxicity")
    sizes = {r.label: r.n for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        forget(table)
        return spark.sparkContext.broadcast(train([], []))
    hashes, marking = telling(table, sizes[0], sizes[1])

    def known_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            place = np.minimum(np.searchsorted(hashes, values), max(0, len(hashes) - 1))
            hit = hashes[place] == values if len(hashes) else np.zeros(len(values), bool)
            kept = ragged(place[hit].astype(np.int32), np.bincount(row[hit], minlength=batch.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], names=["h", "label", "places"])

    found = table.mapInArrow(known_places, "h long, label int, places array<int>").toArrow().sort_by([("h", "ascending"), ("label", "ascending")]).combine_chunks()
    forget(table)
    places = found.column("places")
    at = [np.sort(places[i].values.to_numpy()) for i in range(found.num_rows)]
    return spark.sparkContext.broadcast(fit(hashes, marking, at, found.column("label").to_numpy()))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, texts_from: DataFrame | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, severity (expected grade), grade (likeliest), toxic_score (chance of a grade
    over 0), toxic (whether that reaches the model's threshold).

    Learns from about TRAIN_ROWS labelled rows at most, of any length (the driver gets FEATURES features and, of each row, which of them
    it has: 80 MB at most), of ``texts_from`` (docs unless given) that meet
    ``learn``, a condition on doc_id. Ids are cast to long. Null and empty texts have no features and get the base rate; null ids are scored and
    not learned from; labels other than 0 and 1 are not learned; without labels of both kinds every text is
    held to be clean. Repeated rows are scored each; other columns are not read.
    """
    shipped = _trained(docs, labels, learn, texts_from, label_col, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            chance = shipped.value.grades(batch.column(1))
            cols = [batch.column(0), pa.array(chance @ np.arange(GRADES)), pa.array(chance.argmax(axis=1).astype(np.int32)), pa.array(1 - chance[:, 0]), pa.array(1 - chance[:, 0] >= shipped.value.toxic_from)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "severity", "grade", "toxic_score", "toxic"])

    return _pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, severity double, grade int, toxic_score double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that score_toxicity does not hold toxic. No shuffle of docs."""
    shipped, text_col = _trained(docs, labels, **options), options.get("text_col", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in chunks(iter([batch]), text=at):
                score = 1 - shipped.value.grades(part.column(at))[:, 0]
                yield part.filter(pa.array(score < shipped.value.toxic_from))

    return docs.mapInArrow(run, docs.schema)
