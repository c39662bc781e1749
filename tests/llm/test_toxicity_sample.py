"""The training sample is counted by Spark: the same model as from all features at once, however long the texts are."""

import random

import numpy as np
import pyarrow as pa

from worktrace.llm import toxicity


def _model(spark, texts, marks):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    return toxicity._trained(docs, labels).value


def _same(a, b):
    assert a.hashes.tolist() == b.hashes.tolist()
    assert np.allclose(a.weights, b.weights, rtol=1e-9, atol=1e-12) and np.allclose(a.thresholds, b.thresholds, rtol=1e-9)


def _sample(rng, n):
    plain = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(plain, k=40)) for _ in range(n)]
    marks = [int(i % 6 == 0) for i in range(n)]
    return [t + (" vilefoo nastyone" if m else "") + (" vilebar" if m and rng.random() < 0.5 else "") for t, m in zip(texts, marks)], marks


def _local(texts, marks):
    return toxicity.train(toxicity.distinct_features(pa.array(texts)), marks)


def test_counted_as_all_at_once(spark):
    texts, marks = _sample(random.Random(3), 240)
    model = _model(spark, texts, marks)
    assert len(model.hashes)
    _same(model, _local(texts, marks))


def test_most_telling_are_kept(spark, monkeypatch):
    texts, marks = _sample(random.Random(5), 240)
    monkeypatch.setattr(toxicity, "FEATURES", 3)
    model = _model(spark, texts, marks)
    assert len(model.hashes) == 3
    _same(model, _local(texts, marks))


def test_texts_of_megabytes(spark):
    texts, marks = _sample(random.Random(7), 120)
    for k in range(2):  # 5 MB each, nearly all words different
        texts[k] = " ".join(f"{k}x{i:x}q" for i in range(620_000)) + " " + texts[k]
    model = _model(spark, texts, marks)
    _same(model, _local(texts, marks))


def test_without_both_labels(spark):
    for texts, marks in (([], []), (["a b", "c"], [0, 0]), (["a", None], [1, 1])):
        model = _model(spark, texts, marks)
        assert not len(model.hashes) and model.grades(pa.array(["x"]))[0, 0] > 0.9
