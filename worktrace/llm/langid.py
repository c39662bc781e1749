"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm.subwords import char_grams, code_points, drawn, featured, train
from worktrace.llm.text import buffer_of, chunks

BUCKETS = 1 << 16
#: Rows of the training sample.
TRAIN_ROWS = 4000

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0x20 for b in range(256)], dtype=np.uint8)


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams of 2, 3 and 4 characters of the lower-cased letters; everything else in ASCII is a space."""
    buf, base = buffer_of(column)
    points, base = code_points(_FOLD[buf], base)
    return [char_grams(points, base, n, BUCKETS - 1) for n in (2, 3, 4)]


def _lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    buf, base = buffer_of(column)
    ascii_letters = np.concatenate(([0], np.cumsum((_FOLD[buf] >= 97) & (buf < 128))))
    out = ascii_letters[base[1:]] > ascii_letters[base[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, column[i].as_py() or ""))
    return out


def identify(docs: DataFrame, labelled: DataFrame, learn: Column, reject_below: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (calibrated chance of that language).

    ``learn`` is a condition on doc_id: the model is trained on about TRAIN_ROWS rows at most of ``labelled`` that
    meet it and have a text, of any length, and a language. lang_pred is ``und`` where the text is null or has no letter (score 0),
    where the score is below ``reject_below``, and everywhere if nothing could be learned. Only texts are
    inputs of a prediction. Null ids are predicted and not learned from; repeated rows are predicted each.
    """
    pick = lambda df, *more: df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    rows, marks = featured(drawn(pick(labelled, F.col(lang_col).cast("string").alias("lang")).where(learn), None, "lang", TRAIN_ROWS), "lang", features)
    shipped = docs.sparkSession.sparkContext.broadcast(train(rows, marks, BUCKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in chunks(batches):
            chance = model.probabilities(features(batch.column(1)))
            best = chance.argmax(axis=1)
            score = chance[np.arange(len(best)), best]
            good = _lettered(batch.column(1)) & (score >= reject_below) & (model.classes[0] is not None)
            names = np.where(good, np.array([c or "und" for c in model.classes], dtype=object)[best], "und")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(np.where(good | (reject_below > score), score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(~learn, F.lit(True)).alias("held_out")
    return pick(docs, held).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
