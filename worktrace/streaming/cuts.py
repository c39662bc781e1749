"""Cuts of sessions where the system changes, as a stream with state: rows may come in any order up to the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CUTS = "session_id string, idx long, boundary boolean"
_ROW = "timestamp_ms long, chunk_id string, sequence_number long, event_id string, system string"
_FIELDS = ["timestamp_ms", "chunk_id", "sequence_number", "event_id", "system"]


def _plain(row: tuple) -> tuple:
    return tuple(None if v is None or v != v else v for v in row)


def _order(row: tuple) -> tuple:
    """Nulls first, as in a window's order."""
    return tuple((v is not None, v if v is not None else 0) for v in row[:4])


class _SystemCuts(StatefulProcessor):
    """Rows wait until the watermark has passed them; then nothing earlier can come, and they are taken in order of time, chunk,
    sequence number and id. Kept between times: how many rows were taken, and the system last known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.last = handle.getValueState("last", "taken long, system string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for part in rows:
            found = [_plain(r) for r in part[_FIELDS].astype(object).itertuples(index=False, name=None)]
            self.waiting.appendList([(int(t), c, None if n is None else int(n), e, s) for t, c, n, e, s in found])
            latest = max(latest, int(part["timestamp_ms"].max()))
        self.handle.registerTimer(latest)
        yield pd.DataFrame({"session_id": pd.Series(dtype=str), "idx": pd.Series(dtype="int64"), "boundary": pd.Series(dtype=bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for row in self.waiting.get():
            (ready if row[0] <= passed else rest).append(_plain(tuple(row)))
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        taken, system = self.last.get() if self.last.exists() else (0, None)
        idx, cut = [], []
        for row in sorted(ready, key=_order):
            now = row[4] if row[4] is not None else system
            if taken:
                idx.append(taken - 1)
                cut.append(system is not None and now != system)
            taken, system = taken + 1, now
        if ready:
            self.last.update((taken, system))
        yield pd.DataFrame({"session_id": pd.Series([key[0]] * len(idx), dtype=object), "idx": pd.Series(idx, dtype="int64"), "boundary": pd.Series(cut, dtype=bool)})

    def close(self) -> None:
        pass


def system_cuts(events: DataFrame) -> DataFrame:
    """(session_id, idx, boundary) per transition, as boundary.system_change gives for a whole table.

    events: a stream watermarked by ``at`` with session_id, timestamp_ms, chunk_id, sequence_number, event_id, system. A session's state is
    the rows that the watermark has not passed and two values. Rows behind the watermark are dropped (and counted, see
    ingest.run); those that it has not passed when the stream ends stay in the state for the next run.
    """
    named = events.select("session_id", *_FIELDS, "at")
    return named.groupBy("session_id").transformWithStateInPandas(statefulProcessor=_SystemCuts(), outputStructType=CUTS, outputMode="Append", timeMode="EventTime")
