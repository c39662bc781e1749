"""Numpy helpers over Arrow string columns: words, rolling hashes and ragged arrays.

All hashes are 64-bit polynomial hashes with wrap-around arithmetic and a final mixer. A prefix sum of
``symbol[i] * BASE**i`` gives the hash of any slice with one subtraction and one product with the
(modular) inverse power, so hashing costs a few passes over the buffer, whatever the slice length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once: the arrays of one chunk take about fifty times this.
CHUNK_BYTES = 1 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_U = np.uint64


@lru_cache(maxsize=16)
def _powers(base: int, size: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64, by doubling."""
    out = np.ones(size, dtype=np.uint64)
    have = 1
    while have < size:
        more = min(have, size - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, 1 << 64))
        have += more
    return out


def _tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    rounded = 1 << max(10, (size - 1).bit_length())
    return _powers(base, rounded), _powers(pow(base, -1, 1 << 64), rounded)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer: every output bit depends on every input bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def slice_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BYTE_BASE, block: int = CHUNK_BYTES) -> np.ndarray:
    """Hash of each symbols[start:end]; slices are sorted by start. Depends on the slice's content only.

    Works through the symbols block by block, so that one long buffer needs no more memory than a short one.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(starts, lo + block))
        while j > i + 1 and int(ends[j - 1]) - lo > 2 * block:
            j -= 1
        j = max(j, i + 1)
        hi = int(ends[i:j].max())
        up, down = _tables(base, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(symbols[lo:hi].astype(np.uint64) * up[: hi - lo], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _U(0xA24BAED4963EE407))


def _byte_class(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = _byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Runs of digits, a-z and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@dataclass
class Words:
    """Words of several texts. ``buf`` holds the texts' bytes one after the other, separated by one space;
    ``off[i]:off[i+1]`` are the words of text i; ``base[i]`` is where text i begins in ``buf``."""

    buf: np.ndarray
    base: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return slice_hashes(self.buf, self.starts, self.ends)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column with one space after each text, and the offsets of the texts (n + 1)."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    sizes = np.diff(offsets)
    base = np.concatenate(([0], np.cumsum(sizes + 1)))
    buf = np.full(int(base[-1]), 0x20, dtype=np.uint8)
    inside = np.ones(len(buf), dtype=bool)
    inside[base[1:] - 1] = False
    buf[inside] = raw
    return buf, base


def words_of(column: pa.Array, kind: np.ndarray, lower: bool) -> Words:
    buf, base = buffer_of(column)
    if lower:
        buf = _LOWER[buf]
    mark = np.zeros(len(buf) + 1, dtype=np.int8)
    mark[:-1] = kind[buf]
    edge = np.diff(mark, prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(buf, base, starts, ends, np.searchsorted(starts, base))


def word_windows(hashes: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every n consecutive words of one text: (start word, text, hash of the window)."""
    counts = np.maximum(np.diff(off) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + off[:-1][doc]
    return starts, doc, slice_hashes(hashes, starts, starts + n, base=_WORD_BASE)


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK_BYTES, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose text column has at most ``limit`` bytes (or a single row)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        total, start = np.cumsum(sizes), 0
        while start < len(sizes):
            done = total[start - 1] if start else 0
            stop = int(np.searchsorted(total, done + limit, side="right"))
            stop = min(max(stop, start + 1), start + rows)
            yield batch.slice(start, stop - start)
            start = stop


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column with counts[i] of the values in row i."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count)."""
    counts = np.asarray(counts, dtype=np.int64)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i+1]] for each i; 0 for an empty slice. Integer arithmetic wraps."""
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[off[1:]] - total[off[:-1]]
