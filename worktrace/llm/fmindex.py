"""FM-index over integer symbols: suffix array, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Every so many symbols a suffix position is stored.
SAMPLE = 8


def suffix_array(text: np.ndarray, run_end: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. text: symbols from 1 on, cut into runs by symbols 0; the zeros count as
    different symbols in order of position, so comparisons never cross a run. run_end: first zero at or after i."""
    n = len(text)
    zeros = text == 0
    rank = text.astype(np.int64) + int(zeros.sum()) - 1
    rank[zeros] = np.arange(zeros.sum())
    order = np.argsort(rank, kind="stable")
    width = 1
    longest = int((run_end - np.arange(n)).max(initial=0)) + 1
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, dtype=bool)
        new[:1] = True
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        dense = np.empty(n, dtype=np.int64)
        dense[order] = np.cumsum(new) - 1
        rank = dense
        if new.all() or width >= longest:
            return order
        # only the suffixes that still tie are sorted again
        open_ = ~(new & np.append(new[1:], True))
        slots = np.flatnonzero(open_)
        who = order[slots]
        after = np.minimum(who + width, n - 1)
        order[slots] = who[np.lexsort((rank[after], rank[who]))]
        keys = rank[order] * (n + 1) + np.where(open_, rank[np.minimum(order + width, n - 1)], 0)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = keys
        width *= 2


class Bits:
    """Bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)))).astype(np.int64)
        self.zeros = len(bits) - int(self.before[-1])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & _U(1)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before i."""
        block = i >> 6
        part = self.words[np.minimum(block, len(self.words) - 1)] & ((_U(1) << (i & 63).astype(np.uint64)) - _U(1))
        return self.before[block] + np.bitwise_count(part).astype(np.int64)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.levels: list[Bits] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before the position beside it."""
        start = np.zeros_like(i)
        for level, bits in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> level & 1).astype(bool)
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, bits.zeros + a, start - a), np.where(one, bits.zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before that position."""
        symbol, start, at = np.zeros_like(i), np.zeros_like(i), i
        for bits in self.levels:
            one = bits.get(at).astype(bool)
            a, b = bits.ones(start), bits.ones(at)
            symbol = symbol << 1 | one
            start, at = np.where(one, bits.zeros + a, start - a), np.where(one, bits.zeros + b, at - b)
        return symbol, at - start


class FMIndex:
    """Index of one shard's symbols, which begin and end with 0 and where 0 separates runs."""

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        at = np.arange(n)
        zero = np.flatnonzero(text == 0)
        run_end = zero[np.searchsorted(zero, at)]
        order = suffix_array(text, run_end)
        self.wavelet = WaveletMatrix(text[order - 1], top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        # a position is stored every SAMPLE symbols and at the start of each run, so no walk leaves its run
        start = np.concatenate(([True], text[:-1] == 0))
        stored = (at % SAMPLE == 0) | start
        self.marked = Bits(stored[order])
        self.stored = order[stored[order]]
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns at once: the suffix range [lo, hi) of each. patterns: (m, longest),
        right-aligned symbols."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (hi > lo))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - step]
            lo[live] = self.first[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix: walk back to a stored position."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.marked.get(at).astype(bool)
            out[todo[hit]] = self.stored[self.marked.ones(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                symbol, before = self.wavelet.access(at)
                at = self.first[symbol] + before
                steps += 1
        return out
