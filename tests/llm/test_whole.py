"""Whole jobs: every text has a digest."""

import random

import numpy as np
import pyarrow as pa

from worktrace.llm import fingerprint


def _votes(raw):
    """Votes of each window, by brute force."""
    starts = np.arange(len(raw) - fingerprint.WINDOW + 1)
    rarity = [int(x) for x in np.rint(np.abs(fingerprint.entropies(np.frombuffer(raw, np.uint8), starts) - np.float32(fingerprint.TYPICAL)) * 256)]
    votes = [0] * len(starts)
    for a in range(max(1, len(starts) - fingerprint.RUN + 1)):
        run = range(a, min(a + fingerprint.RUN, len(starts)))
        votes[max(run, key=lambda k: (rarity[k], -k))] += 1
    return votes


def test_texts_of_every_length_have_a_digest():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("an", "er", "ing", "ou", "st")]
    prose = " ".join(rng.choice(words) for _ in range(4000))
    texts = [prose[k : k + size] for size in range(1, 401) for k in (size * 7, size * 31)]
    digests = fingerprint.digests(pa.array(texts))
    assert all(len(d) for d in digests)
    assert all(fingerprint.likeness(d, d) == 1 for d in digests)
    split = 0
    for text in texts:
        if len(text) < fingerprint.WINDOW:
            continue
        votes = _votes(text.encode())
        least = min(fingerprint.VOTES, max(1, len(votes) - fingerprint.RUN + 1))
        want = [k for k, v in enumerate(votes) if v >= least] or [votes.index(max(votes))]
        split += max(votes) < least
        assert fingerprint.digests(pa.array([text]))[0].tobytes() == _digest(text, want)
    assert split


def _digest(text, starts):
    found = [text[k : k + fingerprint.WINDOW] for k in starts]
    bits = np.zeros((-(-len(set(found)) // fingerprint.PER_FILTER), fingerprint.FILTER_BITS), bool)
    hashes, _ = fingerprint._features(pa.array(list(dict.fromkeys(found))))
    for i, h in enumerate(hashes):
        for k in range(fingerprint.HASHES):
            bits[i // fingerprint.PER_FILTER, (int(h) >> (12 * k)) & (fingerprint.FILTER_BITS - 1)] = True
    return np.packbits(bits, axis=1).tobytes()
