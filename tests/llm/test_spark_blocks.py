"""Decontamination gives the same rows however many blocks the benchmark takes."""

import random
from collections import Counter

import pytest

from worktrace.llm import decontaminate


def _clean(row):
    return tuple(tuple(x) if isinstance(x, list) else x for x in row)


@pytest.mark.parametrize("size", [1000, 100])
def test_blocks_with_null_and_repeated_ids(spark, monkeypatch, size):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("an", "er", "ing", "ou", "st")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [prose(12) for _ in range(40)]
    bench = spark.createDataFrame([(str(k % 35), t) for k, t in enumerate(items)] + [("0", items[0])], "item_id string, text string")
    a, b, c = (f"{prose(4)} {items[k]} {items[k + 1]} {prose(6)}" for k in (0, 10, 20))
    rows = [(None, a, 1), (None, b, 2), (None, c, 3), (None, prose(34), 4), (7, a, 5), (7, b, 6), (7, prose(34), 7), (7, a, 5), (8, None, 8), (8, "", 9), (None, None, 10), *((k, f"{prose(5)} {items[k]} {prose(3)}", k) for k in range(20, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found_n int").repartition(3)

    def both():
        found = decontaminate.decontaminate(docs, bench, clean=True).collect()
        return Counter(map(_clean, found)), Counter(map(tuple, decontaminate.remove_contamination(docs, bench).collect()))

    one = both()
    assert sum(one[0].values()) == sum(one[1].values()) == len(rows)
    assert sum(k for r, k in one[0].items() if r[2] >= 24) == 6
    assert not any(items[k] in (r[1] or "") for r in one[1] for k in range(40))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    assert both() == one
