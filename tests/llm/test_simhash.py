"""SimHash near-dedup against brute force."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from worktrace.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def _print(text, k=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _least(rows, radius=4):
    """rows (doc_id, fingerprint) -> {doc_id: least id reachable}, over all pairs."""
    top = {i: i for i, _ in rows if i is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    known = [(i, f) for i, f in rows if i is not None]
    for n, (i, f) in enumerate(known):
        for j, g in known[:n]:
            if (f ^ g).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in top}


TEXTS = [None, "", " \t\n ", "One", "one two", "ONE two three", "one  two\tthree four", "a b c d e", "a b a b a b a b", "Ünï çödé wörds ärè kèpt", "x y z w v", "word " * 900]


def test_fingerprints_equal_plain_python(monkeypatch):
    rng = random.Random(2)
    texts = [*TEXTS, *(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 4, 5, 80, 400]))) for _ in range(40))]
    want = [_print(t) for t in texts]
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == want
    monkeypatch.setattr(simhash, "SHINGLES", 7)  # borders inside texts
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == want
    assert want[:3] == [0, 0, 0]


def test_hash_is_that_of_spark(spark):
    row = spark.sql("SELECT xxhash64('one two three four') AS h").first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three four", 42)


def test_variants_are_all_within_half_the_radius():
    masks = simhash.flips(list(range(64)))
    assert len(masks) == len(set(masks.tolist())) == 1 + 64 + 2016
    assert np.bitwise_count(masks).max() == 2


@pytest.mark.parametrize("unpacked", [1 << 21, 500])
def test_every_variant_is_unpacked_once_where_it_belongs(monkeypatch, unpacked):
    monkeypatch.setattr(simhash, "UNPACKED", unpacked)
    rng = random.Random(9)
    fps, bits = [rng.getrandbits(64) for _ in range(3)], [3, 17, 40, 41, 63]
    got = []
    sent = pa.record_batch([pa.array(np.array(fps, np.uint64).view(np.int64))], names=["fp"])
    for batch in simhash._emit(bits)([sent]):
        for row in batch.to_pylist():
            own = np.frombuffer(row["fps"], np.uint64)
            for variants, owners in simhash._unpacked(row["place"], own, bits):
                got += [(int(own[o]), int(v)) for v, o in zip(variants, owners, strict=True)]
                assert all(sum((int(v) >> b & 1) << k for k, b in enumerate(bits)) == row["place"] for v in variants)
    want = [(f, f ^ int(m)) for f in fps for m in simhash.flips(list(range(64)))]
    assert sorted(got) == sorted(want)


def test_links_connect_what_is_near(spark):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):  # chains and clouds at distances around the radius
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 8])):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                f ^= 1 << b
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.near_links(table, len(fps)).collect()]
    want = _least([(f, f) for f in fps])
    top = {f: f for f in fps}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        top[b] = a
    assert {f: find(f) for f in fps} == want
    assert len(set(want.values())) < len(fps)


def test_documents_of_every_kind(spark):
    rng = random.Random(7)
    long = [f"w{rng.randrange(400)}" for _ in range(600)]
    near = [*long[:300], "changed", *long[301:]]
    rows = [(10 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(50, " ".join(long)), (40, " ".join(near)), (60, " ".join(long)), (60, "quite another text of this id"), (61, "quite another text of this id"), (None, " ".join(long)), (70, " ".join(long)), (70, " ".join(long))]
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, rep long, fp string").repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()), key=repr)
    prints = [(i, _print(t)) for i, t in rows]
    least = _least([*prints, *((i, f) for i, f in prints)])
    if least[60] != least[61]:  # versions of one id
        low = min(least[60], least[61])
        least = {i: low if c in (least[60], least[61]) else c for i, c in least.items()}
    assert got == sorted(((i, f"{f:016x}", least.get(i)) for i, f in prints), key=repr)
    assert simhash.simhash_components(docs.where("false")).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = [(r.doc_id, _print(r.text)) for r in docs]
    least = _least(prints)
    got = sorted(map(tuple, queries.op12_simhash(spark, SF).collect()))
    assert got == sorted((i, f"{f:016x}", least[i]) for i, f in prints)
    assert any(i != c for i, _, c in got)
