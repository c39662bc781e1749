"""Registered queries without SQL against brute force or held-out labels on small given tables, and the pipeline by hand."""

import hashlib
import re
import tempfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from worktrace.llm import bpe, fingerprint, queries, substrings, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def _crc(i):
    return zlib.crc32(str(i).encode())


def test_quality_on_held_out_rows(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op2_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (_crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and marks.get(r.doc_id) is not None]
    most = max(Counter(m for _, m in held).values()) / len(held)
    assert sum(p == m for p, m in held) / len(held) > most


def test_languages_of_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_langid(spark, SF).collect()
    assert all(r.held_out == (_crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [(r.lang_pred, docs[r.doc_id].lang) for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(p == m for p, m in held) > 0.97 * len(held)
    for r in rows:
        if r.lang_pred == "und":
            assert not any(map(str.isalpha, docs[r.doc_id].text or ""))


def test_languages_are_rejected_below_a_chance(spark):
    from pyspark.sql import functions as F

    from worktrace.llm.langid import identify

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = identify(docs, docs, F.col("doc_id") % 4 != 2, reject_below=0.9).collect()
    assert all((r.lang_pred == "und") == (r.score < 0.9) for r in rows)


def test_fingerprints_recomputed(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    rows = {r.doc_id: r for r in queries.op6_fingerprints(spark, SF).collect()}
    assert rows.keys() == {r.doc_id for r in docs}
    import base64

    import pyarrow as pa

    digest = lambda t: fingerprint.digests(pa.array([t]))[0]
    show = lambda d: base64.b64encode(d.tobytes()).decode()
    for k in range(0, len(docs), 7):
        x, after = docs[k].text or "", docs[(k + 1) % len(docs)].text or ""
        quarter = len(x) // 4
        edited, r = x[: len(x) - quarter] + after[:quarter], rows[docs[k].doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        own, new, other = digest(x), digest(edited), digest(after)
        assert (r.fingerprint, r.edited_fingerprint) == (show(own), show(new))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(own, new), fingerprint.likeness(own, other))


def test_shards_have_near_equal_bytes(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first, again = (sorted(map(tuple, queries.op8_shards(spark, SF).collect())) for _ in range(2))
    assert first == again
    rows = queries.op8_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    shards, places = defaultdict(int), defaultdict(set)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        shards[r.shard] += r["size"]
        places[docs[r.doc_id]].add(r.shard)
    assert sorted(shards) == list(range(8))
    assert max(shards.values()) - min(shards.values()) < max(len(t.encode()) + 1 for t in docs.values()) + 0.02 * sum(shards.values())
    assert sum(len(s) > 1 for s in places.values()) <= 7
    for s in shards:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def _shingles(text, k):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def _near(texts, k, percent):
    """Least id reachable, by brute force over all pairs."""
    sets, top = {i: _shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in ids}


def _without_repeats(texts, length):
    words, count = {i: [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x] for i, t in texts.items()}, Counter()
    for w in words.values():
        count.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - length + 1) if count[tuple(w[s : s + length])] > 1 for p in range(s, s + length)}
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else texts[i]
    return out


def _without_items(texts, items, n):
    kind = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = set()
    for t in items:
        w = kind.findall(low(t))
        m = min(n, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
    sizes, out = {len(x) for x in windows}, {}
    for i, t in texts.items():
        found = list(kind.finditer(low(t)))
        hit = set()
        for m in sizes:
            for s in range(len(found) - m + 1):
                if tuple(x[0] for x in found[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
        text = t
        runs = sorted(hit)
        while runs:
            last = runs.pop()
            first = last
            while runs and runs[-1] == first - 1:
                first = runs.pop()
            text = text[: found[first].start()] + text[found[last].end() :]
        out[i] = text
    return out


def test_pipeline_by_hand(spark, monkeypatch):
    """run() on 350 given documents with copies, passages and benchmark texts, stage by stage in plain Python."""
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = tempfile.mkdtemp(prefix="spark-")
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 600 AND (text IS NULL OR length(text) < 6000)").collect()][:330]
    marks = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    base = [d for d in docs if d["text"] and 80 < len(d["text"].split()) < 900]
    add = lambda text: docs.append({**docs[0], "doc_id": 10_000 + len(docs), "text": text, "n_chars": len(text or "")})
    for k in range(6):
        add(base[k]["text"])
        add(base[k]["text"] + " tail")
        add(" ".join(base[k]["text"].split()[:60]) + f" own {k} " + " ".join(base[k + 8]["text"].split()[10:70]))
        add(f"start {k} " + items[k][1] + f" end {k}")
    add(None)
    add("")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in docs], schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, list(r["ids"])) for r in pipeline.run(spark, folder).collect()}

    # the model that the stage trains, on the texts by hand
    texts = {d["doc_id"]: d["text"] for d in docs}
    read = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity._trained(read, spark.read.parquet(f"{folder}/labels.parquet")).value
    import pyarrow as pa

    rejected = {i for i, t in texts.items() if 1 - model.grades(pa.array([t], pa.string()))[0, 0] >= model.toxic_from}
    marked = {i for i, _, t in marks if t == 1 and i in texts}
    assert len(rejected & marked) > 0.5 * len(marked)
    texts = {i: t for i, t in texts.items() if i not in rejected}
    top = _near(texts, 5, 80)
    assert sum(i != j for i, j in top.items()) >= 6
    texts = {i: t for i, t in texts.items() if top[i] == i}
    after = _without_repeats(texts, 35)
    assert sum(after[i] != texts[i] for i in texts) >= 6
    clean = _without_items(after, [t for _, t in items], 10)
    assert sum(clean[i] != after[i] for i in after) >= 4
    tokenizer = bpe.Tokenizer(Path(P.path("word_bpe_49k.json")).read_text(encoding="utf-8"))
    want = {i: [int(n) for x in tokenizer.encode_text(t or "") for n in x[1].split()] for i, t in clean.items()}
    assert got == {i: (len(ids), ids) for i, ids in want.items()}


@pytest.mark.parametrize("words", [60_000])
def test_texts_over_chunk_borders(spark, words):
    """Texts of several hundred kilobytes: hash blocks, shards and chunks end inside and between them."""
    import random

    from worktrace.llm import decontaminate, neardup
    from worktrace.llm import text as tx

    rng = random.Random(8)
    make = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)]
    long, passage = make(words), make(50)
    far = [*long[: words // 2], *passage, *long[words // 2 :]]
    short = [*make(30), *passage, *make(30)]
    texts = {1: " ".join(long), 2: " ".join(far), 3: " ".join(short), 4: " ".join(make(2 * words))}
    assert len(texts[4]) > tx.CHUNK_BYTES // 2
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()}
    after = _without_repeats(texts, 35)
    assert {i: x[1] for i, x in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()}
    assert got[3][0] == 50
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    bench = spark.createDataFrame([("x", " ".join(passage))], "item_id string, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, bench).collect()}
    assert hits == {1: 0, 2: 50, 3: 50, 4: 0}
