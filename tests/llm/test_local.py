"""Kernels against brute force, without Spark."""

import random
import re
from collections import Counter, defaultdict
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from worktrace.llm import decontaminate, fingerprint, html, langid, neardup, quality, substrings, text, toxicity
from worktrace.llm.subwords import sparse, train


def test_slice_hashes_depend_on_content_only():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4900, 800))
    ends = starts + rng.integers(1, 60, 800)
    seen = {}
    for block in (64, 1 << 20):
        for h, a, b in zip(text.slice_hashes(x, starts, ends, block=block), starts, ends, strict=True):
            assert seen.setdefault(bytes(x[a:b]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_of_nulls_and_unicode():
    col = pa.array([None, "", " \t", "Aé b", "x\n\nyy z"])
    w = text.words_of(col, text.SPACED, lower=True)
    assert w.counts.tolist() == [0, 0, 0, 2, 3]
    assert bytes(w.buf[w.starts[0] : w.ends[0]]).decode() == "aé"


def test_tokenizer_equals_the_library():
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from worktrace.llm.bpe import Tokenizer

    path = P.path("word_bpe_49k.json")
    mine, theirs = Tokenizer(open(path, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "aabbceeiinnorsttu 'lvdm  \t\n\x1c\x85 ΣσςİIÉé́ñ½²Ⅷ٣漢字🙂🏽'​\xa0ﬁǅ<>|-_#$ 힣가"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * n for n in range(40)] + ["hello <|endoftext|> It's we'll<|startoftext|>x", "haha" * 30, "", "z" * 3000]
    for t, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        got = mine.encode_text(t)
        ids = [int(i) for x in got for i in x[1].split()]
        assert ids == want.ids
        assert " ".join(x[2] for x in got) == mine.decode_ids(ids) == theirs.decode(want.ids, skip_special_tokens=False)


def _brute_hits(items, texts, n):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(i)
    for t in texts:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= own
        yield len(w), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(5))
def test_decontamination_equals_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dé", "E", "zz"][: rng.randint(2, 6)]
    some = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "!", ","]) for _ in range(n))
    items = [(str(i), some(rng.randint(0, 14))) for i in range(15)]
    texts = [some(rng.randint(0, 80)) for _ in range(60)] + [None, "", "!!!"]
    n = rng.choice([3, 6, 10])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = decontaminate._scan(decontaminate._phrases(items, n), batch, True).to_pylist()
    for row, want in zip(got, _brute_hits(items, texts, n), strict=True):
        assert (row["n_words"], row["n_hit"], sorted(row["items"])) == want
        assert sum(b - a for a, b in zip(row["span_starts"], row["span_ends"], strict=True)) == row["n_hit"]
    empty = decontaminate._scan(decontaminate._phrases([], n), batch, True).to_pylist()
    assert all(r["n_hit"] == 0 and r["clean_text"] == t for r, t in zip(empty, texts, strict=True))


def test_fm_index_finds_every_occurrence():
    from worktrace.llm.fmindex import FMIndex

    rng = np.random.default_rng(5)
    body = rng.integers(0, 4, 400)
    data = np.concatenate(([0], body, [0])).astype(np.int64)
    index = FMIndex(data, 3)
    patterns = [p for n in (1, 2, 3, 5) for p in {tuple(data[i : i + n]) for i in range(len(data) - n)} if 0 not in p]
    table = np.array([(0,) * (5 - len(p)) + p for p in patterns])
    lo, hi = index.search(table, np.array(list(map(len, patterns))))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        want = [i for i in range(len(data)) if tuple(data[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_shingle_sets():
    col = pa.array(["A b A b", "a", None, "  ", "a b c"])
    shingles, off = neardup.shingle_sets(col, 2)
    assert np.diff(off).tolist() == [2, 1, 0, 0, 2]


def test_tables_miss_few_links():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        sets = [np.unique(np.concatenate((shared, x))) for x in (a, b)]
        halves = neardup.half_keys(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        missed += not (neardup.table_keys(halves)[0] == neardup.table_keys(halves)[1]).any()
    assert missed == 0


def test_equal_windows_share_their_seed():
    rng = random.Random(2)
    passage = " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60))
    col = pa.array(["x y z " + passage + " q", passage, "w " * 50 + passage])
    words = text.words_of(col, text.SPACED, lower=False)
    doc, place, s0, s1, anchor = substrings._seeds(words, 35)
    assert sum(s1 - s0 + 1) == sum(max(0, n - 34) for n in words.counts)
    inner = [set(anchor[doc == i].tolist()) for i in range(3)]
    assert inner[0] & inner[1] & inner[2]


def test_entropy_and_digests():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 110, 3000).astype(np.uint8)
    starts = np.concatenate([np.arange(0, 900), np.arange(1000, 1005), np.arange(1100, 2900)])

    def entropy(w):
        c = np.bincount(w)
        c = c[c > 0] / 64
        return -(c * np.log2(c)).sum()

    assert np.abs(fingerprint.entropies(buf, starts) - np.array([entropy(buf[s : s + 64]) for s in starts])).max() < 1e-5
    words = [" ".join("".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9))) for _ in range(400)) for _ in range(3)]
    texts = [words[0], words[0][: 3 * len(words[0]) // 4] + words[1][: len(words[0]) // 4], words[2], words[0], "", "ab", None]
    d = fingerprint.digests(pa.array(texts))
    assert d[0].tobytes() == d[3].tobytes() and fingerprint.likeness(d[0], d[3]) == 1
    assert fingerprint.likeness(d[0], d[1]) > 0.5 > 0.1 > fingerprint.likeness(d[0], d[2])
    assert fingerprint.likeness(d[4], d[6]) == 1 and fingerprint.likeness(d[4], d[5]) == 0


def _texts(rng, words, n):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(n)]


def test_classifiers_learn_held_out_rows():
    rng = random.Random(4)
    english, german = "the of and to in was with for that".split(), "der die und nicht ein von mit sich auch".split()
    make = lambda n: [(t, k) for k, w in (("en", english), ("de", german)) for t in _texts(rng, w, n)]
    given, marks = zip(*make(80), strict=True)
    model = train(sparse(pa.array(given), langid.features), marks, langid.BUCKETS)
    seen = make(40)
    chance = model.probabilities(langid.features(pa.array([t for t, _ in seen])))
    assert np.mean([model.classes[c] == k for c, (_, k) in zip(chance.argmax(1), seen, strict=True)]) > 0.97
    assert langid._lettered(pa.array(["12 !", "é", "a", None, ""])).tolist() == [False, True, True, False, False]
    junk = [" ".join([rng.choice(english)] * 30) for _ in range(80)]
    good = _texts(rng, english, 80)
    model = train(sparse(pa.array(good[:60] + junk[:60]), quality.features), [1] * 60 + [0] * 60, quality.BUCKETS)
    score = model.probabilities(quality.features(pa.array(good[60:] + junk[60:])))[:, 1]
    assert score[:20].mean() > score[20:].mean() + 0.5


def test_ordinal_regression():
    rng = random.Random(6)
    plain = ["w%d" % i for i in range(300)]
    clean = _texts(rng, plain, 400)
    toxic = [t + " " + " ".join(rng.choice(["vilefoo", "vilebar", "nastyone"]) for _ in range(rng.randint(2, 12))) for t in _texts(rng, plain, 80)]
    model = toxicity.train(toxicity.distinct_features(pa.array(clean[:300] + toxic[:60])), [0] * 300 + [1] * 60)
    assert (np.diff(model.thresholds) > 0).all()
    chance = model.grades(pa.array(clean[300:] + toxic[60:] + ["", None]))
    assert np.allclose(chance.sum(axis=1), 1) and (chance >= -1e-12).all()
    flagged = 1 - chance[:, 0] >= model.toxic_from
    assert not flagged[:100].any() and flagged[100:120].all() and not flagged[120:].any()
    assert toxicity.train([], []).grades(pa.array(["x"]))[0, 0] > 0.9


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies to improve your experience on this website, please accept all of them now.</div>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="sidebar"><p>Long text in the sidebar that goes on and on for twenty words or so, and then even some more.</p></div>
<article><header><h1>My &eacute;t&eacute; title</h1></header><p>Short.<p>A <a href=1>link</a> para with&nbsp;some   white
space.</p><div class="ad">Buy now</div><form><label>Your name please</label></form><ul><li>item one</li></ul></article>
<section id="comments"><h3>Comments</h3><p>I really liked this article, it was good and long and interesting to read.</p></section><script>var t="</p>";</script><footer>&copy; x</footer>"""


def _extract(page):
    blocks = html.blocks_of(page)
    if not blocks:
        return ""
    good = html.train().predict(html.features(blocks)) >= 0.5
    return "\n".join(b.text for b, g in zip(blocks, good, strict=True) if g)


def test_html_extraction():
    assert _extract(PAGE) == "My été title\nShort.\nA link para with some white space.\nitem one"
    for page in ("", "<", "<p", "<script>x", "<!-- a", "<p>" * 2000):
        assert isinstance(_extract(page), str)
    plain = "<div><p>" + "word " * 60 + "</p><p>" + "more " * 50 + "</p></div>"
    assert len(_extract(plain).split()) == 110
    assert Counter(b.furniture for b in html.blocks_of(PAGE))[True] >= 6


LONG = "word " * 49 + "word"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<head><title>x</title><meta a><p>{LONG}</p>", LONG),
        ("<html><head><title>x</title><body><article><p>Hello there all.</p></article>", "Hello there all."),
        ("<article><p>One <svg viewBox='0'/> two.</p><iframe src=x/><p>Three.</p></article>", "One two.\nThree."),
        ("<article><p>One <svg viewBox='0'><text>no</text></svg> two.</p><video><p>no</p></video><p>Three.</p></article>", "One two.\nThree."),
        ("<article><button>No<button>no</button><p>Three.</p></article>", "Three."),
        ("<article><iframe src=x><p>One two three.</p></article>", "One two three."),
        ("<article><video-player>Own element.</video-player><p>Three.</p></article>", "Own element.\nThree."),
        (f'<div class="content has-sidebar"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
        (f'<div class="sidebar-layout"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
        (f'<div class="left-sidebar-box"><p>{LONG}</p></div><p>{LONG}</p><p>{LONG}</p>', f"{LONG}\n{LONG}"),
        ("<form id=aspnetForm><nav><a>x</a></nav><article><p>Hi all.</p></article></form>", "Hi all."),
        ("<body class='comments-open has-sidebar'><div id=page class=nav-open><main><p>Hi all.</p></main></div>", "Hi all."),
        ("<article><p>Hi.</p><p><a>See</a></p><p><a>That too</a></p><p>Bye.</p></article>", "Hi.\nSee\nThat too\nBye."),
        ("<article><p>Hi.</p></article><script>unclosed <p>x</p>", "Hi."),
    ],
)
def test_html_elements_without_end_tags_and_wrappers(page, want):
    assert _extract(page) == want


def test_html_tree_on_pages_left_out():
    """Each labelled page against a tree grown on the others; most blocks are placed right, and neighbours take part."""
    pages, right, n, used = html.LABELLED_PAGES, 0, 0, set()

    def visit(node):
        if node.feature is not None:
            used.add(html.FEATURES[node.feature])
            visit(node.below)
            visit(node.above)

    for k in range(len(pages)):
        tree = html.train(html.labelled_blocks(pages[:k] + pages[k + 1 :]))
        rows = html.labelled_blocks((pages[k],))
        right += ((tree.predict(rows[:, :-1]) >= 0.5) == rows[:, -1]).sum()
        n += len(rows)
        visit(tree)
    assert right > 0.88 * n
    assert used & {"words_before", "words_after", "link_density_before", "link_density_after"}


def test_html_on_given_pages():
    """The articles of the given pages, cut out by hand."""
    import pyarrow.parquet as pq

    path = Path("/root/testdata/sf0.001/pages.parquet")
    if not path.exists():
        pytest.skip("no test data")
    for row in pq.read_table(path).to_pylist():
        article = re.search("<article>(.*?)</article>", row["html"] or "", re.S)
        if article:
            blocks = (" ".join(unescape(re.sub(r"</?[bai]\b[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p|br|ul|li|article|div)[^>]*>", article[1]))
            assert _extract(row["html"]) == "\n".join(filter(None, blocks))
