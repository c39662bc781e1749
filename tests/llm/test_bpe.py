"""The tokenization automaton against merging by hand."""

import random

import numpy as np
import pytest

from worktrace.llm import bpe


def _merged(symbols, ranks):
    symbols = list(symbols)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols[:-1], symbols[1:], strict=True)) if p in ranks]
        if not pairs:
            return symbols
        rank = min(pairs)[0]
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and ranks.get((symbols[i], symbols[i + 1])) == rank:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out


def _dictionary(rng, end):
    vocab = list("abc") + ([x + end for x in "abc"] if end else [])
    merges = []
    while len(merges) < 25:
        a, b = rng.choice(vocab), rng.choice(vocab)
        if (end and a.endswith(end)) or a + b in vocab:
            continue
        merges.append((a, b))
        vocab.append(a + b)
    return {t: i for i, t in enumerate(vocab)}, merges


def _base(word, end):
    return [*word[:-1], word[-1] + end]


@pytest.mark.parametrize("seed", range(6))
def test_automaton_accepts_what_merging_gives(seed):
    rng = random.Random(seed)
    end = "</w>" if seed % 2 else ""
    vocab, merges = _dictionary(rng, end)
    # a merge that an earlier one always forestalls is no merge of a trained dictionary
    ranks = {}
    for k, (a, b) in enumerate(merges):
        word = (a + b).replace(end, "") if end else a + b
        if _merged(_base(word, end if (a + b).endswith(end) else ""), {**ranks, (a, b): k}) == [a + b]:
            ranks[a, b] = k
        else:
            vocab.pop(a + b)
    for t in [t for t in vocab if len(t.replace(end, "") if end else t) > 1]:
        vocab.pop(t)
    kept = []
    for (a, b), _ in sorted(ranks.items(), key=lambda x: x[1]):
        if a in vocab and b in vocab:
            kept.append((a, b))
            vocab[a + b] = 0
    vocab = {t: i for i, t in enumerate(vocab)}
    ranks = {p: k for k, p in enumerate(kept)}
    auto = bpe.Automaton(vocab, kept, end)
    names = {i: t for t, i in vocab.items()}
    state, token = (x.ravel() for x in np.meshgrid(range(len(vocab)), range(len(vocab))))
    for _ in range(2):  # resolved, then from the table
        for s, t, ok in zip(state, token, auto.accepts(state, token), strict=True):
            a, b = names[s], names[t]
            if end and a.endswith(end):
                continue
            word = a + (b[: -len(end)] if end and b.endswith(end) else b)
            assert ok == (_merged(_base(word, end if end and b.endswith(end) else ""), ranks) == [a, b]), (a, b)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["a" * 60, "abc" * 40, "cb" * 200]
    ids, off = auto.encode(words)
    for w, a, b in zip(words, off[:-1], off[1:], strict=True):
        assert [names[i] for i in ids[a:b]] == _merged(_base(w, end), ranks)


def test_one_arc_reaches_each_place():
    """Deterministic: of the arcs that end at a place, the states before accept one."""
    rng = random.Random(9)
    vocab, merges = {}, []
    for t in "abcd":
        vocab[t] = len(vocab)
    for a, b in (("a", "b"), ("c", "d"), ("ab", "cd"), ("b", "c"), ("a", "a"), ("aa", "a"), ("d", "ab")):
        merges.append((a, b))
        vocab[a + b] = len(vocab)
    auto, names = bpe.Automaton(vocab, merges), {i: t for t, i in vocab.items()}
    ranks = {p: k for k, p in enumerate(merges)}
    words = ["".join(rng.choice("abcd") for _ in range(n)) for n in range(1, 80)]
    ids, off = auto.encode(words)
    for w, a, b in zip(words, off[:-1], off[1:], strict=True):
        assert [names[i] for i in ids[a:b]] == _merged(w, ranks)
    for w in words:
        state = [bpe._START]
        for end in range(1, len(w) + 1):
            arcs = [(s, vocab[w[s:end]]) for s in range(end) if w[s:end] in vocab]
            good = [t for s, t in arcs if state[s] == bpe._START or auto.accepts(np.array([state[s]]), np.array([t]))[0]]
            assert len(good) == 1
            state.append(good[0])


def test_words_without_letters_in_the_vocabulary():
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0}, []).encode(["ab"])
    ids, off = bpe.Automaton({"a": 0}, []).encode([])
    assert len(ids) == 0 and off.tolist() == [0]


def test_long_runs_of_wide_letters_are_walked_together():
    """Runs of 25 and 60 letters of three bytes each: the library's ids, at well under 5 s a megabyte."""
    import time

    public = pytest.importorskip("public_tokenizers")
    from pathlib import Path

    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    rng = random.Random(3)
    own, theirs = bpe.Tokenizer(Path(path).read_text(encoding="utf-8")), Tokenizer.from_file(path)
    own.encode_text("warm up")
    for run in (25, 60):
        text = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(run)) for _ in range(300_000 // (3 * run)))
        began = time.process_time()
        got = [int(n) for x in own.encode_text(text) for n in x[1].split()]
        took = time.process_time() - began
        assert got == theirs.encode(text, add_special_tokens=False).ids
        assert took < 5 * len(text.encode()) / 1e6
        print(run, took / (len(text.encode()) / 1e6))
