"""BPE encoding and decoding by a tokenization automaton.

The merge list is compiled by successive merge gadgets (Berglund, Martens and van der Merwe, "Constructing a
BPE Tokenization DFA"). The automaton reads token sequences. Its states are the start and one state for each
token, entered by that token's arcs; before any merge, every state has an arc for every base symbol. The gadget
for the merge (a, b) -> c

* adds the state c with the arcs of b's state, as c ends with b,
* adds the arc c to every state that has the arc a, as c begins with a, and
* removes the arc b from a's state (a followed by b would have been merged).

Written out, the arcs are a table of 49,000 x 49,000; they are kept as the gadgets made them instead: of each
state and each arc where it was copied from and when, and of each removed arc when. ``accepts`` looks transitions
up in a fixed table of recent ones and fills what it lacks from those links. As a state has at most one arc for a
token and every state accepts, the automaton is deterministic, and of all ways to cut the first letters of a word
into tokens it accepts exactly one. So a word is encoded left to right: each place takes the state of the one arc
that reaches it from an earlier place's state. Nothing is ever taken back. The words that a batch of texts adds
are walked together, one place of all of them at a time, whatever their length. Decoding emits the arc labels of the ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from worktrace.llm.text import chunks, ragged, ranges, slice_hashes

#: Pieces that a worker remembers while it runs a task, and then those of before once more.
CACHE = 150_000
#: Transitions in the table (a power of two), 9 bytes each.
TRANSITIONS = 1 << 20
#: Letters whose tokens are looked up at once.
LETTERS = 1 << 16
#: Stands for the end mark in spellings; the byte-level alphabet does not use it.
END = "\ue000"

_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_U = np.uint64
_NEVER = 1 << 40
_START, _NONE = -1, -2


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _code_points(words: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)


class _Lookup:
    """Numbers by 64-bit keys: a bit for each key's high bits, then a search among the sorted keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[self.keys >> _U(44)] = True

    def find(self, keys: np.ndarray, default: int) -> np.ndarray:
        out = np.full(len(keys), default, dtype=np.int64)
        maybe = np.flatnonzero(self.known[keys >> _U(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == keys[maybe]
            out[maybe[hit]] = self.values[at[hit]]
        return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of a state and a token, spread over 64 bits."""
    return (a.astype(np.uint64) << _U(32) | b.astype(np.uint64)) * _U(0x9E3779B97F4A7C15)


class Automaton:
    """Compiled merges. The state that a token leads to has the token's number; _START is the start."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.mark = END if end else ""
        spell = lambda t: t[: -len(end)] + END if end and t.endswith(end) else t
        size = 1 + max(vocab.values(), default=-1)
        self.left, self.right, self.born = (np.full(size, -1, dtype=np.int64) for _ in range(3))
        removed: dict[tuple[int, int], int] = {}
        for time, (a, b) in enumerate(merges):
            self._gadget(removed, time, vocab[a], vocab[b], vocab[a + b])
        pairs = np.array(list(removed), dtype=np.int64).reshape(-1, 2)
        self.removed = _Lookup(_pair(pairs[:, 0], pairs[:, 1]), np.array(list(removed.values()), dtype=np.int64))
        # arcs by spelling
        spelt, ids = [spell(t) for t in vocab], np.array(list(vocab.values()), dtype=np.int64)
        lengths = np.array([len(t) for t in spelt], dtype=np.int64)
        symbols, ends = _code_points(spelt), np.cumsum(lengths)
        self.arcs = _Lookup(slice_hashes(symbols, ends - lengths, ends), ids)
        # longest arc by its first two letters
        self.longest = np.zeros(1 << 16, dtype=np.int64)
        self.longest[:] = int(lengths[lengths == 1].max(initial=1))
        two = lengths > 1
        np.maximum.at(self.longest, self._start_of(symbols)[(ends - lengths)[two]], lengths[two])
        self.rest()

    def rest(self) -> None:
        """Empty the table of transitions."""
        self.seen = np.full(TRANSITIONS, ~_U(0))
        self.verdict = np.zeros(TRANSITIONS, dtype=bool)

    def _gadget(self, removed: dict[tuple[int, int], int], time: int, a: int, b: int, c: int) -> None:
        if self.born[c] >= 0:
            raise ValueError(f"token {c} is made by two merges")
        removed[a, b] = time
        self.left[c], self.right[c], self.born[c] = a, b, time

    @staticmethod
    def _start_of(symbols: np.ndarray) -> np.ndarray:
        after = np.append(symbols[1:], np.uint32(0))
        return ((symbols * np.uint32(0x9E37) ^ after * np.uint32(0x85EB)) & np.uint32(0xFFFF)).astype(np.int64)

    def accepts(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for the token beside it."""
        key = _pair(state, token)
        slot = (key >> _U(64 - TRANSITIONS.bit_length() + 1)).astype(np.int64)
        out = self.verdict[slot]
        new = np.flatnonzero(self.seen[slot] != key)
        if len(new):
            out[new] = self._resolve(state[new], token[new])
            self.seen[slot[new]], self.verdict[slot[new]] = key[new], out[new]
        return out

    def _resolve(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """accepts() from the gadgets: an arc is there unless it, or the arc that it was copied from, was removed before the copy."""
        out = np.ones(len(state), dtype=bool)
        live, before = np.arange(len(state)), np.full(len(state), 2 * _NEVER)
        while len(live):
            gone = 2 * self.removed.find(_pair(state, token), _NEVER) < before
            out[live[gone]] = False
            s, t = self.born[state], self.born[token]
            go = ~gone & ((s >= 0) | (t >= 0))
            live, before, state, token, s, t = live[go], before[go], state[go], token[go], s[go], t[go]
            by_state = s >= t  # a gadget copies states before it removes an arc, and adds arcs after it
            before = np.minimum(before, np.where(by_state, 2 * s, 2 * t + 1))
            state, token = np.where(by_state, self.right[state], state), np.where(by_state, token, self.left[token])
        return out

    def _spelt(self, symbols: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first letter, letter after the last, token) of every token in the letters; stop: end of each letter's word."""
        found = [(np.zeros(0, np.int64),) * 3]
        reach = np.minimum(self.longest[self._start_of(symbols)], stop - np.arange(len(symbols)))
        for lo in range(0, len(symbols), LETTERS):
            own = reach[lo : lo + LETTERS]
            first = np.repeat(np.arange(lo, lo + len(own)), own)
            last = first + 1 + ranges(np.zeros(len(own), np.int64), own)
            token = self.arcs.find(slice_hashes(symbols, first, last), -1)
            hit = token >= 0
            found.append((first[hit], last[hit], token[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pre-split words (their letters), one word after the other, and where each word's begin."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + len(self.mark)
        symbols = _code_points(w + self.mark for w in words)
        base = np.concatenate(([0], np.cumsum(size)))
        word = np.repeat(np.arange(len(words)), size)
        first, last, token = self._spelt(symbols, base[1:][word])
        word = word[first]
        # places: one before each letter and one after the last
        start, stop = first + word, last + word
        places = base + np.arange(len(base))
        state, back = np.full(places[-1], _NONE), np.full(places[-1], -1)
        state[places[:-1]] = _START
        place = last - base[word]
        order = np.argsort(place, kind="stable")
        start, stop, token, cuts = start[order], stop[order], token[order], np.searchsorted(place[order], np.arange(size.max(initial=0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            s, e, t = start[a:b], stop[a:b], token[a:b]
            at = state[s]
            ok = at == _START
            ask = np.flatnonzero(at >= 0)
            ok[ask] = self.accepts(at[ask], t[ask])
            state[e[ok]], back[e[ok]] = t[ok], s[ok]
        # the accepted walk, from the end
        here = places[1:] - 1
        here = here[size > 0]
        if (state[here] == _NONE).any():
            raise ValueError("the vocabulary lacks symbols of a word")
        on = np.zeros(places[-1], dtype=bool)
        while len(here):
            on[here] = True
            here = back[here]
            here = here[state[here] != _START]
        return state[on], np.concatenate(([0], np.cumsum(on)))[places]


class Tokenizer:
    """Reads a tokenizers JSON file with NFC, lower case, a removing split and byte-level BPE with a word end."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.auto = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in added.items()}
        self.numbers = {i: str(i) for i in self.labels}
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added_mark = os.path.commonprefix(list(added))
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split, regex.V0)
        self.letters = _byte_letters()
        self.plain = re.compile(split.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t-\r")).findall  # for lower-case ASCII
        # of each piece and word: number of ids, ids, labels
        self.pieces: dict[str, tuple[int, str, str]] = {}
        self.old_pieces: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.old_words: dict[str, tuple[int, str, str]] = {}

    def _cut(self, piece: str) -> list[str]:
        """Words and added tokens of a piece of text without white space."""
        if self.split_added and self.added_mark in piece:
            return [w for part in self.split_added.split(piece) for w in ([part] if part in self.added else self._words_of(part))]
        return self._words_of(piece)

    def _words_of(self, part: str) -> list[str]:
        if part.isascii():
            return self.plain(part.lower())
        return self.split.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def _learn(self, pieces: set[str]) -> None:
        """See that all pieces are known. Of what was looked up, the last two generations of CACHE pieces are kept."""
        new = pieces.difference(self.pieces)
        if len(self.pieces) + len(new) > CACHE:
            self.old_pieces, self.old_words, self.pieces, self.words = self.pieces, self.words, {}, {}
            new = pieces
        old, known = self.old_pieces, self.pieces
        single, several = [], []
        for p in new:
            if p in old:
                known[p] = old[p]
            elif p.isalpha() and p.isascii():
                single.append((p, p.lower()))
            else:
                several.append((p, self._cut(p)))
        words = {w for _, w in single}.union(*[ws for _, ws in several])
        unknown = []
        for w in words.difference(self.words):
            if w in self.old_words:
                self.words[w] = self.old_words[w]
            elif w in self.added:
                self.words[w] = 1, self.numbers[self.added[w]], w
            else:
                unknown.append(w)
        ids, off = self.auto.encode([w if w.isalpha() and w.isascii() else "".join(map(self.letters.__getitem__, w.encode())) for w in unknown])
        ids, off = ids.tolist(), off.tolist()
        numbers, labels, join, learnt = list(map(self.numbers.__getitem__, ids)), list(map(self.labels.__getitem__, ids)), " ".join, self.words
        for w, a, b in zip(unknown, off[:-1], off[1:], strict=True):
            learnt[w] = b - a, join(numbers[a:b]), join(labels[a:b])
        known.update([(p, learnt[w]) for p, w in single])
        for p, ws in several:
            found = [learnt[w] for w in ws]
            known[p] = found[0] if len(found) == 1 else (sum([x[0] for x in found]), join([x[1] for x in found]), join([x[2] for x in found]))

    def encode_texts(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """Of each text: (number of ids, ids, labels) of each piece that has any."""
        cut = [_SPACES.split(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        self._learn({p for pieces in cut for p in pieces})
        get = self.pieces.__getitem__
        return [[x for x in map(get, pieces) if x[0]] for pieces in cut]

    def encode_text(self, text: str) -> list[tuple[int, str, str]]:
        return self.encode_texts([text])[0]

    def rest(self) -> None:
        """Forget what was looked up: workers outlive tasks, and the next one may need the memory."""
        self.pieces, self.old_pieces, self.words, self.old_words = {}, {}, {}, {}
        self.auto.rest()

    def decode_ids(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by one space."""
        return " ".join(map(self.labels.__getitem__, ids))


_loaded: dict[int, Tokenizer] = {}


def _tokenizer(source: str) -> Tokenizer:
    key = hash(source)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(source)
    return _loaded[key]


#: Bytes of a tokenizer file; it is broadcast, so a larger one is refused.
MODEL_BYTES = 64 << 20


def _source(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        source = f.read(MODEL_BYTES + 1)
    if len(source) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return source


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, and ids array<int> and/or the digests of ids and decoded text.

    A null or empty text has no tokens (n_tokens 0, empty ids); a null id stays null; rows that repeat are
    encoded each; other columns are not read. Texts of any length are encoded whole. No shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(_source(path))
    schema = "doc_id long, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shipped.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in chunks(batches):
            found = tokenizer.encode_texts([t or "" for t in batch.column(1).to_pylist()])
            n, joined = [sum([x[0] for x in own]) for own in found], [" ".join([x[1] for x in own]) for own in found]
            cols, names = [batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"]
            if ids:
                flat = " ".join([j for j in joined if j])
                cols.append(ragged(np.fromstring(flat, dtype=np.int32, sep=" ") if flat else np.zeros(0, np.int32), np.array(n), pa.int32()))
                names.append("ids")
            if digests:
                cols += [pa.array(map(sha, joined), pa.string()), pa.array([sha(" ".join([x[2] for x in own])) for own in found], pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        tokenizer.rest()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the labels of each row's ids joined by one space; null ids give an empty text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(_source(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shipped.value)
        for batch in batches:
            texts = [tokenizer.decode_ids(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")
