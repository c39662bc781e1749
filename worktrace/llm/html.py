"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its words and link density, those of the
blocks before and after it, and where it stands: inside article or main, outside it, or on a page without; in an
element, of any kind that ends a block, that is page furniture by its tag, or by the last word of a class, role or id of its own; an
article or section whose name may as well be its topic is doubtful only. A decision tree says which blocks are content. It is grown on the blocks of the small labelled pages below, which are cut and
measured by the same code as any page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.text import chunks

_REST = r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?([a-zA-Z][a-zA-Z0-9:-]*)(?=[\s/>]){_REST}|<[!/?a-zA-Z][^>]*(?:>|\Z)", re.S)
#: Elements whose text is no text of the page.
_HIDDEN = frozenset("script style noscript template svg iframe object select textarea button head title math canvas video audio".split())
#: Of these, those that run to the end of the page without an end tag, and those that do not end the block they stand in.
_RAW, _WITHIN = frozenset(("script", "style", "textarea")), frozenset(("svg", "math", "button"))
#: What may stand in a head; anything else ends it.
_IN_HEAD = frozenset("title meta link base style script noscript template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("div section article main nav header footer aside form ul ol dl table body html fieldset figure dialog menu details".split())
_FURNITURE_TAGS = frozenset("nav footer aside dialog menu fieldset".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Words in a class, id or role that name page furniture, and content. Fixed values.
_FURNITURE = frozenset(
    "nav navigation navbar menu menubar breadcrumb breadcrumbs header banner masthead topbar toolbar footer contentinfo copyright legal sidebar side aside complementary widget rail "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search form "
    "share sharing social related recommended comment comments reply replies respond disqus discussion pagination pager tags skip".split()
)
#: Of these, words that may as well say what an article or section is about.
_TOPICS = frozenset("social share sharing search legal discussion alert notice tags form side rail banner header copyright advertising login menu".split())
_CONTENT = frozenset("article main content post entry story body".split())
#: Words that may follow one that names furniture, as in ad-box; and words before it that say it is elsewhere, as in has-sidebar. Fixed values.
_PLAIN = frozenset("area bar block box container content group inner item items left link links list panel right section slot top unit bottom wrap wrapper".split())
_ELSEWHERE = frozenset("has have with without no not hide hidden is show".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose start ends those open ones without an end tag, up to the list or table that they stand in.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold no other block, so that any of those ends them; those that hold no text; those whose end tag reaches no further.
_LINES, _VOID, _SCOPES = _HEADINGS | {"p"}, frozenset("area base br col embed hr img input link meta param source track wbr".split()), frozenset(("ul", "ol", "dl", "table"))
#: How an element is furniture.
_DOUBTFUL, _BY_FORM, _BY_NAME, _BY_TAG = 1, 2, 3, 4


@dataclass
class Block:
    text: str
    words: int
    linked: int
    content: bool
    furniture: bool
    heading: bool
    doubtful: bool = False


def _names_furniture(name: str) -> tuple[str | None, bool]:
    """The word by which one class, id or role names furniture, and whether it names content."""
    words = [w.lower() for w in _NAME.findall(name)]
    content = not _CONTENT.isdisjoint(words)
    if not words or words[0] in _ELSEWHERE:
        return None, content
    while len(words) > 1 and words[-1] in _PLAIN and words[-1] not in _FURNITURE:
        words.pop()
    return words[-1] if words[-1] in _FURNITURE else None, content


def _named(tag: str, attributes: str) -> tuple[int, bool]:
    """(0, _DOUBTFUL or _BY_NAME, whether content is named) by the classes, id and role of an element."""
    how, content = 0, False
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        for name in (m[2] or m[3] or m[4] or "").split():
            word, of_content = _names_furniture(name)
            content = content or of_content
            if word is not None and not (of_content and name.lower().endswith("header")):
                how = max(how, _DOUBTFUL if tag in ("article", "section") and word in _TOPICS else _BY_NAME)
    return how, content


def _place(tag: str, attributes: str, content: bool, furniture: int) -> tuple[bool, int]:
    """(inside content, how inside furniture) of what a container holds, given what stands around it. A main element is in no
    furniture by name, an article in none by a form or a topic: such names and forms wrap pages."""
    bad, named = _named(tag, attributes)
    if tag in ("body", "html", "main", "header", "form"):
        bad = 0
    if (tag == "main" and furniture < _BY_TAG) or (tag == "article" and furniture <= _BY_FORM):
        furniture = 0
    own = _BY_TAG if tag in _FURNITURE_TAGS or (tag == "header" and not content) else bad or (_BY_FORM if tag == "form" else 0)
    return content or tag in ("article", "main") or (tag in ("div", "section") and bad < _BY_NAME and named), max(furniture, own)


class _Hidden:
    """Where the hidden elements of a page end. The end tags of a kind are looked up once, so pages with very many elements
    without an end tag take no longer than others."""

    def __init__(self, page: str):
        self.page, self.ends = page, {}

    def after(self, name: str, attributes: str, at: int) -> int:
        """Where an element that was opened before ``at`` ends. Where its end tag is left out, script, style and textarea go to the
        end of the page, a head to the first tag that may not stand in it, a button to the next one; of others only the tag is hidden."""
        if attributes.endswith("/") and name not in _RAW:
            return at
        if name == "head":
            for m in _TAG.finditer(self.page, at):
                tag = (m[1] or "").lower()
                if tag == "head":
                    return m.end()
                if tag and tag not in _IN_HEAD:
                    return m.start()
            return len(self.page)
        if name not in self.ends:
            tags = re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>" if name == "button" else rf"<(/){name}(?=[\s/>])[^>]*>", re.I)
            found = [(m.start(), m.end() if m[1] else m.start()) for m in tags.finditer(self.page)]
            self.ends[name] = [a for a, _ in found], [b for _, b in found]
        starts, ends = self.ends[name]
        i = bisect_left(starts, at)
        return ends[i] if i < len(ends) else len(self.page) if name in _RAW else at


class _Open:
    """The open elements that matter: containers, and others that are furniture by name."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int]] = []
        self.count: dict[str, int] = {}
        self.content, self.furniture = False, 0

    def push(self, name: str, content: bool, furniture: int) -> None:
        self.stack.append((name, self.content, self.furniture))
        self.count[name] = self.count.get(name, 0) + 1
        self.content, self.furniture = content, furniture

    def _cut(self, i: int) -> None:
        _, self.content, self.furniture = self.stack[i]
        for name, _, _ in self.stack[i:]:
            self.count[name] -= 1
        del self.stack[i:]

    def end(self, names: tuple[str, ...], over: frozenset[str]) -> None:
        """End the innermost open element of these names, unless one of ``over`` stands between."""
        if not any(self.count.get(n) for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                return self._cut(i)
            if self.stack[i][0] in over:
                return None

    def end_lines(self) -> None:
        if self.stack and self.stack[-1][0] in _LINES:
            self._cut(len(self.stack) - 1)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; blocks without text are left out."""
    out: list[Block] = []
    inside, hidden = _Open(), _Hidden(page)
    parts: list[tuple[str, bool]] = []
    link, heading = False, False
    at, n = 0, len(page)

    def close() -> None:
        words, linked, texts = 0, 0, []
        for raw, in_link in parts:
            text = unescape(raw) if "&" in raw else raw
            texts.append(text)
            count = len(text.split())
            words += count
            linked += count * in_link
        parts.clear()
        if words:
            out.append(Block(" ".join("".join(texts).split()), words, linked, inside.content, inside.furniture > _DOUBTFUL, heading, inside.furniture == _DOUBTFUL))

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append((page[at:], link))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], link))
        at = m.end()
        if not m[1]:
            continue
        name, closing = m[1].lower(), page[m.start() + 1] == "/"
        if name in _HIDDEN:
            if name not in _WITHIN:
                close()
            if not closing:
                at = hidden.after(name, m[2], at)
            continue
        if name == "a":
            link = not closing
        if name in _INLINE:
            continue
        close()
        heading = not closing and name in _HEADINGS
        if name in _VOID:
            continue
        if closing:
            inside.end((name,), frozenset() if name in _CONTAINERS else _CONTAINERS if name in _LINES else _SCOPES)
            continue
        inside.end_lines()
        if name in _SIBLINGS:
            inside.end(_SIBLINGS[name], _SCOPES)
        if name in _CONTAINERS:
            inside.push(name, *_place(name, m[2], inside.content, inside.furniture))
        elif m[2] and _named(name, m[2])[0]:
            inside.push(name, inside.content, max(inside.furniture, _BY_NAME))
    close()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_content", "in_furniture", "heading")

#: The labelled pages, by hand: a number stands for so many words, a plus before it marks a block of content. Fixed values.
LABELLED_PAGES = (
    # an article element, furniture around and inside it
    "<header><h1>3</h1><a>2</a></header><nav><ul><li><a>1</a><li><a>1</a><li><a>2</a></ul></nav><div class=ad>8</div><article><h1>+14</h1><p>+60</p><p>+25 <a>3</a></p><p>+1</p><h2>+2</h2><p>+130</p><ul><li>+5<li>+7</ul></article><footer>9</footer>",
    "<nav><a>1</a><a>1</a></nav><main><h1>+6</h1><p>+18</p><figure>+9</figure><p>+90 <a>30</a></p><div class=share><a>1</a><a>1</a></div><p>+4</p><p>+200</p><section id=comments><h3>1</h3><p>22</p><p>45</p></section></main><aside><p>30</p><p>50</p></aside>",
    "<div id=cookie-notice>15 <a>1</a></div><article><p>+2</p><p><a>+1</a></p><p>+40</p><form>3</form><p>+33 <a>4</a></p><div class=advert>35</div><p>+8</p></article><div class=related><a>6</a><a>7</a><a>5</a></div><footer>20 <a>1</a></footer>",
    "<header>2</header><article><header><h1>+9</h1><p>+4</p></header><p>+70</p><blockquote>+22</blockquote><ul><li><a>+3</a><li><a>+4</a><li><a>+2</a></ul><p>+12</p><aside>40</aside><p>+55</p></article><p>14</p><p>60</p><footer>6</footer>",
    "<div class=banner>12</div><main><p>+3</p><p>+1</p><p>+2</p></main><div>25</div><div>6 <a>3</a></div><div class=newsletter><p>18</p><form>4</form></div>",
    "<article><h1>+5</h1><p>+300</p></article><article class=comment><p>28</p></article><article class=comment><p>7</p></article><footer><p>35</p></footer>",
    "<article><h1>+2</h1><p><a>+1</a></p><p>+3</p><p><a>+2</a></p><p>+6</p><ul><li><a>+1</a><li><a>+3</a></ul><p>+1</p><p><a>+2</a></p><p>+9</p><p><a>+1</a></p></article><nav><a>1</a><a>2</a></nav>",
    "<main><h2>+4</h2><p><a>+2</a></p><p>+2</p><table><td><a>+1</a><td>+8<td><a>+1</a><td>+5<td><a>+4</a></table><h2>+1</h2><p><a>+6</a></p><p>+7</p><p><a>+3</a></p></main><div>8</div><div><a>2</a></div><div>3</div>",
    # articles and sections with a name that may be their topic, and lines that are furniture by name
    "<nav><a>1</a><a>2</a></nav><article class=tags><h1>+6</h1><p>+80</p><p>+40 <a>3</a></p><p>+9</p><p class=share-links><a>1</a> <a>1</a></p></article><footer>9</footer>",
    "<article><h1>+5</h1><p>+60</p><section class='news social'><h2>+3</h2><p>+70</p><p>+24</p><p>+12 <a>1</a></p></section><section class=social><a>1</a><a>1</a><a>2</a></section><p>+33</p><p class=advert>30</p><p>+8</p></article>",
    "<article class=search><h2>+4</h2><p>+2</p><p>+55</p><ul><li>+6<li>+9<li class=comment>40</ul></article><section class=share>3 <a>2</a><br><a>1</a></section>",
    "<main><p>+30</p><section class='legal'><p>+64</p><p>+18 <a>2</a></p><p>+5</p></section><section class=tags><a>1</a> <a>1</a> <a>1</a></section><ol><li class='comment odd'><p>20</p><p>31</p></li></ol></main>",
    # containers named as content
    "<div class=menu><a>1</a><a>2</a><a>1</a></div><div class=post-content><h2>+7</h2><p>+45</p><p>+6</p><p>+80 <a>2</a></p></div><div class=sidebar><h3>2</h3><p>40</p><a>4</a></div><div class=footer>10</div>",
    "<div id=content><p>+10</p><p>+3 <a>9</a></p><p>+65</p><div class=ad-box>30</div><p>+15</p></div><div class=comments><p>50</p><p>12</p></div>",
    # containers named as furniture, none as content
    "<div class=nav><a>1</a><a>2</a></div><h1>+7</h1><p>+50</p><p>+26 <a>2</a></p><div class=advert><p>32</p></div><p>+95</p><p>+9</p><p>+48</p><div class=sidebar><p>44</p><p>70</p><p>28</p></div><div class=footer><p>36</p><p>24</p></div>",
    "<div class=sidebar-left><p>55</p><p>31</p></div><p>+42</p><p>+120</p><p>+33</p><div class=comments><p>64</p><p>90</p><p>27</p><p>40</p></div><form><p>25</p><p>38</p></form>",
    # pages without marks: running text among links
    "<a>1</a><br><a>2</a><br><a>1</a><h1>+8</h1><p>+70</p><p>+35 <a>2</a></p><p>+90</p><p>+22</p><a>2</a><br><a>3</a><br><a>1</a>",
    "<p><a>2</a></p><p><a>1</a></p><p>+45</p><p>+11</p><p>+60</p><h2>+5</h2><p>+85</p><p>+4</p><p>+50</p><p>4 <a>9</a></p><p><a>2</a></p>",
    "<td><a>1</a></td><td><a>1</a></td><td><a>2</a></td><td>+160 <a>16</a></td><td>+28 <a>3</a></td><td>+38</td><td><a>3</a></td><td>1 <a>9</a></td>",
    "<p>+40</p><p>+18 <a>4</a></p><p>+75</p><p>+12</p><p>+30</p>",
    "<p>3</p><p><a>2</a></p><p>4 <a>1</a></p><p><a>5</a></p><p>9</p><p><a>1</a></p><p>+120</p><p>+66</p><p>+2</p><p>+31</p><p>5</p><p><a>1</a></p><p><a>1</a></p><p>6 <a>24</a></p><p><a>8</a></p>",
    "<h3>3</h3><p><a>2</a></p><p><a>2</a></p><h3>2</h3><p><a>1</a></p><p>2 <a>6</a></p><h1>+9</h1><p>+55</p><p>+140</p><p>7 <a>12</a></p><p><a>3</a></p>",
)

_FILL = re.compile(r"(\+?)(\d+)(?![^<]*>)")


def labelled_blocks(pages: tuple[str, ...] = LABELLED_PAGES) -> np.ndarray:
    """The pages' blocks: FEATURES, then 1 for content."""
    rows = []
    for page in pages:
        found = blocks_of(_FILL.sub(lambda m: m[1] + " ".join(["w"] * int(m[2])), page))
        rows.append(np.column_stack((features(found), [b.text.startswith("+") for b in found])))
    return np.concatenate(rows)


class DecisionTree:
    """Binary tree of least Gini impurity; thresholds lie between neighbouring values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.chance = float(y.mean()) if len(y) else 0.0
        self.feature = None
        if depth == 0 or len(y) < 2 * least or self.chance in (0.0, 1.0):
            return
        best = (self._gini(y) * len(y) - 1e-9, None, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                if least <= left.sum() <= len(y) - least:
                    cost = self._gini(y[left]) * left.sum() + self._gini(y[~left]) * (~left).sum()
                    if cost < best[0] - 1e-12:
                        best = (cost, f, cut)
        if best[1] is not None:
            _, self.feature, self.cut = best
            left = x[:, self.feature] <= self.cut
            self.below, self.above = DecisionTree(x[left], y[left], depth - 1, least), DecisionTree(x[~left], y[~left], depth - 1, least)

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean()
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.chance)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[left], out[~left] = self.below.predict(x[left]), self.above.predict(x[~left])
        return out


def train(table: np.ndarray | None = None) -> DecisionTree:
    table = labelled_blocks() if table is None else table
    return DecisionTree(table[:, :-1], table[:, -1])


def features(blocks: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in blocks], dtype=float)
    density = np.array([b.linked for b in blocks]) / words
    before = lambda x: np.concatenate(([0.0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0.0]))
    outside = -1.0 if any(b.content for b in blocks) else 0.0
    flags = np.array([(1.0 if b.content else outside, b.furniture + 0.5 * b.doubtful, b.heading) for b in blocks], dtype=float)
    return np.column_stack((words, density, before(words), before(density), after(words), after(density), flags))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: np.ndarray | None = None) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, n_blocks, n_content.

    text joins the content blocks by one newline; inside a block, character references are decoded and white
    space is one space. A null or empty page, and a page without content blocks, has an empty text. Null ids
    and urls stay; ids are cast to long; repeated rows are extracted each; other columns are not read. End tags that are
    left out and elements that close themselves hide no text after them. ``labelled``: FEATURES and 1 for content. No shuffle.
    """
    tree = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text=2):
            found = [blocks_of(p or "") for p in batch.column(2).to_pylist()]
            flat = [features(b) for b in found if b]
            good = tree.predict(np.concatenate(flat)) >= 0.5 if flat else np.zeros(0, bool)
            texts, n_good, at = [], [], 0
            for blocks in found:
                kept = [b.text for b, g in zip(blocks, good[at : at + len(blocks)], strict=True) if g]
                at += len(blocks)
                texts.append("\n".join(kept))
                n_good.append(len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64()), pa.array(n_good, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"],
            )

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_content long")
