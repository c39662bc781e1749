"""Furniture by name on any element, names that may be topics, and time on pages with left-out end tags."""

import time

import pytest

from worktrace.llm import html

TREE = html.train()


def extract(page):
    blocks = html.blocks_of(page)
    if not blocks:
        return ""
    good = TREE.predict(html.features(blocks)) >= 0.5
    return "\n".join(b.text for b, g in zip(blocks, good, strict=True) if g)


def w(n, word="word"):
    return " ".join([word] * n)


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article class='tags'><p>{w(80)}</p></article>", [w(80)]),
        (f"<article><p>{w(50)}</p><section class='news social'><p>{w(60, 'more')}</p></section></article>", [w(50), w(60, "more")]),
        (f"<article><p>{w(50)}</p><ul><li class='comment'>{w(40, 'reader')}</li></ul><p>{w(30)}</p></article>", [w(50), w(30)]),
        (f"<article><p>{w(50)}</p><p class='advert'>{w(40, 'buy')}</p><p>{w(30)}</p></article>", [w(50), w(30)]),
        (f"<article><p>{w(50)}</p><p class='share-links'><a>{w(3, 'share')}</a></p><p>{w(30)}</p></article>", [w(50), w(30)]),
        # without end tags: the next line, item or cell ends it
        (f"<article><p>{w(50)}<p class=advert>{w(40, 'buy')}<p>{w(30)}</article>", [w(50), w(30)]),
        (f"<article><p>{w(50)}</p><ul><li class=comment><p>{w(40, 'a')}</p><p>{w(9, 'b')}</p><ul><li>{w(8, 'c')}</li></ul>{w(7, 'd')}<li>{w(20)}</ul></article>", [w(50), w(20)]),
        (f"<article><p>{w(50)}</p><table><tr><td class=ad>{w(12, 'buy')}<td>{w(20)}<tr><td>{w(21)}</table></article>", [w(50), w(20), w(21)]),
        (f"<article><p>{w(50)}</p><blockquote class=promo><p>{w(30, 'buy')}</p></blockquote><p>{w(30)}</p></article>", [w(50), w(30)]),
        # a comment's article stays out, a share bar in a section too
        (f"<article><p>{w(50)}</p></article><article class=comment><p>{w(40, 'reader')}</p></article>", [w(50)]),
        (f"<article><p>{w(50)}</p><section class=social><a>one</a> <a>two</a> <a>three</a></section><p>{w(30)}</p></article>", [w(50), w(30)]),
    ],
)
def test_names_on_any_element(page, want):
    assert extract(page).split("\n") == want


@pytest.mark.parametrize("tag", ["<select>", "<video>", "<svg>", "<button>", "<head>", "<object>", "<p class=ad>", "<li class=ad>", "</section>", "<div></section>", "<td class=ad></p>"])
def test_time_grows_with_the_page(tag):
    def seconds(n):
        page, start = tag * n + "<p>end</p>", time.perf_counter()
        html.blocks_of(page)
        return time.perf_counter() - start

    seconds(100)
    assert min(seconds(40_000) for _ in range(2)) < 12 * min(seconds(10_000) for _ in range(2)) + 0.2
    assert seconds(10_000) < 2
