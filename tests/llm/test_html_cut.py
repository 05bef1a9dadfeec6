from __future__ import annotations

import random
from itertools import product

import pytest

from netkpi.llm.html_cut import blocks_of, content_side, extract, main_text

LONG = "This is a paragraph of the article with enough words to look like prose. "


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


ARTICLE = f"<article><h1>Title &amp; more</h1><p>{LONG}</p><p>Short.</p><p>A&nbsp; b\n\t c<br>d <i>e</i><!-- no --></p></article>"
TEXT = f"Title & more\n\n{LONG.strip()}\n\nShort.\n\nA b c d e"


@pytest.mark.parametrize(
    "other",
    [
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News and more news</a></li></ul></nav>",
        "<header><div class='logo'>The daily page</div></header>",
        "<footer>&copy; example &middot; all rights reserved, in a long line of small print.</footer>",
        f"<aside><h2>Sidebar</h2><p>{LONG}</p></aside>",
        f"<div class='sidebar'><p>{LONG}</p></div>",
        f"<div class='cookie-notice'><p>{LONG}{LONG}</p></div>",
        f"<div id='ad-top' class='ad'>{LONG}</div>",
        "<form action='/s'><p>Search this site for what you want to read.</p><input name=q></form>",
        f"<section class='comments'><h2>Comments</h2><div class='comment'><p>{LONG}</p></div></section>",
        f"<div id=comments><article class=comment><p>{LONG}</p></article></div>",
        f"<div style='display:none'><p>{LONG}</p></div>",
        "<noscript><p>Please enable scripts to read this page.</p></noscript>",
    ],
)
def test_leaves_the_rest_of_the_page(other):
    assert main_text(page(other + ARTICLE)) == TEXT
    assert main_text(page(ARTICLE + other)) == TEXT
    inside = ARTICLE.replace("<p>Short.", other + "<p>Short.")
    if "<header" not in other:
        assert main_text(page(inside)) == TEXT


def test_other_containers():
    assert main_text(page(f"<div class='menu'>a b c</div><main><p>{LONG}</p></main>")) == LONG.strip()
    assert main_text(page(f"<div><p>{LONG}{LONG}</p><p>{LONG}</p></div><div><a href=x>one</a> <a href=y>two</a></div>")) == (
        f"{(LONG + LONG).strip()}\n\n{LONG.strip()}"
    )


PROSE = f"<h1>Title</h1><p>{LONG}{LONG}{LONG}</p><p>Short.</p><p>{LONG}</p>"
PROSE_TEXT = f"Title\n\n{(LONG * 3).strip()}\n\nShort.\n\n{LONG.strip()}"
SIDE = f"<div class='sidebar'><p>{LONG}</p></div>"


@pytest.mark.parametrize(
    "body",
    [
        f"<div class='layout with-sidebar'><article>{PROSE}</article>{SIDE}</div>",
        f"<div id='main' class='no-sidebar'>{PROSE}</div>",
        f"<article class='post has-comments'>{PROSE}<div class='comments'><p>{LONG}</p></div></article>",
        f"<div class='story search-result'>{PROSE}</div>",
        f"<div class='content-sidebar-wrap'><main>{PROSE}</main>{SIDE}</div>",
        f"<div class='search-page'>{PROSE}{SIDE}</div>",
        f"<form id='aspnetForm' action='/p.aspx'><div><nav><a href=x>Home</a></nav><div>{PROSE}</div>{SIDE}</div></form>",
        f"<form action='/p.aspx'><div>{PROSE}</div></form>",
        f"<aside><article>{PROSE}</article></aside>",
        f"<svg/><math display='block' /><svg class=icon /><article>{PROSE}</article>",
        f"<object data=x><article>{PROSE}</article>",
        f"<article><noscript>{PROSE}</article>",
    ],
)
def test_evidence_against_wrappers(body):
    assert main_text(page(body)) == PROSE_TEXT


def test_evidence_stays_where_prose_is_elsewhere():
    many = f"<p>{LONG * 5}</p>"
    for other in ("comments", "ad", "cookie-notice", "related"):
        assert main_text(page(f"<div class='{other}'>{many}</div>")) == ""
        assert main_text(page(f"<div class='{other}'>{many}</div><article>{PROSE}</article>")) == PROSE_TEXT
    assert main_text(page(f"<div style='display:none'><article>{many}</article></div>")) == ""
    assert main_text(page(f"<aside>{many}</aside><div class='widget'><p>{LONG * 3}</p></div><article>{PROSE}</article>")) == PROSE_TEXT
    quoted = f"<div class='comments'><div class='text'>{many * 9}</div></div>"
    assert main_text(page(quoted + f"<article>{PROSE}</article>")) == PROSE_TEXT
    assert main_text("<div class='ad'>" * 3000 + "deep") == ""
    assert main_text("<svg><title>icon</title><text>drawn</text></svg>" + PROSE) == PROSE_TEXT


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<p", "<script>never ends", "<nav>only a menu</nav>"])
def test_nothing_to_find(html):
    assert main_text(html) == ""


def test_bad_markup():
    assert main_text("<article><p><b>One long enough sentence here.<br><p>Two, unclosed, is here.</div></article><footer>x</footer>") == (
        "One long enough sentence here.\n\nTwo, unclosed, is here."
    )
    assert main_text("<article><p>Where a < b and c > d, <span y='>'>as it should.</p>") == "Where a < b and c > d, as it should."
    many = "<article>" + "".join(f"<p>Paragraph number {i} of the text." for i in range(3000))
    assert main_text(many).count("\n\n") == 2999
    assert len(blocks_of("<div>" * 3000 + "deep")) == 1


def test_cut_is_least():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 7)
        costs = [(r.randint(0, 9), r.randint(0, 9)) for _ in range(n)]
        edges = [(a, b, r.randint(0, 6)) for a in range(n) for b in range(a) if r.random() < 0.6]

        def price(kept):
            return sum(b if k else a for (a, b), k in zip(costs, kept)) + sum(w for a, b, w in edges if kept[a] != kept[b])

        assert price(content_side(costs, iter(edges))) == min(map(price, product([False, True], repeat=n)))


def test_pages(spark):
    rows = [(1, "u", page(ARTICLE), "x"), (1, "u", page(ARTICLE), "x"), (2, None, None, "y"), (None, "v", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted((r.row.page_id or 0, r.row.text, r.text, r.n_chars) for r in extract(df).collect())
    assert found == [(0, "z", "", 0), (1, "x", TEXT, len(TEXT)), (1, "x", TEXT, len(TEXT)), (2, "y", "", 0)]
    assert extract(df.limit(0)).collect() == []
