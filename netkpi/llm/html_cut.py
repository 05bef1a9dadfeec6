"""Main text of web pages by a minimum cut.

A page is cut into blocks of text at block-level tags. Each block gets two costs from a small
classifier (tags, class and id names of the elements around it, share of text in links, length,
end of sentence): one for calling it content, one for calling it boilerplate. They become the
capacities of its edges to the two terminals. Blocks that follow each other, and blocks that follow
each other in the same element, are tied by smoothness edges, the stronger the nearer they are in
the tree. The minimum cut, found by maximum flow, is the cheapest labelling of the whole page.

Evidence against an element (a sidebar, a form, comments) holds for all in it, unless the page has its
prose there: a page-wide form, or an element with most of the prose of the page, is a wrapper, and its
evidence is void. Prose in main, and any short text in article, counts more; where the evidence is strong
(nav, aside, comments, ads), only text in these tags counts. Hidden text stays out.

Pages are independent: no shuffle, and a task holds one Arrow batch and the graph of one page.

Defined cases: a null or empty html has the empty text. Markup need not be closed or nested well;
unclosed script and style reach to the end, other elements without text of the page only to the end of
their tag; svg and math may be closed in their tag. Repeated rows give repeated rows. The
input's columns travel in a struct, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from netkpi.llm.common import workers_import

# HTML's element kinds and the names that page authors use.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math"}
#: Of these, all to the end of the page if they are not closed; and those that can be closed in their tag.
RAW_TO_END, FOREIGN = {"script", "style"}, {"svg", "math"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr", "img", "input", "br",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open element of the left is closed by the start of one on the right.
CLOSED_BY = {
    "p": {
        "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form",
        "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
    },
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"},
}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"}
CONTENT_TAGS = {"article", "main"}
OTHER_TAGS = {"nav", "footer", "aside", "menu", "dialog", "button", "select"}
FORM_TAGS = {"form", "fieldset"}
#: What a form has inside only if it is around the page.
PAGE_TAGS = {"article", "main", "nav", "header", "footer", "h1"}
CONTENT_NAMES = {"article", "content", "main", "post", "entry", "story", "body", "text"}
#: Parts of the page that authors also name in wrappers, and texts that are no part of the main text.
PLACE_NAMES = {
    "banner", "notice", "notices", "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "signup",
    "signin", "login", "sidebar", "side", "menu", "nav", "navbar", "navigation", "footer", "masthead", "topbar",
    "toolbar", "share", "sharing", "social", "widget", "copyright", "legal", "search", "skip", "alert", "disclaimer",
}
OTHER_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "breadcrumb", "breadcrumbs", "related", "recommended", "comments", "comment",
    "commentlist", "disqus", "replies", "reply", "respond", "pagination", "pager", "contentinfo", "complementary",
}
#: A name that begins so says what the layout has ("with-sidebar"), not what the element is.
LAYOUT = {"with", "without", "no", "not", "non", "has", "have"}

#: Evidence against an element, by strength.
WEAK, FORM, STRONG, HIDDEN = 1, 2, 3, 4
#: Kinds of elements with content that text is in.
CONTENT, MAIN = 1, 2
#: Prose starts at so many characters; a wrapper has so much prose, and so many times that of the rest of the page.
PROSE, WRAPPER_PROSE, WRAPPER_SHARE = 40, 200, 3

#: Costs are integers, in tenths.
IN_CONTENT, IN_OTHER, IN_HEADER, NEAR, FAR = 60, 130, 40, 20, 10

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=20_000)
def _evidence(tag: str, attributes: str) -> tuple[int, int, int]:
    """What an element says of the text in it: for content, against content, strength of what rules it out."""
    if tag in ("html", "body", "head"):
        return 0, 0, 0
    names: set[str] = set()
    content = tag in CONTENT_TAGS
    for name in " ".join(x for groups in _NAMES.findall(attributes) for x in groups).split():
        parts = [part.lower() for part in _PARTS.findall(name)]
        if parts and parts[0] not in LAYOUT:
            names.update(parts)
            content = content or not (CONTENT_NAMES.isdisjoint(parts) or _names_other(parts))
    own = IN_CONTENT if content else 0
    if _HIDDEN.search(attributes):
        return 0, 0, HIDDEN
    if tag in OTHER_TAGS or names & OTHER_NAMES:
        return own, 0, STRONG
    if names & PLACE_NAMES:
        return own, 0, WEAK
    if tag in FORM_TAGS:
        return own, 0, FORM
    if tag == "header" or "header" in names:
        return 0, IN_HEADER, 0
    return own, 0, 0


def _names_other(parts: list[str]) -> bool:
    return not (OTHER_NAMES.isdisjoint(parts) and PLACE_NAMES.isdisjoint(parts))


@dataclass
class Block:
    text: str
    link_chars: int
    tag: str
    parent: int
    path: tuple[int, ...]
    content: int
    other: int


class _Against:
    """Evidence against an element, or against elements of one kind in the same element."""

    def __init__(self, above: _Against | None, strength: int):
        self.above, self.strength = above, strength
        self.depth: int = above.depth + 1 if above else 0
        #: The strongest of this and those above.
        self.strongest: int = max(strength, above.strongest if above else 0)
        #: Characters of prose straight in it, of those the ones in content elements and in main.
        self.prose = self.in_content = self.in_main = 0
        #: Whether it is void, as then are all above.
        self.void = self.page_wide = False

    def lift(self) -> int:
        """Makes this and those above void; the prose that is free now."""
        a, prose = self, 0
        while a is not None and not a.void:
            a.void = True
            prose += a.prose
            a = a.above
        return prose


def _lift_wrappers(against: list[_Against], free: int) -> None:
    """Makes evidence void that would leave the page without its prose; ``free`` is the prose nothing is said against."""
    for a in against:
        if a.page_wide and (a.above is None or a.above.void):
            free += a.lift()
    for a in sorted(against, key=lambda a: (a.depth, -a.prose)):
        if a.strongest == HIDDEN or a.void:
            continue
        prose = a.in_content if a.strongest == STRONG else a.prose
        if prose + 2 * a.in_content >= WRAPPER_PROSE and prose + 2 * a.in_main >= WRAPPER_SHARE * free:
            free += a.lift()


class _Element:
    __slots__ = ("tag", "number", "content", "other", "path", "against", "within")

    def __init__(
        self, tag: str, number: int, content: int, other: int, path: tuple[int, ...], against: _Against | None, within: int
    ):
        self.tag, self.number, self.content, self.other, self.path = tag, number, content, other, path
        self.against, self.within = against, within


def blocks_of(html: str) -> list[Block]:
    """Texts between block-level tags, in page order, with what the elements around them say."""
    root = _Element("", 0, 0, 0, (0,), None, 0)
    stack, blocks, count = [root], [], 0
    held: list[tuple[Block, _Against]] = []
    against_of: dict[tuple, _Against] = {}
    free, unclosed = 0, set()
    pieces: list[str] = []
    link_chars, in_link, at, end = 0, False, 0, len(html)

    def close() -> None:
        nonlocal link_chars, free
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                e = stack[-1]
                b = Block(text, min(link_chars, len(text)), e.tag, e.number, e.path, e.content, e.other)
                blocks.append(b)
                prose = len(text) - b.link_chars if len(text) >= PROSE and 2 * b.link_chars < len(text) else 0
                if e.against is None:
                    free += prose
                else:
                    held.append((b, e.against))
                    e.against.prose += prose
                    e.against.in_content += prose if e.within else 0
                    e.against.in_main += prose if e.within == MAIN else 0
            pieces.clear()
        link_chars = 0

    def add(text: str) -> None:
        nonlocal link_chars
        if text:
            pieces.append(text)
            if in_link:
                link_chars += len(text.strip())

    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                pieces.append(" ")
            continue
        close()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                del stack[depth:]
                in_link = False
            continue
        attributes = (m[3] if m[3] is not None else m[6]) or ""
        if tag in RAW:
            if tag in unclosed or (tag in FOREIGN and attributes.endswith("/")):
                continue
            over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if over:
                at = over.end()
            elif tag in RAW_TO_END:
                at = end
            else:
                unclosed.add(tag)
            continue
        if tag in VOID:
            continue
        if tag in CLOSED_BY.get(stack[-1].tag, ()):
            stack.pop()
        above = stack[-1]
        content, other, strength = _evidence(tag, attributes)
        against, within = above.against, above.within
        if tag in CONTENT_TAGS or (content and (against is None or against.strongest < STRONG)):
            within = max(within, MAIN if tag == "main" else CONTENT)
        if against is not None and against.strength == FORM and tag in PAGE_TAGS:
            against.page_wide = True
        if strength:
            kind = (above.number, tag, attributes)
            if kind not in against_of:
                against_of[kind] = _Against(against, strength)
            # what an element with strong evidence calls itself does not count for it
            against, within = against_of[kind], CONTENT if content and strength < STRONG else 0
        # a header of the article is its title as often as not
        other = max(above.other, other if not above.content else other // 2)
        content = max(content, above.content)
        count += 1
        stack.append(_Element(tag, count, content, other, (*above.path[-7:], count), against, within))
    close()
    if held:
        _lift_wrappers(list(against_of.values()), free)
        for b, against in held:
            if not against.void:
                b.content, b.other = 0, IN_OTHER
    return blocks


def costs(b: Block) -> tuple[int, int]:
    """Cost of calling the block boilerplate, cost of calling it content."""
    linked = b.link_chars / len(b.text)
    content = b.content + int(min(len(b.text) / 4, 50) * (1 - linked))
    other = b.other + int(80 * linked) + 10
    if b.tag in TEXT_TAGS:
        content += 20
    elif not b.content:
        other += 30
    if b.text[-1] in ".!?:;\"'»”…。":
        content += 10
    if len(b.text) < 25:
        other += 20
    return content, other


def ties(blocks: list[Block]) -> Iterator[tuple[int, int, int]]:
    """Smoothness edges: neighbours in the page, and the next block in the same element around."""
    last_in: dict[int, int] = {}
    for i, b in enumerate(blocks):
        around = b.path[-2] if len(b.path) > 1 else 0
        if i:
            shared = len(set(b.path) & set(blocks[i - 1].path))
            yield i - 1, i, NEAR if around in blocks[i - 1].path else FAR if shared > 2 else FAR // 2
        before = last_in.get(around)
        if before is not None and before < i - 1:
            yield before, i, FAR
        last_in[around] = i


def content_side(costs_of: list[tuple[int, int]], edges: Iterator[tuple[int, int, int]]) -> list[bool]:
    """Minimum cut by maximum flow (shortest augmenting paths by levels).

    What a node can pass straight from source to sink is sent first; each node then hangs on one
    terminal at most. On a tie a node is boilerplate.
    """
    n = len(costs_of)
    spare = [a - b for a, b in costs_of]  # > 0: capacity from the source, < 0: to the sink
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, weight in edges:
        for x, y in ((a, b), (b, a)):
            out[x].append(len(to))
            to.append(y)
            room.append(weight)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if spare[i] > 0)
        for i in queue:
            level[i] = 0
        sinks = False
        while queue:
            x = queue.popleft()
            if spare[x] < 0:
                sinks = True
                continue
            for e in out[x]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if not sinks:
            return [x >= 0 for x in level]
        nexts = [0] * n
        for start in range(n):
            while spare[start] > 0:
                path: list[int] = []
                x = start
                while spare[x] >= 0:
                    while nexts[x] < len(out[x]):
                        e = out[x][nexts[x]]
                        if room[e] and level[to[e]] == level[x] + 1:
                            break
                        nexts[x] += 1
                    if nexts[x] < len(out[x]):
                        path.append(e)
                        x = to[e]
                    elif path:
                        x = to[path.pop() ^ 1]
                        nexts[x] += 1
                    else:
                        break
                if spare[x] >= 0:
                    break
                flow = min(spare[start], -spare[x], *(room[e] for e in path))
                spare[start] -= flow
                spare[x] += flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def main_text(html: str | None) -> str:
    """The content blocks in page order, with an empty line between them."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    kept = content_side([costs(b) for b in blocks], ties(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``row`` (struct of the input's columns), ``text`` and ``n_chars`` (its code points)."""
    workers_import(pages.sparkSession)
    rows = pages.select(F.struct("*").alias("row"), F.col(html_col).alias("html"))
    schema = StructType([rows.schema["row"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["row", "text", "n_chars"],
            )

    return rows.mapInArrow(run, schema)
