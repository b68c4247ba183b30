"""Main text of web pages: flat blocks, judged by word counts, link densities and their neighbours' by a decision tree.

A page is cut at block-level tags into a flat list of blocks.  Each has its words, the share of them inside links, the same
of the block before and after, whether it stands in an article, in an element for page furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) or in one whose name says so, and whether it is a heading.  A tree, grown on
the small labelled table below by Gini impurity, says which blocks are main text.  In an article or in furniture it goes by
that; elsewhere, the blocks' words and links and those of both neighbours decide.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# HTML elements by their part in a page.
_UNSEEN = "script style noscript template textarea select option iframe object svg math canvas audio video head title"
_FURNITURE = "nav footer aside form menu dialog button fieldset label datalist"
_INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
_HEADINGS = "h1 h2 h3 h4 h5 h6"
_VOID = "area base br col embed hr img input link meta source track wbr"
_FURNITURE_NAMES = (
    "ad ads adv advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget alert"
)
# Words of a name that take it back (no-sidebar), that mark a part of the article (entry-header), and that add nothing (ad-box).
_NEGATIONS = "no not non without has have with hide"
_CONTENT_NAMES = "article body content entry headline main page post section story text title"
_FILLERS = "area bar block box container inner item items label line link links list outer row slot text unit wrap wrapper"
_TEXT_ELEMENTS = "p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dt dd td th li"
# Furniture that may hold elements for articles: readers' comments and teasers.
_HOLDERS = "comment comments disqus recommended related replies reply respond"
_FURNITURE_ROLES = "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar"

_UNSEEN_SET, _FURNITURE_SET, _INLINE_SET, _HEADING_SET, _VOID_SET = (frozenset(x.split()) for x in (_UNSEEN, _FURNITURE, _INLINE, _HEADINGS, _VOID))
_NAMES, _ROLES = frozenset(_FURNITURE_NAMES.split()), frozenset(_FURNITURE_ROLES.split())
_NO, _CONTENT, _FILL, _TEXTUAL, _HOLDING = (frozenset(x.split()) for x in (_NEGATIONS, _CONTENT_NAMES, _FILLERS, _TEXT_ELEMENTS, _HOLDERS))
_RAW = "script|style|noscript|template|textarea|iframe|svg|math|title"
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[/!?a-zA-Z][^>]*>?",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Names of the features, in the order of the table's columns.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "element", "named", "heading")
# Labelled blocks: the features, then 1 for main text.
TABLE = (
    # In an article: its text, headings, captions, and lists of links.
    (60, 0.0, 45, 0.0, 70, 0.0, 1, 0, 0, 0, 1),
    (1, 0.0, 45, 0.0, 70, 0.0, 1, 0, 0, 0, 1),
    (3, 0.0, 9, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (9, 0.0, 0, 0.0, 60, 0.0, 1, 0, 0, 1, 1),
    (12, 0.0, 8, 1.0, 30, 0.0, 1, 0, 0, 1, 1),
    (35, 0.3, 40, 0.0, 50, 0.1, 1, 0, 0, 0, 1),
    (8, 1.0, 40, 0.0, 50, 0.0, 1, 0, 0, 0, 1),
    (4, 1.0, 5, 1.0, 3, 1.0, 1, 0, 0, 0, 1),
    (7, 1.0, 6, 1.0, 0, 0.0, 1, 0, 0, 0, 1),
    (5, 1.0, 3, 1.0, 30, 0.0, 1, 0, 0, 0, 1),
    (2, 1.0, 50, 0.0, 4, 0.9, 1, 0, 0, 0, 1),
    (120, 0.05, 3, 1.0, 2, 1.0, 1, 0, 0, 0, 1),
    (5, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0, 0, 1),
    (5, 0.0, 0, 0.0, 9, 1.0, 1, 0, 0, 0, 1),
    (28, 0.0, 0, 0.0, 6, 1.0, 1, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 3, 1.0, 1, 0, 0, 1, 1),
    # In an element for furniture, also one inside an article.
    (60, 0.0, 45, 0.0, 70, 0.0, 1, 1, 0, 0, 0),
    (9, 0.0, 40, 0.0, 60, 0.0, 1, 1, 0, 0, 0),
    (3, 1.0, 40, 0.0, 60, 0.0, 1, 1, 0, 0, 0),
    (4, 0.0, 20, 0.0, 25, 0.0, 1, 1, 0, 1, 0),
    (25, 0.1, 30, 0.0, 28, 0.0, 1, 1, 0, 0, 0),
    (60, 0.0, 45, 0.0, 70, 0.0, 0, 1, 0, 0, 0),
    (150, 0.0, 7, 0.0, 60, 0.0, 0, 1, 0, 0, 0),
    (8, 0.0, 6, 0.8, 9, 0.0, 0, 1, 0, 0, 0),
    (14, 0.1, 70, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    (5, 1.0, 4, 1.0, 12, 0.0, 0, 1, 0, 0, 0),
    (12, 1.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    (9, 1.0, 40, 0.0, 50, 0.0, 0, 1, 0, 0, 0),
    (3, 0.0, 50, 0.0, 40, 0.0, 0, 1, 0, 1, 0),
    (30, 1.0, 90, 0.0, 25, 0.0, 0, 1, 0, 0, 0),
    # In an element whose name says furniture.
    (60, 0.0, 45, 0.0, 70, 0.0, 1, 0, 1, 0, 0),
    (3, 1.0, 40, 0.0, 60, 0.0, 1, 0, 1, 0, 0),
    (4, 0.0, 20, 0.0, 25, 0.0, 1, 0, 1, 1, 0),
    (40, 0.0, 70, 0.0, 35, 0.0, 0, 0, 1, 0, 0),
    (9, 0.0, 45, 0.0, 30, 0.0, 0, 0, 1, 0, 0),
    (6, 1.0, 60, 0.0, 40, 0.0, 0, 0, 1, 0, 0),
    (150, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 0, 0),
    (3, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1, 1, 0),
    # Elsewhere: text, and what belongs to it by its neighbours.
    (60, 0.0, 45, 0.0, 70, 0.0, 0, 0, 0, 0, 1),
    (40, 0.1, 20, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (25, 0.0, 4, 1.0, 90, 0.0, 0, 0, 0, 0, 1),
    (18, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 0, 1),
    (30, 0.4, 30, 0.0, 25, 0.0, 0, 0, 0, 0, 1),
    (80, 0.2, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 1),
    (5, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 55, 0.0, 80, 0.0, 0, 0, 0, 0, 1),
    (4, 0.0, 35, 0.1, 0, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 5, 0.0, 4, 0.0, 0, 0, 0, 0, 1),
    (5, 0.0, 3, 1.0, 45, 0.0, 0, 0, 0, 0, 1),
    (4, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1, 1),
    (5, 0.0, 0, 0.0, 45, 0.0, 0, 0, 0, 1, 1),
    (6, 0.0, 70, 0.0, 35, 0.0, 0, 0, 0, 1, 1),
    (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (22, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (8, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 1),
    (12, 0.8, 40, 0.0, 35, 0.1, 0, 0, 0, 0, 1),
    (5, 0.8, 30, 0.0, 28, 0.0, 0, 0, 0, 0, 1),
    (20, 1.0, 30, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    (6, 1.0, 30, 0.0, 18, 0.0, 0, 0, 0, 0, 1),
    (10, 1.0, 22, 0.0, 20, 0.0, 0, 0, 0, 0, 1),
    (7, 1.0, 16, 0.0, 30, 0.0, 0, 0, 0, 0, 1),
    (12, 0.9, 25, 0.0, 60, 0.0, 0, 0, 0, 0, 1),
    (18, 0.0, 6, 0.0, 8, 1.0, 0, 0, 0, 0, 1),
    (28, 0.0, 0, 0.0, 5, 1.0, 0, 0, 0, 0, 1),
    (40, 0.0, 0, 0.0, 8, 1.0, 0, 0, 0, 0, 1),
    (120, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 1),
    (16, 0.0, 0, 0.0, 12, 1.0, 0, 0, 0, 0, 1),
    (20, 0.0, 5, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (9, 0.0, 14, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    # Elsewhere: menus and other links, and short blocks among them.
    (4, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 1, 0),
    (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
    (9, 0.2, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0),
    (2, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0),
    (3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 1, 0),
    (12, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0),
    (5, 1.0, 90, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (8, 1.0, 120, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    (4, 1.0, 70, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    (8, 0.9, 6, 1.0, 7, 0.8, 0, 0, 0, 0, 0),
    (20, 0.8, 18, 0.9, 15, 0.7, 0, 0, 0, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0),
    (9, 1.0, 0, 0.0, 50, 0.0, 0, 0, 0, 0, 0),
    (6, 1.0, 50, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    (12, 1.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    (9, 1.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (14, 1.0, 30, 0.0, 4, 0.0, 0, 0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0, 0, 0),
    (6, 0.9, 4, 1.0, 25, 0.1, 0, 0, 0, 0, 0),
    (30, 0.9, 25, 1.0, 40, 0.0, 0, 0, 0, 0, 0),
)


def grow(rows: tuple, least: int = 1, depth: int = 8):
    """A decision tree: a share of main text, or (feature, threshold, tree at or below it, tree above it)."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return share

    def impurity(some: list) -> float:
        p = sum(r[-1] for r in some) / len(some)
        return len(some) * 2 * p * (1 - p)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            low, high = [r for r in rows if r[f] <= a], [r for r in rows if r[f] > a]
            if min(len(low), len(high)) >= least:
                cost = impurity(low) + impurity(high)
                if best is None or cost < best[0] - 1e-12:
                    best = cost, f, (a + b) / 2, tuple(low), tuple(high)
    if best is None:
        return share
    _, f, at, low, high = best
    return f, at, grow(low, least, depth - 1), grow(high, least, depth - 1)


@lru_cache(1)
def tree():
    """The tree of TABLE."""
    return grow(TABLE)


def _main(features: tuple) -> bool:
    node = tree()
    while isinstance(node, tuple):
        f, at, low, high = node
        node = low if features[f] <= at else high
    return node >= 0.5


def named_furniture(name: str, tag: str, article: bool) -> tuple[bool, bool]:
    """Whether one class or id says furniture, and whether such that may hold elements for articles.

    A name in two words or more says it by any of them; on elements that hold text itself, only if no other word has a
    meaning of its own (related-work).  A negation before the word takes it back; a header is one of the page only outside
    articles and without a word for content.
    """
    parts = [p.lower() for p in _NAME_PARTS.split(name) if p]
    said = [k for k, p in enumerate(parts) if p in _NAMES]
    if not said:
        return "".join(parts) in _NAMES, False
    if any(p in _NO for p in parts[: said[0]]):
        return False, False
    if tag in _TEXTUAL and any(p not in _NAMES and p not in _FILL and not p.isdigit() for p in parts):
        return False, False
    if all(parts[k] == "header" for k in said) and (article or any(p in _CONTENT for p in parts)):
        return False, False
    return True, any(parts[k] in _HOLDING for k in said)


def _attributes(rest: str, tag: str, article: bool) -> tuple[str, bool, bool]:
    """What an element's attributes say: ``element`` or ``named`` furniture, ``article`` or nothing; whether it may hold
    elements for articles all the same; and whether it is hidden."""
    kind, holds, hidden = "", False, False
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            for one in value.split():
                says, may_hold = named_furniture(one, tag, article)
                kind, holds = kind or ("named" if says else ""), holds or may_hold
        elif name == "role":
            if value.lower() in _ROLES:
                kind = "element"
            elif value.lower() in ("main", "article"):
                kind = kind or "article"
        elif name == "itemprop" and value == "articleBody":
            kind = kind or "article"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDING.search(value.lower()):
            hidden = True
    return kind, holds, hidden


@dataclass
class PageBlock:
    """A block's text and what is known of it alone."""

    text: str
    words: int
    links: float
    article: bool
    element: bool
    named: bool
    heading: bool


class _Page:
    """The state of reading a page: open elements, what stands around, and the block at hand."""

    def __init__(self) -> None:
        self.out: list[PageBlock] = []
        self.stack: list[tuple[str, str, bool]] = []  # element; article, element, named, unseen or nothing; whether it holds articles
        self.count = {"article": 0, "element": 0, "named": 0, "unseen": 0}
        self.open: dict[str, int] = {}  # how often an element is open
        self.holders = 0
        self.around: list[tuple[int, int]] = []  # furniture around each open article, which doesn't count inside
        self.parts: list[tuple[str, bool]] = []
        self.link = self.heading = False

    def text(self, some: str) -> None:
        if some and not self.count["unseen"]:
            self.parts.append((some, self.link))

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(p for p, _ in self.parts)).split())
        if text:
            words = len(text.split())
            linked = sum(len(html.unescape(p).split()) for p, a in self.parts if a)
            count = self.count
            self.out.append(PageBlock(text, words, min(1.0, linked / words), count["article"] > 0, count["element"] > 0, count["named"] > 0, self.heading))
        self.parts.clear()
        self.heading = False

    def push(self, tag: str, kind: str, holds: bool) -> None:
        holds = holds or kind == "element" and tag in ("section", "ul", "ol", "aside")
        self.stack.append((tag, kind, holds))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.holders += holds
        if kind:
            self.count[kind] += 1
        if kind == "article":
            # An unclosed menu or advert before it doesn't swallow an article; comments that are articles stay in their section.
            lost = (self.count["element"], self.count["named"]) if not self.holders and self.count["article"] == 1 else (0, 0)
            self.around.append(lost)
            self.count["element"] -= lost[0]
            self.count["named"] -= lost[1]

    def pop(self) -> None:
        tag, kind, holds = self.stack.pop()
        self.open[tag] -= 1
        self.holders -= holds
        if kind:
            self.count[kind] -= 1
        if kind == "article":
            element, named = self.around.pop()
            self.count["element"] += element
            self.count["named"] += named

    def close(self, tag: str) -> None:
        """Closes the innermost such element, and what is open in it."""
        if self.open.get(tag):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()


def blocks(page: str) -> list[PageBlock]:
    """The flat blocks of a page, in order."""
    now, at = _Page(), 0
    for m in _MARKUP.finditer(page):
        now.text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and m["raw"].lower() not in ("svg", "math"):
                now.flush()
            continue
        if tag == "a":
            now.link = not m["end"]
            continue
        article = now.count["article"] > 0
        kind, holds, hidden = _attributes(m["rest"], tag, article) if m["rest"] and not m["end"] else ("", False, False)
        if tag in _INLINE_SET and not (kind in ("element", "named") or hidden or now.open.get(tag)):
            continue
        now.flush()
        if tag not in _INLINE_SET:
            now.link = False
        if m["end"]:
            now.close(tag)
            continue
        now.heading = tag in _HEADING_SET
        if tag in _VOID_SET or m["rest"].endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and now.stack and now.stack[-1][0] == tag:
            now.pop()
        if tag in ("html", "body", "main") and kind == "named":
            kind, holds = "", False
        if tag in _UNSEEN_SET or hidden:
            kind = "unseen" if hidden or tag not in ("head", "title") else ""
        elif tag in _FURNITURE_SET or tag == "header" and not article:
            kind = "element"
        elif tag in ("article", "main") and not kind:
            kind = "article"
        if tag == "body":
            while now.stack:
                now.pop()
        now.push(tag, kind, holds)
    now.text(page[at:])
    now.flush()
    return now.out


def main_text(page: str) -> str:
    """The blocks of a page that are main text, in page order, joined by one space."""
    found = blocks(page)
    kept = []
    for k, b in enumerate(found):
        before, after = ((found[j].words, found[j].links) if 0 <= j < len(found) else (0, 0.0) for j in (k - 1, k + 1))
        if _main((b.words, b.links, *before, *after, b.article, b.element, b.named, b.heading)):
            kept.append(b.text)
    return " ".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [main_text(h) if h else "" for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns page_id, url, text and n_chars (code points) for every row of ``pages``.

    A null or empty page gives an empty text.  Markup that is cut short or left open is read as far as it goes.  Repeated rows
    and null ids are kept; an empty table gives an empty result; other columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
