"""Main text of web pages: text-to-tag ratio of lines, smoothed and clustered.

The standard library's parser streams a page's events. Block elements end lines; each line keeps its
text, its tags, its link text and the node of the page's tree it stands in. Lines in menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never count as content.
The ratio of text to tags over the other lines is smoothed with a Gaussian, and a threshold splits them
into content and rest. The content region is the innermost container that holds all content lines: all
its lines are the main text, short ones included, and so are headings directly before it. Where articles
hold nearly all text of the content lines, only the lines in articles count as content.

What is boilerplate is told by element, by role and by class names. A name counts as a whole or by its
first or last part, unless another part says otherwise (``has-sidebar``). Elements that were never
closed, and containers that turn out to hold the article, don't count: markup is no reason to lose it.
Nodes are numbered as they open, so that a node's descendants are a range of numbers, and the time is
linear in the page whatever its depth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr br img".split()
)
ROOTS = frozenset(["html", "body"])
#: Elements that never hold main text, and those that hold none unless they turn out to hold the article.
NEVER = frozenset(
    "script style noscript template dialog iframe object select option textarea button input svg canvas audio video "
    "head title datalist".split()
)
STRUCTURAL = frozenset("nav header footer aside form menu fieldset search".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav "
    "navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "widgets cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments commentlist "
    "disqus replies respond reply toolbar pagination pager skip copyright disclaimer legal".split()
)
#: Names that also count as the first part of a longer one, those of readers' comments, and parts that take a name back.
LEADING = frozenset("ad ads advert nav navbar menu submenu breadcrumb footer sidebar cookie cookies comment comments sponsored".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond reply".split())
RETRACTING = frozenset("has no not non with without is show hide open closed enabled disabled free content main article body text page post guide".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split()
)
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
_NAME = re.compile(r"[^a-z0-9]+")

SIGMA = 1.5
#: Share of the mean ratio that a content line's smoothed ratio reaches.
THRESHOLD = 0.5
#: Share of the content lines' text from which articles are the page's main part.
HELD = 0.8
#: Share of link text from which a line outside an article is a menu.
LINKED = 0.6
#: Share of the page's text from which a container is the page, whatever it is called.
WHOLE = 0.9
#: Why a node may be boilerplate.
PLAIN, ALWAYS, BY_TAG, BY_NAME, BY_COMMENT = range(5)


def name_kind(value: str) -> int:
    """What a ``class`` or ``id`` says."""
    kind = PLAIN
    for name in value.lower().split():
        parts = [p for p in _NAME.split(name) if p]
        if not parts or len(parts) > 1 and not RETRACTING.isdisjoint(parts):
            continue
        if parts[-1] in BOILERPLATE_NAMES or parts[0] in LEADING or len(parts) == 1 and parts[0] in BOILERPLATE_NAMES:
            kind = max(kind, BY_COMMENT if not COMMENTS.isdisjoint(parts) else BY_NAME)
    return kind


def node_kind(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """Whether and why an element may be boilerplate. A header inside an article is the article's."""
    if tag in NEVER:
        return ALWAYS
    kind = BY_TAG if tag in STRUCTURAL and not (tag == "header" and in_article) else PLAIN
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return ALWAYS
        if name == "role" and value and value.lower() in BOILERPLATE_ROLES:
            kind = kind or BY_TAG
        elif name in ("class", "id") and value and tag not in ROOTS and tag != "main":
            kind = kind or name_kind(value)
    return kind


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    node: int
    in_article: bool
    heading: bool


class Lines(HTMLParser):
    """Lines and tree of a page. Node 0 is the page; a node's descendants are numbered up to its ``last``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Line] = []
        self.parent, self.last, self.kind, self.tag = [0], [0], [PLAIN], [""]
        self.unclosed: set[int] = set()
        self.stack: list[tuple[str, int]] = []
        self.open: Counter[str] = Counter()
        self.blocks = [0]
        self.text: list[str] = []
        self.tags = self.linked = self.headings = self.articles = 0

    def parse_html_declaration(self, i: int) -> int:
        # Marked sections that the standard library refuses are passed over like comments.
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append(Line(text, max(self.tags, 1), self.linked, self.blocks[-1], self.articles > 0, self.headings > 0))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                self.text.append(" ")
            elif tag == "hr":
                self.end_line()
            return
        if tag not in INLINE:
            self.end_line()
            if tag in _P_ENDERS:
                self._close("p", _P_ENDERS)
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._close(tag, frozenset(["ul", "ol", "dl", "table", "select", "tr"]) - {tag})
        node = len(self.parent)
        self.parent.append(self.stack[-1][1] if self.stack else 0)
        self.last.append(node)
        self.kind.append(node_kind(tag, attrs, self.articles > 0))
        self.tag.append(tag)
        self.stack.append((tag, node))
        self.open[tag] += 1
        self.headings += tag in HEADINGS
        self.articles += tag in ARTICLE
        if tag not in INLINE or self.kind[-1]:
            self.blocks.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def _close(self, tag: str, stop: frozenset[str]) -> None:
        """Close an open ``tag`` that no element of ``stop`` separates from here."""
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return
            if self.stack[k][0] in stop:
                return

    def _pop(self, k: int) -> None:
        for tag, node in reversed(self.stack[k:]):
            self.last[node] = len(self.parent) - 1
            self.open[tag] -= 1
            self.headings -= tag in HEADINGS
            self.articles -= tag in ARTICLE
            if self.blocks[-1] == node:
                self.blocks.pop()
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID or not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag not in INLINE:
                    self.end_line()
                if tag in ROOTS:
                    self.unclosed.update(node for _, node in self.stack[k + 1 :])
                self._pop(k)
                return
            # An inline end tag never closes a block.
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.open["a"]:
            self.linked += len(data.strip())

    def finish(self) -> None:
        self.close()
        self.end_line()
        self.unclosed.update(node for _, node in self.stack)
        self._pop(0)
        self.last[0] = len(self.parent) - 1

    def under(self, weights: np.ndarray) -> np.ndarray:
        """Sum of a weight per node over each node and its descendants."""
        total = np.concatenate([[0], np.cumsum(weights)])
        return total[np.array(self.last) + 1] - total[: len(self.last)]

    def covered(self, nodes: np.ndarray) -> np.ndarray:
        """Which nodes are one of ``nodes`` or below one."""
        edge = np.zeros(len(self.last) + 1, np.int64)
        np.add.at(edge, nodes, 1)
        np.add.at(edge, np.array(self.last)[nodes] + 1, -1)
        return np.cumsum(edge)[:-1] > 0

    def boilerplate(self) -> np.ndarray:
        """Which nodes are boilerplate or stand in it."""
        kind, tag = np.array(self.kind), np.array(self.tag, object)
        size = np.bincount([x.node for x in self.out], [len(x.text) for x in self.out], len(kind))
        closed = np.ones(len(kind), bool)
        closed[list(self.unclosed)] = False
        article = self.under((tag == "main") | (tag == "article") & (kind == PLAIN)) > 0
        titled = self.under((tag == "h1") | (tag == "main")) > 0
        whole = lambda mass: self.under(mass) >= WHOLE * max(mass.sum(), 1)
        by_tag = (kind == BY_TAG) & closed & ~article & ~((tag == "form") & titled & whole(size))
        gone = self.covered(np.flatnonzero((kind == ALWAYS) | by_tag))
        left = whole(np.where(gone, 0, size))
        by_name = (kind == BY_NAME) & ~titled & ~article & ~left | (kind == BY_COMMENT) & ~titled & ~left
        return gone | self.covered(np.flatnonzero(by_name))


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at the edges and weighted anew."""
    reach = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(ratio, kernel)[reach : reach + len(ratio)]
    return whole / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def main_text(html: str | None) -> str:
    """The main text: blocks in page order, one to a line; empty if there is none."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    if not page.out:
        return ""
    gone = page.boilerplate()
    lines = [x for x in page.out if not gone[x.node]]
    # Menus without markup of their own are lines of links.
    own = [k for k, x in enumerate(lines) if x.in_article or x.linked < LINKED * len(x.text)]
    if not own:
        return ""
    size = np.array([len(lines[k].text) for k in own], float)
    ratio = smooth(size / np.array([lines[k].tags for k in own]))
    content = np.flatnonzero(ratio >= THRESHOLD * ratio.mean())
    inside = np.array([k for k in content if lines[own[k]].in_article], int)
    main = len(inside) and size[inside].sum() >= HELD * size[content].sum()
    chosen = [own[k] for k in (inside if main else content)]
    # A line's own block is no container, but articles, html and body may hold text directly.
    outer = ARTICLE | ROOTS
    holders = [n if page.tag[n] in outer or not n else page.parent[n] for n in (lines[k].node for k in chosen)]
    region, end = min(holders), max(holders)
    while page.last[region] < end:
        region = page.parent[region]
    around = region
    while around and page.tag[around] not in ARTICLE:
        around = page.parent[around]
    region = around or region
    within = [k for k, x in enumerate(lines) if region <= x.node <= page.last[region]]
    text = set(own)
    kept = [k for k in within if k in text or chosen[0] < k < chosen[-1]]
    first = kept[0]
    while not main and first and lines[first - 1].heading:
        first -= 1
    return "\n".join(lines[k].text for k in [*range(first, kept[0]), *kept])


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` as ``text_col``, its former column replaced.

    A null or empty page, and a page of boilerplate alone, give an empty text. Repeated rows stay
    repeated, all other columns are kept, an empty table stays empty. Nothing is shuffled.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([main_text(x) for x in html], dtype=object)

    return pages.withColumn(text_col, texts(F.col(html_col).cast("string")))
