"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped into lines: every block element is a line, and elements that never belong to the article (menus,
headers, footers, sidebars, forms, scripts, adverts, notices, comments, by tag, role, class or id) leave empty lines
behind. ``WINDOW`` consecutive lines form a block, whose size is the length of its text outside links. Sizes surge
where running text begins and dive to nothing where it ends. The text between the surge and the dive is kept if one
of its blocks has ``SURGE`` characters, however long other blocks are; if no block of the page has, the largest is kept.

Names are evidence only. An element with most of the plain text of the page is never left out for its class or id, if
the page's title stands in it or if it leaves hardly any text behind; the page is then read again with it.

Where a page marks its article (``article`` or ``main``), that is a hint: no dive is looked for inside, so that short
paragraphs and gaps in it stay, and all its text between surge and dive counts. Text outside is judged like any other.

White space inside a line becomes one space, character references are decoded, and lines are joined by line breaks.

Cases: NULL and empty pages, and pages without text, have the empty text; broken markup is read as far as it goes;
repeated rows get a result each; rows without page_id or url are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrisk.llm.text import slices

WINDOW = 3
SURGE = 60  # characters of a block where running text may begin

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
TITLES = frozenset(("h1", "main"))  # a page has them in its article, not in what stands around it
NEGATED = frozenset("no not non has with without hide is js".split())  # "no-sidebar" is no sidebar
DROPPED = frozenset(
    "aside audio button canvas dialog embed fieldset footer form head header iframe input map menu nav noscript object "
    "script select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment commentlist "
    "comments consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related "
    "respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar "
    "topbar widget".split()
)
ARTICLE = frozenset(("article", "main"))
NOT_INSIDE_PARAGRAPH = frozenset(
    "address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
    "p pre section table ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table body html div article main section".split())


class Lines(HTMLParser):
    """Text lines of a page with the size of their text outside links, and whether they stand in the article."""

    def __init__(self, spared: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.spared = spared  # elements that stay whatever their class and id
        self.named: list[list] = []  # elements that go because of class or id: number, plain text, whether with a title
        self.plain = 0  # plain text of the page but for elements that go because of their tag or role
        self.titled = False  # a title stands outside all of them
        self._seen = 0
        self._going: list[list | None] = []  # the outermost such element that is open, or None for one that goes by tag
        self.lines: list[tuple[str, int, bool]] = []
        self._open: list[tuple[str, str]] = []  # tag, and what it does: drop, link, article or nothing
        self._drop = self._link = self._article = self._heading = 0
        self._text: list[str] = []
        self._plain = 0

    def break_line(self, empty: int = 0) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.lines.append((text, self._plain, self._article > 0))
            self._text, self._plain = [], 0
        if empty and self.lines and self.lines[-1][0]:
            self.lines += [("", 0, self._article > 0)] * empty

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.break_line()
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        if tag in NOT_INSIDE_PARAGRAPH:
            self._close_until(("p",), LISTS)
        elif tag in CLOSES:
            self._close_until(CLOSES[tag], LISTS)
        does = ""
        self._seen += 1
        by_tag = tag not in ("html", "body") and self._is_dropped(tag, attrs)
        if tag in TITLES:
            if not self._going:
                self.titled = True
            elif self._going[0]:
                self._going[0][2] = True
        if by_tag or (tag not in ("html", "body") and self._seen not in self.spared and self._is_named(tag, attrs)):
            does = "drop"
            self.break_line(WINDOW)
            self._drop += 1
            self._going.append(None if by_tag else [self._seen, 0, False])
        elif tag == "a":
            does = "link"
            self._link += 1
        elif tag in ARTICLE and not self._drop:
            does = "article"
            self._article += 1
            if self._article == 1:
                self.lines += [("", 0, False)] * WINDOW
        self._open.append((tag, does))

    def _is_dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag == "header" and self._article:
            return False  # the heading of the article
        if tag in DROPPED:
            return True
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and "display:none" in value.replace(" ", ""):
                return True
            if name == "role" and value in ROLES:
                return True
        return False

    @staticmethod
    def _is_named(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether class or id name something else than an article."""
        for name, value in attrs:
            if name not in ("class", "id"):
                continue
            value = (value or "").lower()
            if tag == "article" and "comment" in value:
                return True
            words = [re.split(r"[^a-z]+", one) for one in value.split()]
            if tag not in ARTICLE and any(w[0] not in NEGATED and not NAMES.isdisjoint(w) for w in words):
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.break_line()
        if tag not in VOID and any(t == tag for t, _ in reversed(self._open)):
            while self._close() != tag:
                pass

    def _close_until(self, tags: tuple[str, ...], barriers: frozenset[str]) -> None:
        """Close the nearest open element of ``tags`` with all inside it, unless a barrier comes first."""
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in tags:
                while len(self._open) > i:
                    self._close()
                return
            if self._open[i][0] in barriers:
                return

    def _close(self) -> str:
        tag, does = self._open.pop()
        if does == "drop":
            self.break_line()
            self._drop -= 1
            gone = self._going.pop()
            if gone and not self._drop:
                self.named.append(gone)
        elif does == "link":
            self._link -= 1
        elif does == "article":
            self.break_line()
            self._article -= 1
            if not self._article:
                self.lines += [("", 0, False)] * WINDOW
        return tag

    def handle_data(self, data: str) -> None:
        plain = 0 if self._link else len(data.strip())
        if not self._drop:
            self._text.append(data)
            self._plain += plain
            self.plain += plain
        elif None not in self._going:
            self._going[0][1] += plain
            self.plain += plain

    def close(self) -> None:
        super().close()
        while self._open:  # elements that are never closed end with the page
            self._close()
        self.break_line()

    def mistaken(self) -> set[int]:
        """Elements with most of the page's plain text whose name cannot mean what it seems to: they hold the page's
        title, or hardly anything else is left of a page that marks neither title nor article."""
        marked = self.titled or any(inside for text, _, inside in self.lines if text)
        left = sum(plain for _, plain, _ in self.lines)
        return {
            number
            for number, size, title in self.named
            if 2 * size > self.plain and (title or (not marked and size >= 4 * SURGE and 10 * left < size))
        }


def runs(sizes: np.ndarray, inside: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind the last) line of every stretch between a surge and the dive to nothing after it."""
    if not len(sizes):
        return []
    held = np.where(inside, np.maximum(sizes, 1), sizes)  # no dive inside the article
    sums = np.convolve(held, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of the block that begins at each line
    filled = np.concatenate(([0], sums > 0, [0])).astype(np.int8)
    begins, ends = np.flatnonzero(np.diff(filled) == 1), np.flatnonzero(np.diff(filled) == -1)
    # A block begins up to WINDOW - 1 empty lines before its text.
    filled = np.flatnonzero(held)
    first, last = filled[np.searchsorted(filled, begins)], filled[np.searchsorted(filled, ends) - 1]
    found = []
    for a, b, low, high in zip(begins.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
        marked = int(sizes[low : high + 1][inside[low : high + 1]].sum())
        found.append((max(int(sums[a:b].max()), marked), low, high + 1))
    least = min(SURGE, max((size for size, _, _ in found), default=0))
    return [(low, high) for size, low, high in found if size >= least]


def main_text(page: str | None) -> str:
    spared: frozenset[int] = frozenset()
    while True:
        parser = Lines(spared)
        parser.feed(page or "")
        parser.close()
        lines = parser.lines
        sizes = np.array([plain for _, plain, _ in lines], np.int64)
        found = runs(sizes, np.array([inside for _, _, inside in lines], bool))
        mistaken = parser.mistaken()
        if not mistaken:
            return "\n".join(text for a, b in found for text, _, _ in lines[a:b] if text)
        spared |= mistaken


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(page) for page in part.column("html").to_pylist()]
                n = pa.array([len(t) for t in texts], pa.int64())
                arrays = [part.column("page_id"), part.column("url"), pa.array(texts), n]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
