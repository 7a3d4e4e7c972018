"""Main text of HTML pages by text-to-tag ratios.

A streaming parser cuts a page into lines at block elements and counts, per line, characters, characters
in links and tags. Lines of elements that are never part of an article (menus, footers, forms and the like) get
the ratio 0, as do those of elements whose class or id names them so (adverts, comments), unless such an element holds
an article element or most of the page's text: names do not decide on the main region. The ratios are
smoothed with a Gaussian kernel and split at a threshold into clusters; clusters of high ratio select the
content regions. A region inside an article element takes in that element's other lines, so short paragraphs stay,
and of several article elements those with much less selected text than the largest (teasers) go. Elsewhere a region
is what lies between its first and last line of high ratio, without lines that are mostly links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import in_batches, pieces

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "script style noscript template head title nav footer aside form button select textarea iframe object svg canvas "
    "audio video menu dialog".split())
SELF_CLOSED_BY_SAME = frozenset(["p", "li", "dd", "dt", "option", "tr"])
NEVER_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar sidebars widget widgets related recommended share sharing social comment comments disqus replies respond "
    "footer masthead newsletter subscribe signup login search pagination pager toolbar copyright".split())
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption address".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
OPEN_TAG_AT_END = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
KERNEL_RADIUS = 2
KERNEL_SIGMA = 1.0


@dataclass
class Line:
    text: str
    linked: int
    tags: int
    never: bool
    article: int  # number of the outermost article element, 0 outside
    main: int  # number of the main element, 0 outside
    named: tuple[int, ...]  # numbers of the open elements that are named like furniture


@dataclass
class Named:
    """An open element whose class or id has a word of furniture."""

    tag: str
    number: int
    nested: int
    articles: int


def is_furniture(tag: str, attributes: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element's name, role or style says that it is not part of an article."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    for name, value in attributes:
        value = value or ""
        if name == "role" and value.strip().lower() in NEVER_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def names_furniture(tag: str, attributes: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether a class or the id begins or ends with a word of furniture; elements of text need it as a whole."""
    if tag in ("html", "body", "main"):
        return False
    for name, value in attributes:
        for token in (value or "").split() if name in ("class", "id") else ():
            words = [w.lower() for w in WORDS.findall(token)]
            if len(words) > 1 and tag in TEXT_ELEMENTS:
                continue
            ends = {*words[:1], *words[-1:]}
            if ends & NEVER_WORDS or ("header" in ends and not in_article and tag != "article"):
                return True
    return False


class LineParser(HTMLParser):
    """Collects lines from parser events; holds one line's text besides what is finished."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = self.tags = self.links = 0
        self.open: list[tuple[str, int]] = []  # article and main elements
        self.named: list[Named] = []
        self.holding: set[int] = set()  # named elements that hold an article or main element
        self.numbers = 0
        self.skipped: str | None = None
        self.nested = 0

    @property
    def articles(self) -> int:
        return len(self.open)

    def outermost(self, tag: str) -> int:
        return next((n for t, n in self.open if t == tag), 0)

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(
                text, self.linked, self.tags, self.skipped is not None, self.outermost("article"), self.outermost("main"),
                tuple(x.number for x in self.named)))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.skipped is not None:
            if tag == self.skipped:
                if tag not in SELF_CLOSED_BY_SAME:
                    self.nested += 1
                    return
                self.leave()
            else:
                if tag in BLOCKS:
                    self.cut()
                self.tags += 1
                return
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag not in VOID and is_furniture(tag, attrs, self.articles > 0):
            self.cut()
            self.skipped, self.nested = tag, 1
            return
        self.note_names(tag, attrs)
        if tag in ("article", "main"):
            self.holding.update(x.number for x in self.named if x.number != self.numbers or x.tag != tag)
            self.numbers += 1
            self.open.append((tag, self.numbers))
        elif tag == "a":
            self.links = 1
        elif tag in ("td", "th"):
            self.parts.append(" ")

    def note_names(self, tag: str, attrs) -> None:
        for x in self.named:
            x.nested += x.tag == tag and tag not in SELF_CLOSED_BY_SAME
        if self.named and self.named[-1].tag == tag and tag in SELF_CLOSED_BY_SAME:
            self.named.pop()
        if tag not in VOID and names_furniture(tag, attrs, self.articles > 0):
            self.cut()
            self.numbers += 1
            self.named.append(Named(tag, self.numbers, 1, self.articles))

    def close_names(self, tag: str) -> None:
        """Ends the named element that ``tag`` closes, and those inside it; an article's end those begun in it."""
        for i in range(len(self.named)):
            x = self.named[i]
            x.nested -= x.tag == tag
            if not x.nested or (tag in ("article", "main") and x.articles >= self.articles > 0):
                self.cut()
                del self.named[i:]
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "li", "a", "article", "main", "div", "section", "b", "i", "span"):
            self.handle_endtag(tag)

    def leave(self) -> None:
        self.cut()
        self.skipped, self.nested = None, 0

    def handle_endtag(self, tag):
        self.tags += 1
        if self.skipped is not None:
            if tag == self.skipped:
                self.nested -= 1
                if not self.nested:
                    self.leave()
            elif tag in ("body", "html", "article", "main") and self.skipped not in ("script", "style"):
                self.leave()
                self.handle_endtag(tag)
            elif tag in BLOCKS:
                self.cut()
            return
        if tag in BLOCKS:
            self.cut()
        self.close_names(tag)
        if tag in ("article", "main"):
            self.open[-1:] = []
        elif tag == "a":
            self.links = 0

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def parse_lines(html: str) -> list[Line]:
    parser = LineParser()
    parser.feed(OPEN_TAG_AT_END.sub("", html))
    parser.close()
    parser.cut()
    without_named(parser.lines, parser.holding)
    return parser.lines


def own_text(line: Line) -> int:
    return len(line.text) - min(line.linked, len(line.text))


def without_named(lines: list[Line], holding: set[int]) -> None:
    """Marks the lines of named elements, but not of those that hold an article or half of the page's text."""
    held: dict[int, int] = {}
    total = 0
    for x in lines:
        if not x.never:
            total += own_text(x)
            for number in x.named:
                held[number] = held.get(number, 0) + own_text(x)
    gone = {n for n, chars in held.items() if n not in holding and 2 * chars < total}
    for x in lines:
        x.never = x.never or not gone.isdisjoint(x.named)


def smoothed_ratios(lines: list[Line]) -> np.ndarray:
    ratios = np.array([0.0 if x.never else own_text(x) / max(1, x.tags) for x in lines])
    steps = np.arange(-KERNEL_RADIUS, KERNEL_RADIUS + 1)
    kernel = np.exp(-(steps**2) / (2 * KERNEL_SIGMA**2))
    return np.convolve(np.pad(ratios, KERNEL_RADIUS), kernel / kernel.sum(), mode="valid")


def content_lines(lines: list[Line]) -> list[Line]:
    """Lines of the content regions, in page order."""
    usable = [not x.never for x in lines]
    if not any(usable):
        return []
    smooth = smoothed_ratios(lines)
    threshold = min(smooth.std(), smooth[usable].mean() / 2)
    high = [u and s > 0 and s >= threshold for u, s in zip(usable, smooth, strict=True)]
    if not any(high):
        return []
    found: dict[tuple[int, int], int] = {}
    for h, x in zip(high, lines, strict=True):
        if h and (x.article or x.main):
            found[x.article, x.main] = found.get((x.article, x.main), 0) + own_text(x)
    if found:
        most = max(found.values())
        chosen = {key for key, chars in found.items() if 2 * chars >= most}
        chosen |= {(0, main) for article, main in chosen if main}  # what the main element itself holds, such as a title
        return [x for u, x in zip(usable, lines, strict=True) if u and (x.article, x.main) in chosen]
    first, last = high.index(True), len(high) - 1 - high[::-1].index(True)
    return [x for u, x in list(zip(usable, lines, strict=True))[first : last + 1] if u and 2 * x.linked <= len(x.text)]


def main_text(html: str | None) -> str:
    """Main text of a page: one line per block, white space inside a block as one space; "" if there is none."""
    return "\n".join(x.text for x in content_lines(parse_lines(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html).

    A null, empty or text-free page has the text "". Unclosed elements and cut-off pages are read as far as
    they go. Ids and addresses are passed on as they are, nulls and repeats included; other columns are
    dropped; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            for piece in pieces(batch, "html"):
                texts = [main_text(x) for x in pc.fill_null(piece.column("html"), "").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string())],
                    ["page_id", "url", "text"])

    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.mapInArrow(run, "page_id long, url string, text string")
