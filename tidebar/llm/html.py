"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one for each stretch between block borders. Each line
has the ratio of its characters to its tags. The ratios of a page are smoothed with a Gaussian and split by a
threshold into content and other lines; the innermost element that holds nearly all content lines is the content region.
All its lines are returned, but for those inside elements that are marked as something else, and for lists of links.
The ``article`` elements of a page together, or else its ``main``, are a candidate of more weight and need a lower share.
A line break element starts a new line like a block. Elements are numbered as they open, so those inside an element follow it, and sums over
elements are made in one sweep backwards: time is linear in the page, however deep it is nested.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML, and names that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe li main menu nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split())
FURNITURE_TAGS = frozenset("nav header footer aside form script style noscript template head title iframe select button textarea dialog menu svg object canvas".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer header masthead menu menus modal nav navbar navigation newsletter notice notices notification "
    "overlay pagination pager popup promo promotion related reply replies respond search share sharing sidebar sidebars signup skip social "
    "sponsor sponsored subscribe toolbar topbar widget widgets".split())
UNNAMED_TAGS = frozenset("html body article main".split())  # hold the page or its text, whatever their class says
NEUTRAL_STARTS = frozenset("category format has hide is no not show tag type with without".split())  # as in no-sidebar
CLOSED_BY_PEERS = frozenset("li dt dd tr td th option".split())
CONTENT_ELEMENTS = ("article", "main")
SIGMA = 1.5
SHARE = 0.8               # of the content characters that the region must hold
WEIGHT = 1.25             # of content characters inside CONTENT_ELEMENTS
LINKED = 0.6              # share of link text from which a list is a menu


class Line:
    __slots__ = ("text", "tags", "links", "linked", "element", "doubt")

    def __init__(self, element: int, doubt: int):
        self.text, self.tags, self.links, self.linked, self.element, self.doubt = [], 0, 0, 0, element, doubt


class Lines(HTMLParser):
    """Parser events to lines. Elements that only page furniture has are skipped as they stream by.

    Elements whose class or id merely begins or ends with the name of furniture are in doubt: their lines are kept and
    judged by the share of the page that they hold.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []          # (tag, furniture, element, doubt) of what is open
        self.counts: Counter = Counter()
        self.furniture = self.in_link = 0
        self.tags, self.parents, self.ends = [""], [0], [0]  # by element; 0 is the page; ends: last element inside
        self.lines: list[Line] = []
        self.line: Line | None = None
        self.pending = 0

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:               # a section of no known kind is a comment up to the next >
            return self.parse_bogus_comment(i)

    def flush(self):
        if self.line is not None:
            self.line.text = " ".join("".join(self.line.text).split())
            if self.line.text:
                self.lines.append(self.line)
            self.line = None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            if tag != "br" and self.counts["p"] and self.open[-1][0] == "p":
                self.pop()
        if tag in CLOSED_BY_PEERS and self.open and self.open[-1][0] == tag:
            self.pop()
        self.pending += 1
        if tag in VOID:
            return
        element, doubt = self.open[-1][2:] if self.open else (0, 0)
        named = 0 if tag in UNNAMED_TAGS else naming(attrs)
        furniture = tag in FURNITURE_TAGS or named == 2 or hidden(attrs)
        if tag in BLOCK and tag != "p":
            self.tags.append(tag)
            self.parents.append(element)
            self.ends.append(0)
            element = len(self.tags) - 1
            if named == 1 and not doubt:
                doubt = element
        self.open.append((tag, furniture, element, doubt))
        self.counts[tag] += 1
        self.furniture += furniture
        self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self):
        tag, furniture, element, _ = self.open.pop()
        self.ends[element] = len(self.tags) - 1
        self.counts[tag] -= 1
        self.furniture -= furniture
        self.in_link -= tag == "a"

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.pending += 1
        if self.counts[tag]:
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        if self.furniture:
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = Line(*(self.open[-1][2:] if self.open else (0, 0)))
        self.line.tags += self.pending
        self.pending = 0
        self.line.text.append(data)
        if self.in_link:
            self.line.links += 1
            self.line.linked += len(data.strip())

    def finish(self):
        self.close()
        self.flush()
        while self.open:
            self.pop()
        self.ends[0] = len(self.tags) - 1

    def sums(self, lines: list[Line], value: Callable[[Line], int]) -> list[int]:
        """Sum of ``value`` over the lines in each element."""
        out = [0] * len(self.tags)
        for x in lines:
            out[x.element] += value(x)
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out

    def inside(self, chosen: Callable[[int], bool]) -> list[bool]:
        """Whether each element is or lies in a chosen one."""
        out = [False] * len(self.tags)
        for e in range(1, len(out)):
            out[e] = out[self.parents[e]] or chosen(e)
        return out


def hidden(attrs) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value and value.lower() in FURNITURE_ROLES for name, value in attrs)


def naming(attrs) -> int:
    """2: a class or id is the name of furniture; 1: one begins or ends with such a name (``ad-slot``, ``site-footer``); 0: none."""
    found = 0
    for name, value in attrs:
        if value and name in ("class", "id"):
            for own in value.lower().split():
                parts = own.replace("_", "-").strip("-").split("-")
                if own in FURNITURE_NAMES:
                    return 2
                if parts[0] not in NEUTRAL_STARTS and (parts[0] in FURNITURE_NAMES or parts[-1] in FURNITURE_NAMES):
                    found = 1
    return found


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(weights[j - i + reach], ratios[j]) for j in range(max(0, i - reach), min(len(ratios), i + reach + 1))]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def main_text(html: str | None) -> str:
    """Main text of a page: blocks in page order, one line each. Null and empty pages have none, nor have pages without text."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    lines = undoubted(page)
    if not lines:
        return ""
    ratios = smoothed([len(x.text) / max(x.tags, 1) for x in lines])
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    content = [x for x, r in zip(lines, ratios) if r >= min(threshold, mean) and x.linked < LINKED * len(x.text)] or lines
    whole = sum(len(x.text) for x in content)
    for kind in CONTENT_ELEMENTS:
        within = page.inside(lambda e: page.tags[e] == kind)  # noqa: B023
        if WEIGHT * sum(len(x.text) for x in content if within[x.element]) >= SHARE * whole:
            return "\n".join(x.text for x in unlisted(page, [x for x in lines if within[x.element]]))
    mass = page.sums(content, lambda x: len(x.text))
    region = max(e for e, m in enumerate(mass) if m >= SHARE * whole)
    return "\n".join(x.text for x in unlisted(page, [x for x in lines if region <= x.element <= page.ends[region]]))


def undoubted(page: Lines) -> list[Line]:
    """Lines but for those in elements in doubt that hold at most half of the text."""
    held: Counter = Counter()
    for x in page.lines:
        held[x.doubt] += len(x.text)
    half = sum(held.values()) / 2
    return [x for x in page.lines if not x.doubt or held[x.doubt] > half]


def unlisted(page: Lines, lines: list[Line]) -> list[Line]:
    """Lines that do not stand in a list of links."""
    size, linked, links = (page.sums(lines, value) for value in (lambda x: len(x.text), lambda x: x.linked, lambda x: x.links))
    menu = page.inside(lambda e: page.tags[e] in ("ul", "ol") and links[e] >= 3 and linked[e] >= LINKED * size[e])
    return [x for x in lines if not menu[x.element]]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``, repeated rows included.

    Null or empty html gives an empty text. Ill-formed pages are read as far as they make sense: an end tag closes what
    is open inside its element, one without an open element is ignored.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
