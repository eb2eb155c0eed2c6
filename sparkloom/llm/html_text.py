"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering of content regions.

The standard library's parser streams events over the whole page. Block elements cut the page into lines; each line carries its text,
the number of tags seen in it, the chain of open containers and the kind of part it stands in. Only scripts, controls and what a page does
not show are dropped while parsing. All other lines are scored by their text-to-tag ratio alone, smoothed over their neighbours with a
Gaussian. A threshold between the two clusters of scores marks lines; what a marked line's score exceeds it by is its mass. The
mass chooses the regions:

* the articles (main elements alike) with mass are regions, and so are the page's other articles that aren't mostly link text;
* marked lines outside articles, menus' too, join if the mass that they have of their own, not of a neighbour, is ``RIVAL`` times the articles';
* where no article has mass, the region is the innermost container around all marked lines, and of the rest of the page only containers
  that are mostly link text are dropped;
* every line of a region is kept, headings and short paragraphs included, but for menus that are mostly link text.

Names break the ties that ratios can't: footers, asides, forms, adverts, notices and reader comments are prose like the text, so a part that
says so by element, class, id or role is no region, and is left out of one. Menus are not judged by name but by their scores. All steps are
linear in the page's length and nesting.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship

# Fixed values of HTML: elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template head title button select textarea iframe svg canvas object audio video dialog".split())
ASIDE = frozenset("header footer aside".split())
MENU_ELEMENTS = frozenset("nav menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose start closes an open p.
CLOSES_P = BLOCK - frozenset("body head html option title".split())
CONTAINER = frozenset("article aside body details dialog div footer form header html main menu nav section table td".split())
#: Class and id words of parts that are not main text. A name counts if each of its words is one of these or of PLAIN, and one is of these.
PART = frozenset(
    "ad ads advert advertisement banner comment comments consent cookie cookies disqus footer gdpr masthead modal newsletter notice popup promo promoted related reply replies sidebar signup sponsor sponsored subscribe subscription widget".split()
)
#: Words of menus, which are left to their scores.
MENUS = frozenset("breadcrumb breadcrumbs menu nav navbar navigation pagination pager search share sharing skip social toolbar".split())
PLAIN = frozenset("site main global top bottom primary secondary list area box bar block links link buttons form reader user post page section".split())
WORDS = re.compile(r"[a-z]+")
ROLES = frozenset("banner contentinfo complementary search form dialog alert".split())
MENU_ROLES = frozenset("navigation menu menubar".split())
SPACE = re.compile(r"\s+")
SIGMA, REACH = 1.0, 3
#: How many times the articles' mass what stands outside them needs to join.
RIVAL = 0.02
#: Kinds of parts: main text; menus, left to their scores; not main text, but an article may stand in it; not main text; never text.
TEXT, MENU, NAMED, PLACED, HIDDEN = range(5)


def names_part(value: str) -> int:
    """The kind that blank-separated names give an element: site-footer is no main text, main-nav a menu, has-sidebar and related-work say nothing."""
    kind = TEXT
    for name in value.lower().split():
        words = WORDS.findall(name)
        if any(w in PART or w in MENUS for w in words) and all(w in PART or w in MENUS or w in PLAIN for w in words):
            kind = max(kind, NAMED if any(w in PART for w in words) else MENU)
    return kind


class _Events(HTMLParser):
    """Collects lines (text, tags, container number, article number, characters in links, kind of part)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.serial = self.linked = self.paragraphs = 0
        self.link = False
        self.around = [0]  # the container around each container
        self.open: list[tuple[str, int, int, int]] = []  # element, and kind, container and article around it
        self.opened: Counter[str] = Counter()  # open elements by name
        self.kind, self.container, self.article = TEXT, 0, 0  # article: negative inside a named part

    def line(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            self.text = []
            if text:
                self.lines.append((text, max(self.tags, 1), self.container, self.article, self.linked, self.kind))
                self.tags = 0
            self.linked = 0

    def part(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """The kind of part that an element makes of itself; parts within a line are hidden."""
        if tag in NEVER or any(name == "hidden" for name, _ in attrs):
            return HIDDEN
        named = 0 if tag in ("html", "body", "article", "main") else max((names_part(value) for name, value in attrs if name in ("class", "id") and value), default=0)
        roles = {value.lower() for name, value in attrs if name == "role" and value}
        # a header of an article belongs to it
        if tag in ASIDE and not (tag == "header" and self.article) or roles & ROLES:
            kind = PLACED
        elif tag == "form" or named == NAMED:
            kind = NAMED
        else:
            kind = MENU if named or tag in MENU_ELEMENTS or roles & MENU_ROLES else TEXT
        return kind if tag in BLOCK or not kind else HIDDEN

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK:
            if self.paragraphs and tag in CLOSES_P:
                self.end_element("p")
            self.line()
        if tag == "a":
            self.link = True
        if tag in VOID:
            return
        self.open.append((tag, self.kind, self.container, self.article))
        self.opened[tag] += 1
        self.paragraphs += tag == "p"
        lifted = tag in ("article", "main") and not self.article and self.kind == NAMED and not (tag == "article" and any(v and n in ("class", "id") and names_part(v) == NAMED for n, v in attrs))
        self.kind = TEXT if lifted else max(self.kind, self.part(tag, attrs))
        if tag in CONTAINER:
            self.serial += 1
            self.around.append(self.container)
            self.container = self.serial
            if tag in ("article", "main") and not self.article:
                self.article = -self.serial if lifted else self.serial

    def end_element(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1) if self.opened[tag] else ():
            if self.open[k][0] == tag:
                if tag in BLOCK:
                    self.line()
                self.link = False  # a link left open ends with its block
                _, self.kind, self.container, self.article = self.open[k]
                gone = Counter(o[0] for o in self.open[k:])
                self.opened -= gone
                self.paragraphs -= gone["p"]
                del self.open[k:]
                return
            if tag == "p" and self.open[k][0] in CONTAINER:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.link = False
        if tag in BLOCK or tag in NEVER:
            self.end_element(tag)
        elif tag not in VOID:
            for k in range(len(self.open) - 1, -1, -1) if self.opened[tag] else ():
                if self.open[k][0] == tag:
                    # formatting elements end without their block, and with what their attributes made of their text
                    self.kind = self.open[k][1] if k == len(self.open) - 1 else self.kind
                    del self.open[k]
                    self.opened[tag] -= 1
                    return
                if self.open[k][0] in BLOCK:
                    return

    def handle_data(self, data):
        if self.kind != HIDDEN:
            self.text.append(data)
            if self.link:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[REACH : REACH + len(ratios)]
    return np.convolve(ratios, kernel, "full")[REACH : REACH + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Midway between the means of two clusters, from the extremes on until they stay; below the least value if all are alike."""
    low, high = float(values.min()), float(values.max())
    if high - low < 1e-9:
        return low - 1
    for _ in range(32):
        cut = (low + high) / 2
        a, b = float(values[values <= cut].mean()), float(values[values > cut].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


def scores(lines: list[tuple]) -> np.ndarray:
    """Smoothed text-to-tag ratios."""
    return smoothed(np.array([len(line[0]) / line[1] for line in lines]))


def main_text(html: str) -> str:
    events = _Events()
    events.feed(html)
    events.close()
    events.line()
    lines = events.lines
    # articles inside parts that aren't main text by name count where the page has no other article and they outweigh the rest
    sure, rest, lifted = (sum(len(line[0]) for line in lines if line[5] == TEXT and f(line[3])) for f in (lambda a: a > 0, lambda a: a == 0, lambda a: a < 0))
    if lifted and (sure or lifted <= rest):
        lines = [line for line in lines if line[3] >= 0]
    if not any(line[5] == TEXT for line in lines):
        return ""
    found = scores(lines)
    cut = threshold(found)
    mass = np.maximum(found - cut, 0)
    own = np.maximum(np.minimum(found, [len(line[0]) / line[1] for line in lines]) - cut, 0)  # not lent by a neighbour
    size, linked, articles, outside = Counter(), Counter(), Counter(), 0.0
    for (text, _, c, article, n, kind), m, alone in zip(lines, mass, own, strict=True):
        for at in {("container", c), ("article", article)}:
            size[at] += len(text)
            linked[at] += n
        if m and kind <= MENU:
            if article and kind == TEXT:
                articles[article] += m
            elif not article:
                outside += alone

    def links(*at) -> bool:
        return 2 * linked[at] > size[at]

    def kept(line: tuple) -> bool:
        """A line of a region: none of a part that is no main text, nor of a menu of links."""
        return line[5] == TEXT or line[5] == MENU and not links("container", line[2])

    if articles:
        hold = set(articles) | {a for a in {line[3] for line in lines} - {0} if not links("article", a)}
        joins = outside >= RIVAL * sum(articles.values())
        return "\n".join(line[0] for line, m in zip(lines, own, strict=True) if (kept(line) if line[3] in hold else joins and m > 0 and not line[3] and line[5] <= MENU))
    marked = [line[2] for line, m in zip(lines, mass, strict=True) if m > 0 and line[5] == TEXT] or [line[2] for line in lines if line[5] == TEXT]
    # containers are numbered as they open, so what stands in one has the numbers up to its last
    last = list(range(len(events.around)))
    for c in range(len(last) - 1, 0, -1):
        last[events.around[c]] = max(last[events.around[c]], last[c])
    top, deepest = min(marked), max(marked)
    while last[top] < deepest:
        top = events.around[top]
    return "\n".join(line[0] for line in lines if kept(line) and (top <= line[2] <= last[top] or not links("container", line[2])))


def _extract(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages (page_id, url, html).

    Character references are decoded, white space inside a block is one space, blocks are joined by one newline in page order. A null
    or empty page, or one without main text, gives an empty text. Null ids and urls stay null, repeated rows stay, other columns are
    ignored, an empty table gives an empty result. Pages are parsed whole.
    """
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").try_cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
