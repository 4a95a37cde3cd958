"""Main-text extraction by text-to-tag ratios.

The standard library's parser streams events. They are cut into lines at block-level tags; each line has a count of
text characters and of tags. The ratio of the two is smoothed with a Gaussian along the page, two-means clustering sets
a threshold, and the lines above it mark the content regions, on every page and wherever they lie. A region is completed
to the whole container it lies in (the outermost article or main, else the section, div, ...), so short paragraphs
between long ones stay; an article without a region isn't kept, nor are the lists of links in a region's container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never count. Where only
a word of a class or id says so, the element counts all the same if it holds the page's article or most of the text of
the lines above the threshold. Such a word must name the element (``left-sidebar``, not ``with-sidebar``).

A nav, aside, footer or the like drops its text if its own end tag closes it; one that never ends is judged like an
element that only a class names, and so is a form or fieldset, which may surround a whole page. Work is in proportion to the
page, however deep or broken its tags are; the mark of a comment that nothing closes is text.

Defined cases: null or empty html gives an empty text; a page without any block gives its plain text; broken or unclosed
markup is read as the parser reports it; very long pages are streamed event by event; repeated rows give equal texts,
ties of the two clusters count as above; a null page_id or url comes back null; extra columns, whatever their names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: Fixed lists of HTML elements by their role.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("aside audio button canvas dialog fieldset footer form head iframe input label menu nav noscript object option script select style svg template textarea title video".split())
CONTAINERS = set("article body div main section td".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements of DROPPED, and header, that surround other blocks.
AROUND = set("aside dialog fieldset footer form header menu nav".split())
#: Those of them that some pages have around all they hold.
WRAPPERS = set("fieldset form".split())
#: A stray end tag of another kind doesn't close these.
KEEPS = set("article body main table".split())
#: A start tag of the left closes an open element of the right.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {b: {"p"} for b in BLOCKS - set("li dt dd tr td th option".split())}
_ROLE = re.compile(r"ads?|advert\w*|banners?|breadcrumbs?|consent|cookies?|footers?|gdpr|masthead|menus?|modals?|navs?|navbar|navigation|newsletters?|notices?|pagination|popups?|promos?|promotions?|related|share|sharing|sidebars?|skiplinks?|social|sponsor\w*|subscribe|subscription|toolbar|widgets?")
_PAIRS = re.compile(r"(?:byline|skip)[^a-z]links?")
_READERS = re.compile(r"comments?|commentlist|disqus\w*|replies|respond")
_PAGE_ROLE = re.compile(r"headers?|topbar")
#: Parts of a class that say how an element looks or is placed in, after the word that names it; and parts that say what a page has or does.
_FORM = set("area bar block body box button buttons col column container content form group icon icons inner item items link links list outer panel row section slot unit wrap wrapper".split())
_STATE = set("active closed disabled enabled has hide is no not off on open show with without".split())
_ARIA = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}


@lru_cache(4096)
def role(names: str) -> str:
    """What the classes and id of an element name: readers, other, header or nothing."""
    found = ""
    for token in names.lower().split():
        parts = [x for x in re.split("[^a-z]+", token) if x]
        if not parts or _STATE.intersection(parts):
            continue
        if _READERS.fullmatch(parts[0]) and len(parts) <= 2 or _READERS.fullmatch(parts[-1]):
            return "readers"
        while len(parts) > 1 and parts[-1] in _FORM:
            parts.pop()
        if _ROLE.fullmatch(parts[-1]) or _PAIRS.fullmatch(token):
            found = "other"
        elif _PAGE_ROLE.fullmatch(parts[-1]):
            found = found or "header"
    return found


class _Line(NamedTuple):
    text: str
    tags: int
    linked: bool  # most of it is links, and it is no heading
    dropped: bool
    named: int  # the innermost element around it that a class, an id or its tag gives a role; -1 if there is none
    box: int
    page: int  # the outermost article or main, 0 if there is none


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int, int, bool, int]] = []  # tag, dropped, named, box, page, in a link, named itself
        self.places: dict[str, list[int]] = {}  # open elements of each tag
        self.keeps: list[int] = []  # open elements of KEEPS
        self.text: list[str] = []
        self.tags = self.links = self.containers = 0
        self.heading = self.unclosed = False
        self.named: list[str] = []  # role of each named element: readers, other, header, tag for an element of AROUND, wrapper for one of WRAPPERS
        self.parent: list[int] = []  # the named element around each
        self.readers: list[bool] = []  # whether it is, or lies in, reader comments
        self.holding: list[bool] = []  # whether it holds an article or main that isn't a reader's
        self.closed: list[bool] = []  # whether its own end tag closed it
        self.lines: list[_Line] = []

    def state(self) -> tuple[bool, int, int, int, bool]:
        return self.stack[-1][1:6] if self.stack else (False, -1, 0, 0, False)

    def pop(self) -> None:
        tag = self.stack.pop()[0]
        self.places[tag].pop()
        if tag in KEEPS:
            self.keeps.pop()

    def name(self, kind: str, around: int) -> int:
        self.named.append(kind)
        self.parent.append(around)
        self.readers.append(kind == "readers" or (around >= 0 and self.readers[around]))
        self.holding.append(False)
        self.closed.append(False)
        return len(self.named) - 1

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(_Line(text, self.tags, 2 * self.links > len(text) and not self.heading, *self.state()[:4]))
        if text or self.text:
            self.tags = 0
        self.links, self.heading = 0, False
        self.text.clear()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            ends = CLOSES.get(tag, ())
            while self.stack and self.stack[-1][0] in ends:
                self.pop()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        dropped, named, box, page, link = self.state()
        own = -1
        if not dropped:
            a = {k: v or "" for k, v in attrs}
            around = tag in AROUND and (tag != "header" or not page)
            dropped = (
                (tag in DROPPED and not around)
                or a.get("hidden", "until-found").lower() != "until-found"
                or a.get("aria-hidden") == "true"
                or a.get("role", "") in _ARIA
                or "display:none" in a.get("style", "").replace(" ", "")
            )
            names = f"{a.get('class', '')} {a.get('id', '')}".strip()
            kind = role(names) if names and tag not in ("html", "body", "main") else ""
            if tag in ("article", "main") and not dropped and kind != "readers" and named >= 0 and not self.readers[named]:
                self.holding[named] = True
            if around and not dropped:
                own = named = self.name("wrapper" if tag in WRAPPERS else "tag", named)
            if kind and (kind != "header" or not page):
                named = self.name(kind, named)
        if tag in CONTAINERS:
            self.containers += 1
            box = self.containers
        if tag in ("article", "main"):
            page = page or box
        self.heading = self.heading or tag in HEADINGS
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in KEEPS:
            self.keeps.append(len(self.stack))
        self.stack.append((tag, dropped, named, box, page, link or tag == "a", own))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        at = self.places.get(tag)
        if not at or (self.keeps and at[-1] < self.keeps[-1] and tag not in KEEPS and tag != "html"):
            return  # nothing to close, or only what surrounds an article, a table, ...
        k = at[-1]
        if self.stack[k][6] >= 0:
            self.closed[self.stack[k][6]] = True
        while len(self.stack) > k:
            self.pop()

    def parse_comment(self, i, report=1):
        if not self.unclosed:
            k = super().parse_comment(i, report)
            if k >= 0:
                return k
            self.unclosed = True  # pages are fed whole, so no later comment ends either
        self.handle_data("<!--")
        return i + 4

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][0] in ("script", "style")):
            self.text.append(data)
            if self.state()[4]:
                self.links += len(" ".join(data.split()))


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    r = max(1, int(round(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, k, "full")[r:-r] / np.convolve(np.ones(len(x)), k, "full")[r:-r]


def two_means(x: np.ndarray) -> float:
    """The threshold between two clusters of values."""
    lo, hi = float(x.min()), float(x.max())
    if hi <= lo:
        return lo
    for _ in range(50):
        cut = (lo + hi) / 2
        new = float(x[x < cut].mean()), float(x[x >= cut].mean())
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def above(dropped: list[bool], lines: list[_Line], sigma: float) -> list[bool]:
    """Whether the smoothed ratio of each line reaches the threshold; none does on a page without free text."""
    ratio = np.array([0.0 if d else len(x.text) / max(1, x.tags) for x, d in zip(lines, dropped, strict=True)])
    if not ratio.any():
        return [False] * len(lines)
    level = smooth(ratio, sigma)
    return [h and not d for h, d in zip((level >= two_means(level)).tolist(), dropped, strict=True)]


def left_out(parser: _Lines, hot: list[bool]) -> list[bool]:
    """Whether each named element is dropped, by itself or with one around it; outer ones are judged first.

    One stays if it holds an article or main and no less hot text than what else is free, or most of the hot text (nearly
    all, if an article or main has free text outside it). Reader comments stay only if nothing else is free.
    """
    m = len(parser.named)
    text, lines, paged = [0] * (m + 1), [0] * (m + 1), [0] * (m + 1)  # of lines right in each element; the last: in none
    for x, h in zip(parser.lines, hot, strict=True):
        if not x.dropped:
            lines[x.named] += 1
            paged[x.named] += bool(x.page)
            text[x.named] += len(x.text) * h
    total, held, holding = sum(text), text[:m], parser.holding[:]
    for k in range(m - 1, -1, -1):
        if parser.parent[k] >= 0:
            held[parser.parent[k]] += held[k]
            holding[parser.parent[k]] |= holding[k]
    free = [text[m], lines[m], paged[m]]
    gone = [True] * m
    for k, kind in enumerate(parser.named):
        stays = False
        if held[k] and (holding[k] or 2 * held[k] > total) and not (kind == "tag" and parser.closed[k]):
            share = 0.9 if free[2] else 0.5
            stays = (held[k] > share * total and kind != "readers") or (holding[k] and held[k] >= free[0]) or (not free[1] and 2 * held[k] > total)
        if stays and not (parser.parent[k] >= 0 and gone[parser.parent[k]]):
            gone[k] = False
            free = [free[0] + text[k], free[1] + lines[k], free[2] + paged[k]]
    return gone


def extract(html: str | None, sigma: float = 1.0) -> str:
    """The main text of a page: blocks in page order, joined by two newlines."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    if parser.named:  # what an element's own end tag closed is dropped for good
        hard = []
        for k, kind in enumerate(parser.named):
            hard.append((kind == "tag" and parser.closed[k]) or (parser.parent[k] >= 0 and hard[parser.parent[k]]))
        parser.lines = [x._replace(dropped=x.dropped or (x.named >= 0 and hard[x.named])) for x in parser.lines]
    lines = parser.lines
    hot = above([x.dropped for x in lines], lines, sigma)
    if parser.named:
        gone = left_out(parser, hot)
        drop = [x.dropped or (x.named >= 0 and gone[x.named]) for x in lines]
        hot = above(drop, lines, sigma)
        lines = [x._replace(dropped=d) for x, d in zip(lines, drop, strict=True)]
    free = [i for i, x in enumerate(lines) if not x.dropped]
    # the regions' containers: the article or main element a region lies in, else the container of a hot line
    boxes = {lines[i].page or lines[i].box for i in free if hot[i]}
    kept = [i for i in free if (lines[i].page or lines[i].box) in boxes]
    # lists of links: neighbouring cold lines that are mostly links
    cold = {i for i in free if lines[i].linked and not hot[i]}
    return "\n\n".join(lines[i].text for i in kept if not (i in cold and (i - 1 in cold or i + 1 in cold)))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """The main text of every page."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in by_bytes(batch, 2):
                texts = [extract(h, sigma) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, SCHEMA)
