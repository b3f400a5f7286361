"""Main text of web pages by the distribution of their text over lines.

Markup is stripped into lines, one for each block of text. What elements name as something else than the article (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) counts as no text, and neither
do links. Text lengths are summed over sliding windows of WINDOW lines; text surges where a window of some weight follows
a light one and dives where windows have become light again. The heaviest stretch between a surge and its dive holds the main text.

Stretches alone lose an article's short first and last lines. So where an article's bounds are marked (by the
element, or by the name of one), the marked element that holds most of the heaviest stretch is taken, whole, without what
is named otherwise inside. Pages without such a mark give the lines between the surge and the dive, headings right above included.

Cases: null and empty pages, and those of menus alone, give an empty text; a page without markup is one line; markup
that is cut off, never closed or closed twice is read as far as it goes; rows are independent, so repeated rows and ids have
results of their own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Lines of a window; a window of so much of the page's heaviest one is heavy, and of so many characters at least.
WINDOW, SHARE, HEAVY = 3, 0.2, 40

#: Elements that start and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that hold no main text.
OTHER = frozenset("head script style noscript template textarea iframe object svg canvas nav menu footer aside form button select option dialog noembed noframes title audio video map".split())
#: Words of classes, ids and roles that say so, and those that say that readers wrote it.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription paywall signup login nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidebars aside complementary widget widgets footer copyright colophon masthead contentinfo "
    "share sharing social related recommended recommendations pagination pager search skip toolbar".split()
)
READERS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words of classes and ids that mark an article's bounds.
MARKED = frozenset("article post entry story content maincontent articlebody".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Open(NamedTuple):
    """An open element: what it holds is by readers or otherwise not main text, how much it frees of that, whether it marks an article."""

    name: str
    readers: bool
    other: bool
    freed: int
    mark: bool


class Lines:
    """A page's lines: their texts, characters outside links, whether they are headings, and the marked elements about them (by number, see `kinds`)."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.weights: list[int] = []
        self.headings: list[bool] = []
        self.marks: list[tuple[int, ...]] = []
        self.kinds: list[str] = []
        self.open: list[Open] = []
        self.count: dict[str, int] = {}
        self.other = self.readers = self.links = self.plain = 0
        self.inside: list[int] = []
        self.parts: list[str] = []
        self.heading = False
        at = 0
        while found := _TAG.search(page, at):
            self.add(page[at : found.start()])
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            if found[1] or found[4]:
                self.close(name)
                continue
            self.start(name, found[3] or found[6] or "")
            if name in RAW:
                end = _END[name].search(page, at)
                at = end.start() if end else len(page)
        self.add(page[at:])
        self.line()

    def add(self, text: str) -> None:
        if text and not self.readers and not self.other:
            self.parts.append(html.unescape(text))
            self.plain += 0 if self.links else len(text)

    def line(self) -> None:
        """Ends a line."""
        if text := " ".join("".join(self.parts).split()):
            self.texts.append(text)
            self.weights.append(min(self.plain, len(text)))
            self.headings.append(self.heading)
            self.marks.append(tuple(self.inside))
        self.parts, self.plain, self.heading = [], 0, False

    def start(self, name: str, attributes: str) -> None:
        block = name in BLOCKS or name in RAW
        if block:
            self.line()
            self.end_implied(name)
        elif name == "br":
            self.add(" ")
        if name in VOID:
            return
        self.heading = self.heading or name in ("h1", "h2")
        words = named(attributes)
        own = words & (NAMED | READERS) if name not in ("html", "body", "main") else set()
        readers = bool(own & READERS)
        marked = name in ("article", "main") or block and bool(words & MARKED)
        in_article = any(self.kinds[k] != "named" for k in self.inside)
        header = not in_article and (name == "header" or "header" in words and not marked)
        other = name in OTHER or bool(own) or header
        if not (block or other or name == "a"):
            return
        mark = marked and not own and not self.readers
        # An article inside of something named otherwise, as when an advert is never closed, is main text again.
        freed = self.other if mark and name in ("article", "main") and not in_article else 0
        self.open.append(Open(name, readers, other and not readers, freed, mark))
        self.count[name] = self.count.get(name, 0) + 1
        self.readers += readers
        self.other += (other and not readers) - freed
        self.links += name == "a"
        if mark:
            self.kinds.append(name if name in ("article", "main") else "named")
            self.inside.append(len(self.kinds) - 1)

    def end_implied(self, name: str) -> None:
        """Ends what the start of a block ends: a paragraph, the item before, the head."""
        k = len(self.open)
        while k and self.open[k - 1].name not in BLOCKS:
            k -= 1
        if k and self.open[k - 1].name == "p":
            while self.pop() != "p":
                pass
        for same in (("li",), ("dd", "dt"), ("td", "th"), ("tr",), ("option",)):
            if name in same and self.open and self.open[-1].name in same:
                self.pop()
        if name == "body" and self.count.get("head"):
            while self.pop() != "head":
                pass

    def close(self, name: str) -> None:
        if name in BLOCKS or name in RAW:
            self.line()
        if not self.count.get(name):
            return
        if name not in BLOCKS:  # does not reach out of its line's block
            k = len(self.open) - 1
            while self.open[k].name != name:
                if self.open[k].name in BLOCKS:
                    return
                k -= 1
        while self.pop() != name:
            pass

    def pop(self) -> str:
        e = self.open.pop()
        self.count[e.name] -= 1
        self.readers -= e.readers
        self.other -= e.other - e.freed
        self.links -= e.name == "a"
        if e.mark:
            self.inside.pop()
        return e.name


def named(attributes: str) -> set[str]:
    """Words of the names in class, id and role, up to one that tells what else there is (main-with-sidebar)."""
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for name in html.unescape(m[2] or m[3] or m[4] or "").split():
            for word in _WORD.findall(_CAMEL.sub(" ", name).lower()):
                if word in ("has", "with", "no", "is", "without", "not"):
                    break
                found.add(word)
    return found


def stretches(weights: np.ndarray) -> list[tuple[int, int]]:
    """Lines between each surge and its dive."""
    if not len(weights):
        return []
    total = np.concatenate([[0], np.cumsum(weights)])
    sums = total[np.minimum(np.arange(len(weights)) + WINDOW, len(weights))] - total[:-1]
    heavy = sums >= max(1, min(HEAVY, int(sums.max())), SHARE * sums.max())
    edge = np.flatnonzero(np.diff(np.concatenate([[0], heavy.astype(np.int8), [0]])))
    out = []
    for a, b in edge.reshape(-1, 2).tolist():
        b = min(len(weights), b + WINDOW - 1)
        while a < b and not weights[a]:  # the window reached the text before its lines did
            a += 1
        while b > a and not weights[b - 1]:
            b -= 1
        out.append((max(a, out[-1][1] if out else 0), b))
    return [(a, b) for a, b in out if a < b]


def main_text(page: str | None) -> str:
    """The main text's lines, joined by line breaks."""
    if not page:
        return ""
    lines = Lines(page)
    weights = np.array(lines.weights, np.int64)
    found = stretches(weights)
    if not found:
        # No text but links; an article of links alone is what its page has.
        kept = [t for t, m in zip(lines.texts, lines.marks, strict=True) if any(lines.kinds[k] == "article" for k in m)]
        return "\n".join(kept)
    total = np.concatenate([[0], np.cumsum(weights)])
    a, b = max(found, key=lambda x: (total[x[1]] - total[x[0]], -x[0]))
    held: dict[int, int] = {}
    for i in range(a, b):
        for k in lines.marks[i]:
            held[k] = held.get(k, 0) + int(weights[i])
    for kind in ("article", "main", "named"):
        own = {k: n for k, n in held.items() if lines.kinds[k] == kind and 2 * n >= total[b] - total[a]}
        if own:  # the outermost of those that hold as much: elements are numbered as they start
            most = max(own.values())
            chosen = min(k for k, n in own.items() if n == most)
            return "\n".join(t for t, m in zip(lines.texts, lines.marks, strict=True) if chosen in m)
    while a and lines.headings[a - 1]:
        a -= 1
    return "\n".join(lines.texts[a:b])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["page_id", "url", "text"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(step, f"page_id {kinds['page_id']}, url {kinds['url']}, text string").withColumn("n_chars", F.length("text").cast("long"))
