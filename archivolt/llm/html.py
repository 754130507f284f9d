"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser streams events; block elements end a line, and a line knows its characters, those of links,
its tags and the innermost container it stands in. A line's ratio is its characters outside links over its tags; the ratios
are smoothed over neighbouring lines with a Gaussian in which a line has a weight: nothing for lines in elements that mark
themselves as something else (menus, adverts, forms, ...), which neither give nor get any. Lines at or above the threshold,
the lesser of mean and standard deviation, form clusters. The content region is the innermost container that still holds
nearly all of the clusters' ratios; its lines with a smoothed ratio above 0 stay, and those that are only links if they stand
in a cluster. Where no container but the body holds the clusters, only the clusters' lines stay.

Edge cases: a null or empty page, and one without text, give ''; end tags that HTML lets out are supplied, and cut-off
markup is read as far as it goes; where all lines mark themselves, the marks do not count; a page with no tags is its own
text; equal ratios are all in or all out of a cluster; repeated pages are answered alike; an empty table gives an empty
result; very long pages are read whole; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import portions

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
MUTE = frozenset("script style template".split())
CONTAINER = frozenset("html body div section article main td table tbody tr center form".split())
MARKING = frozenset("nav footer aside form noscript iframe object svg canvas button select textarea input option head title menu dialog audio video math datalist map".split())
LEFT_OPEN = frozenset("nav footer header form".split())
# Elements whose end tag may be missing: what else opens ends them, up to the element that holds them.
ENDS_P = BLOCK - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
ENDED_BY = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "thead", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), "option": frozenset({"option", "optgroup"})}
HOLDERS = frozenset("ul ol menu dl table select body html article main section div aside nav footer header form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog note status".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments discussion disqus replies reply respond widget toolbar pagination pager skip".split())
PLAIN = frozenset("area article bar block body bottom box button buttons by card col column container content entry group icon icons inner item items left line link links list main media order outer page panel part post posts reader readers right row section site slot small text thread title top unit user users wrap wrapper".split())
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _marked_name(name: str) -> bool:
    """Whether most words of a class or id, but for words that say nothing, are marks."""
    said = [w for w in _WORDS.findall(name) if w not in PLAIN]
    return 2 * sum(w in MARKS for w in said) > len(said)


def _marks_itself(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether an element marks itself as other than main text. inside: it stands in an article or main element."""
    if tag in MARKING or (tag == "header" and not inside):
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id") and any(map(_marked_name, value.split())):
            return True
        if (name == "role" and value.strip() in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, characters in links, tags, marked, container) per line, and each container's tag and parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Open elements: tag, whether a mark of its own applies, and marked, container, named and links before it.
        self.stack: list[tuple[str, bool, bool, int, bool, int]] = []
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.containers: list[tuple[str, int]] = [("", 0)]
        self.text: list[str] = []
        self.tags, self.linked, self.marked, self.at, self.named, self.links, self.mute = 0, 0, False, 0, False, 0, 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.linked, self.tags, self.marked, self.at))
            self.tags = 0
        self.text, self.linked = [], 0

    def _end(self, i: int) -> None:
        """Ends the open element i and those in it."""
        if any(x[0] in BLOCK or x[1] for x in self.stack[i:]):
            self.flush()
        self.mute -= sum(x[0] in MUTE for x in self.stack[i:])
        _, _, self.marked, self.at, self.named, self.links = self.stack[i]
        del self.stack[i:]

    def _supply_ends(self, tag: str) -> None:
        ended = ENDED_BY.get(tag, frozenset())
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in ended or (name == "p" and tag in ENDS_P):
                self._end(i)
            elif name in HOLDERS:
                break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P or tag in ENDED_BY:
            self._supply_ends(tag)
        if tag in ("article", "main") and self.marked:  # no menu or footer holds an article: it was left open
            own = [x[0] for x in self.stack if x[1]]
            if LEFT_OPEN.issuperset(own):
                self.flush()
                self.marked = False
        mark = not self.marked and _marks_itself(tag, attrs, self.named)
        if tag in BLOCK or mark:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        self.stack.append((tag, mark, self.marked, self.at, self.named, self.links))
        self.marked = self.marked or mark
        self.mute += tag in MUTE
        self.links += tag == "a"
        self.named = self.named or tag in ("article", "main") or ("role", "main") in attrs
        if tag in CONTAINER:
            self.containers.append(("main" if ("role", "main") in attrs else tag, self.at))
            self.at = len(self.containers) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._end(i)
                break

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratios: np.ndarray, weights: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing of the weighted ratios; a line gets what its own weight lets it have."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    around = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return weights * around(weights * ratios) / around(np.ones(len(ratios)))


def region(containers: list[tuple[str, int]], at: list[int], mass: np.ndarray, least: float = 0.9, named: float = 0.75) -> int:
    """The innermost container that holds at least that share of the mass of what holds it, and half of its lines."""
    text, lines = np.zeros(len(containers)), np.zeros(len(containers))
    np.add.at(text, at, mass)
    np.add.at(lines, at, mass > 0)
    inner: dict[int, list[int]] = {}
    for i in range(len(containers) - 1, 0, -1):  # what is inside comes later
        up = containers[i][1]
        text[up] += text[i]
        lines[up] += lines[i]
        inner.setdefault(up, []).append(i)
    here = 0
    while containers[here][0] not in ("article", "main"):
        best = max(inner.get(here, ()), key=lambda i: text[i], default=None)
        share = named if best is not None and containers[best][0] in ("article", "main") else least
        if best is None or not text[best] or text[best] < share * text[here] or 2 * lines[best] < lines[here]:
            break
        here = best
    return here


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, containers = parser.lines, parser.containers
    if not lines:
        return ""
    at = [x[4] for x in lines]
    size = np.array([float(len(x[0])) for x in lines])
    prose = np.maximum(size - np.array([x[1] for x in lines]), 0.0)
    weight = np.array([0.0 if x[3] else 1.0 for x in lines])
    if not weight.any():
        weight[:] = 1.0
    if not (weight * prose).any():
        prose = size
    ratio = smoothed(prose / np.maximum(1, [x[2] for x in lines]), weight)
    cluster = ratio >= (min(ratio.mean(), ratio.std()) if len(lines) > 1 else 0.0)
    top = region(containers, at, np.where(cluster, ratio, 0.0))
    held = np.zeros(len(containers), bool)
    held[top] = True
    for i in range(top + 1, len(containers)):
        held[i] = held[containers[i][1]]
    stays = held[at] & (cluster | ((ratio > 0) & (prose > 0))) if containers[top][0] not in ("", "html", "body") else cluster
    return " ".join(x[0] for x, ok in zip(lines, stays, strict=True) if ok)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches, "html"):
        text = [main_text(h) for h in b["html"].to_pylist()]
        yield pa.record_batch([b["page_id"], b["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row. Map only: no shuffle."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return source.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
