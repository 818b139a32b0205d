"""HTML extraction (10): parser events, text-to-tag ratios of lines, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, text_batches, unused

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split())
_DROPPED = frozenset("head script style noscript template iframe object svg canvas audio video nav footer aside form button select option textarea input dialog menu".split())
_ENDS_P = _BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: Tags that close an open one of these tags, unless one of the others is open inside it.
_ENDS_LIKE = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "option": (("option",), ("select",))}
_NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar rail aside masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies reactions share sharing social related recommended recommendations widget pagination pager skip footer copyright banner".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())


class _Lines(HTMLParser):
    """Block lines of a page: text, tags met in it, characters in links, and the open element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.dropped, self.noise = [-1], ["#root"], [False], [False]
        self.open = [0]
        self.at: dict[str, list[int]] = {}  # where in ``open`` elements of each tag are
        self.text: list[tuple[str, int, bool]] = []
        self.tags = self.in_link = 0
        self.raw: list[tuple[list[tuple[str, int, bool]], int, int]] = []
        self.lines: list[tuple[str, int, int, int]] = []

    def _line(self) -> None:
        if self.text:
            self.raw.append((self.text, self.tags, self.open[-1]))
            self.text = []
        self.tags = 0

    def _inside(self) -> bool:
        return bool(self.at.get("article") or self.at.get("main"))

    def _last(self, tags: tuple[str, ...]) -> int:
        """Where the innermost open element of one of these tags is; -1 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _noise(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in _DROPPED or tag == "header" and not self._inside():
            return True
        a = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "") or a.get("role") in _NOISE_ROLES:
            return True
        return False

    def _named(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether a whole class name or id says that the element is no content."""
        if tag in ("html", "body", "main"):
            return False
        names = set(" ".join(v or "" for k, v in attrs if k in ("class", "id")).lower().split())
        return bool(names & _NOISE) or "header" in names and not self._inside()

    def _pop_to(self, at: int) -> None:
        for i in self.open[at:]:
            self.in_link -= self.tag[i] == "a"
            self.at[self.tag[i]].pop()
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self._line()
        self.tags += 1
        if tag in _ENDS_P and (at := self._last(("p",))) > 0:
            self._pop_to(at)
        elif tag in _ENDS_LIKE:
            alike, scope = _ENDS_LIKE[tag]
            if (at := self._last(alike)) > self._last(scope):
                self._pop_to(at)
        if tag in _VOID:
            return
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.dropped.append(self.dropped[self.open[-1]] or self._noise(tag, attrs))
        self.noise.append(self._named(tag, attrs))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.tag) - 1)
        self.in_link += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._line()
        self.tags += 1
        if (at := self._last((tag,))) > 0:
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if not self.dropped[self.open[-1]]:
            self.text.append((data, self.open[-1], self.in_link > 0))

    def close(self) -> None:
        super().close()
        self._line()
        self._drop_named()
        for pieces, tags, node in self.raw:
            left = [(data, linked) for data, at, linked in pieces if not self.dropped[at]]
            if text := " ".join("".join(data for data, _ in left).split()):
                self.lines.append((text, tags, sum(len(data) for data, linked in left if linked), node))

    def _drop_named(self) -> None:
        """Elements named as no content go, unless they wrap the page's main or h1, or all of its articles and half of its text."""
        if not any(self.noise):
            return
        n = len(self.tag)
        heads = [int(t in ("main", "h1") and not d) for t, d in zip(self.tag, self.dropped, strict=True)]
        articles = [int(t == "article" and not d) for t, d in zip(self.tag, self.dropped, strict=True)]
        chars = [0] * n
        for pieces, _, _ in self.raw:
            for data, node, linked in pieces:
                chars[node] += 0 if linked else len(data.strip())
        for i in range(n - 1, 0, -1):
            for x in (heads, articles, chars):
                x[self.parent[i]] += x[i]
        for i in range(1, n):
            wraps = heads[i] or articles[i] and articles[i] == articles[0] and chars[i] * 2 >= chars[0]
            own = self.tag[i] in ("article", "h1")
            self.dropped[i] = self.dropped[i] or self.dropped[self.parent[i]] or self.noise[i] and (own or not wraps)


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with a normalised kernel of radius ``ceil(3 sigma)``."""
    r = math.ceil(3 * sigma)
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(np.pad(x, r, mode="edge"), kernel / kernel.sum(), mode="valid")


def extract_text(html: str | None, sigma: float = 1.0, strength: float = 0.5, share: float = 0.7) -> str:
    """Main text of a page; empty for null, empty and text-free pages.

    Events of the standard parser cut the page into lines at block tags; menus, forms, scripts
    and other parts marked as no content give none. A line's ratio is its unlinked characters
    over its tags. Lines whose smoothed ratio reaches ``strength`` standard deviations form the
    content cluster. A line of it weighs its characters, twice those in an article or main, and
    the region is the deepest element that holds ``share`` of the weight. Where that is in an
    article, or articles hold ``share`` of it, the region is the articles side by side there that
    hold lines of the cluster, each whole; where it is in a main, the whole main. Elsewhere
    lines outside the cluster count only as headings, in articles with lines of the cluster or,
    if not mostly links, between two lines of the cluster.
    """
    page = _Lines()
    page.feed(html or "")
    page.close()
    lines = page.lines
    if not lines:
        return ""
    ratio = smooth(np.array([(len(t) - linked) / max(1, tags) for t, tags, linked, _ in lines], dtype=float), sigma)
    chosen = ratio >= strength * ratio.std()
    if not chosen.any():
        chosen[:] = True
    n = len(page.tag)
    article, main, kids = [-1] * n, [-1] * n, [[] for _ in range(n)]  # the outermost ones around each element
    for i in range(1, n):
        up = page.parent[i]
        kids[up].append(i)
        for around, tag in ((article, "article"), (main, "main")):
            around[i] = around[up] if around[up] >= 0 else i if page.tag[i] == tag and not page.dropped[i] else -1
    weight = [0] * n
    for (text, _, _, node), yes in zip(lines, chosen, strict=True):
        weight[node] += len(text) * (1 + (article[node] >= 0 or main[node] >= 0)) if yes else 0
    for i in range(n - 1, 0, -1):
        weight[page.parent[i]] += weight[i]
    top = 0
    while heavy := [i for i in kids[top] if weight[i] >= share * weight[0]]:
        top = heavy[0]
    within = [False] * n
    for i in range(n):
        within[i] = i == top or i > 0 and within[page.parent[i]]
    found = {i for i in range(n) if article[i] == i and weight[i]}
    if article[top] >= 0:
        beside = page.parent[article[top]]
        return " ".join(t for t, _, _, node in lines if article[node] in found and page.parent[article[node]] == beside)
    if sum(weight[i] for i in found if within[i]) >= share * weight[top]:
        return " ".join(t for t, _, _, node in lines if article[node] in found and within[node])
    if main[top] >= 0:
        return " ".join(t for t, _, _, node in lines if main[node] == main[top])
    if page.tag[top] == "p":
        top = page.parent[top]
        for i in range(n):
            within[i] = i == top or i > 0 and within[page.parent[i]]
    hit = [i for i, yes in enumerate(chosen) if yes and within[lines[i][3]]]
    out = []
    for i, (text, _, linked, node) in enumerate(lines):
        if within[node] and (chosen[i] or article[node] in found or page.tag[node] in ("h1", "h2", "h3", "h4", "h5", "h6") or hit and hit[0] < i < hit[-1] and linked * 2 < len(text)):
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each in ``out`` in place of ``html_col``; other columns stay, and rows are independent.

    Null, empty and text-free pages have an empty text; ``out`` replaces a column of that name;
    repeated rows stay repeated; an empty table gives no rows. Time grows with the page's length alone.
    """
    text_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_col, out)]
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField(out, T.StringType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([extract_text(h.as_py()) for h in batch.column(len(keep))], type=pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), text], names=[*keep, out])

    return pages.select(*keep, F.col(html_col).cast("string").alias(unused(keep, "__html"))).mapInArrow(run, schema)
