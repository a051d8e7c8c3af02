"""Main text of HTML pages by minimum cuts.

A page becomes a row of blocks, the text between two block boundaries, each with the elements it stands in.  A classifier
fitted on blocks whose elements say what they are (article or main, against menus, footers, asides and forms) turns the form
of a block (length, links, punctuation, place) into a cost for either label; what its elements say adds to these.
The costs are the capacities to the two terminals, neighbouring blocks and blocks that stand next to each other in an element
are joined by edges, and the minimum cut of least source side separates the main text from the rest.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Pages whose blocks the classifier is fitted on, and the longest of them (characters).
TRAIN_PAGES = 300
TRAIN_CHARS = 100_000
BATCH_BYTES = 4_000_000
#: Capacities are whole numbers: costs times this.
UNIT = 1000
#: Capacity of an edge between blocks with nothing between them; it falls with the number of elements closed and opened.
SMOOTH = 1.5
SIBLING = 0.5
#: What an element around a block adds to the log-odds of its being main text.
INSIDE_ARTICLE, INSIDE_CONTENT, OUTSIDE_ARTICLE = 6.0, 2.5, -6.0
FIT_STEPS, FIT_RATE, FIT_PRIOR = 300, 0.5, 0.01

# Elements of HTML by how they are laid out or what they hold.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNSHOWN = {"head", "script", "style", "template", "noscript", "iframe", "object", "svg", "canvas", "audio", "video", "datalist", "title", "noembed", "noframes"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "menu", "dialog", "fieldset", "label", "legend"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "tfoot", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_P = BLOCK - {"body", "caption", "dd", "dt", "head", "html", "legend", "li", "option", "tbody", "tfoot", "thead", "tr"}
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "menu", "html", "body"}
# Words of class, id and role that tell what an element holds.
NOT_CONTENT_WORDS = set(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations sidebar sidenav widget widgets nav navbar navigation navigational menu menubar breadcrumb breadcrumbs pagination pager footer masthead "
    "comment comments commentlist disqus reply replies respond discussion search searchbox toolbar copyright legal disclaimer skip contentinfo complementary trackback outbrain taboola".split()
)
CONTENT_WORDS = set("article articlebody content entry post story main body text maincontent".split())
ARTICLE_WORDS = {"articlebody", "main", "article"}
HEADER_WORDS = {"header", "siteheader", "pageheader", "topbar"}

_TAG = re.compile(rb"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[!?/A-Za-z])[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rb"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/>\"']+)")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Element:
    __slots__ = ("tag", "up", "depth", "gone", "article", "content", "link", "unsaid")

    def __init__(self, tag: str, up: _Element | None, attributes: bytes) -> None:
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        names, hidden = [], False
        if attributes and (b"=" in attributes or b"hidden" in attributes):
            said: dict[bytes, str] = {}
            for m in _ATTRIBUTE.finditer(attributes):
                said.setdefault((m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or b"").decode("utf-8", "replace"))
            names = [x for k in (b"class", b"id", b"role", b"itemprop") if k in said for x in said[k].split()]
            hidden = b"hidden" in said or said.get(b"aria-hidden") == "true" or bool(_HIDDEN.search(said.get(b"style", "")))
        article, content, boiler = tag in ("article", "main"), False, tag in BOILERPLATE
        inside = bool(up and up.article)
        for name in names:
            words = [x.lower() for x in _NAME_WORD.findall(name)] or [""]
            whole = "".join(words)
            article |= whole in ARTICLE_WORDS and tag != "body"
            content |= not CONTENT_WORDS.isdisjoint(words)
            boiler |= whole in NOT_CONTENT_WORDS or words[0] in NOT_CONTENT_WORDS or words[-1] in NOT_CONTENT_WORDS and tag not in ("article", "main") or whole in HEADER_WORDS and not inside
        boiler = (boiler and tag not in ("html", "body", "main")) or tag == "header" and not inside
        self.gone = (up.gone if up else False) or hidden or tag in UNSHOWN or boiler
        self.article = (inside or article) and not self.gone
        self.content = (up.content if up else False) or content
        self.link = (up.link if up else False) or tag == "a"
        self.unsaid = tag not in BLOCK and up is not None and (up.unsaid or self.gone and not up.gone)


class Block:
    """Text between two block boundaries: text, letters of it in links, the element it stands in, how far the block before it is in the tree."""

    __slots__ = ("text", "link_chars", "element", "apart")

    def __init__(self, text: str, link_chars: int, element: _Element, apart: int) -> None:
        self.text, self.link_chars, self.element, self.apart = text, link_chars, element, apart


def blocks(page: bytes) -> list[Block]:
    """The blocks of a page (UTF-8) in order; what is never shown is left out, the rest is kept with its elements."""
    root = here = _Element("#root", None, b"")
    found: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    opened: dict[str, int] = {}  # elements of each name that are open
    apart = 0

    def flush(at: _Element) -> None:
        nonlocal pieces, apart
        if pieces:
            text = " ".join("".join([p for p, _ in pieces]).split())
            if text:
                found.append(Block(text, sum(len(p) for p, link in pieces if link), at, apart))
                apart = 0
            pieces = []

    def block_of(e: _Element) -> _Element:
        while e.up is not None and e.tag not in BLOCK:
            e = e.up
        return e

    def close(upto: _Element) -> None:
        """Closes all elements below ``upto``."""
        nonlocal here, apart
        while here is not upto:
            if here.tag in BLOCK:
                flush(here)
                apart += 1
            opened[here.tag] -= 1
            here = here.up

    def say(raw: bytes) -> None:
        if raw and not (here.unsaid or here.tag in UNSHOWN):
            pieces.append((unescape(raw.decode("utf-8", "replace")), here.link))

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower().decode("utf-8", "replace")
        if m[1]:
            e = here if opened.get(tag) else root
            while e is not root and e.tag != tag:
                if e.tag in SCOPES and tag in ("li", "dd", "dt", "tr", "td", "th", "p", "option"):
                    e = root
                    break
                e = e.up
            if e is not root:
                close(e.up)
            elif tag == "p":
                flush(block_of(here))
            continue
        if tag in ENDS_P or tag in ENDS_SAME:
            wanted = {"p"} if tag in ENDS_P else ENDS_SAME[tag]
            e = here
            while e is not root and e.tag not in wanted and e.tag not in SCOPES and (tag not in ENDS_P or e.tag not in BLOCK):
                e = e.up
            if e is not root and e.tag in wanted:
                close(e.up)
        if tag in BLOCK:
            flush(block_of(here))
            apart += 1
        elif tag in ("br", "td", "th"):
            pieces.append((" ", False))
        if tag in VOID:
            continue
        element = _Element(tag, here, m[3])
        if tag in RAW:
            end = re.compile(rb"</" + tag.encode() + rb"(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        here = element
        opened[tag] = opened.get(tag, 0) + 1
    close(root)
    flush(root)
    return found


def features(found: list[Block]) -> np.ndarray:
    """Form of each block and of its neighbours: 1, length, share in links, punctuation, sentence end, heading, list or table, place."""
    n = len(found)
    out = np.zeros((n, 11))
    for i, b in enumerate(found):
        size = len(b.text)
        out[i, :7] = (
            1, np.log1p(size) / 5, min(1.0, b.link_chars / size), min(1.0, 20 * sum(b.text.count(c) for c in ".,;:!?") / size), b.text[-1] in ".!?:\"'”»",
            b.element.tag in HEADINGS, b.element.tag in ("li", "tr", "dt", "dd", "caption"),
        )
    if n:
        out[:, 7] = np.arange(n) / n
        out[1:, 8], out[:-1, 9] = out[:-1, 1], out[1:, 1]
        out[:, 10] = np.log1p(n) / 5
    return out


def said(b: Block) -> int | None:
    """What a block's elements say it is: 1 main text, 0 not, None nothing."""
    return 0 if b.element.gone else 1 if b.element.article else None


def fit(x: np.ndarray, y: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Weights of a logistic regression, both classes counted alike, drawn to ``PRIOR`` where the blocks say nothing."""
    w = PRIOR.copy()
    if not len(x) or y.min() == y.max():
        return w
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= FIT_RATE * (x.T @ (weight * (p - y)) + FIT_PRIOR * (w - PRIOR))
    return w


#: Where fitting starts, and what it returns if no element of the sample says anything: long blocks with punctuation and few links are main text.
PRIOR = np.array([-2.5, 3.0, -4.0, 1.0, 0.5, 0.5, -1.0, 0.0, 0.5, 0.5, 0.0])


class Flow:
    """Maximum flow from ``source`` to ``sink`` by blocking flows (level graphs); capacities are whole numbers."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def join(self, a: int, b: int, there: int, back: int) -> None:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [there, back]

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                if self.left[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """After the maximum flow: the nodes that the source still reaches, the least source side of all minimum cuts."""
        while (level := self._levels(source))[sink] >= 0:
            following = [0] * len(self.edges)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    most = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= most
                        self.left[e ^ 1] += most
                    cut = next(i for i, e in enumerate(path) if not self.left[e])
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.edges[a]
                while following[a] < len(edges) and not (self.left[edges[following[a]]] and level[self.to[edges[following[a]]]] == level[a] + 1):
                    following[a] += 1
                if following[a] < len(edges):
                    path.append(edges[following[a]])
                    a = self.to[path[-1]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    following[a] += 1
                else:
                    break
        return [x >= 0 for x in level]


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source side of the minimum cut with the least source side.

    gain: what a node adds if it is there (negative: costs); edges: (a, b, cost if they are on different sides).  Nodes whose
    gain or cost is above that of all their edges are settled at once, and what is left falls into parts; each is a flow by itself.
    """
    n = len(gain)
    around = [0] * n
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        around[a] += c
        around[b] += c
        near[a].append((b, c))
        near[b].append((a, c))
    side: list[bool | None] = [None] * n
    now = list(gain)
    todo = [i for i in range(n) if abs(gain[i]) > around[i]]
    while todo:
        i = todo.pop()
        if side[i] is not None:
            continue
        side[i] = now[i] > 0
        for j, c in near[i]:
            if side[j] is None:
                now[j] += c if side[i] else -c
                around[j] -= c
                if abs(now[j]) > around[j]:
                    todo.append(j)
    for i in range(n):
        if side[i] is not None:
            continue
        part, at = [i], {i: 0}
        for j in part:
            for k, _ in near[j]:
                if side[k] is None and k not in at:
                    at[k] = len(part)
                    part.append(k)
        flow = Flow(len(part) + 2)
        source, sink = len(part), len(part) + 1
        for j in part:
            if now[j] > 0:
                flow.join(source, at[j], now[j], 0)
            elif now[j] < 0:
                flow.join(at[j], sink, -now[j], 0)
            for k, c in near[j]:
                if k > j and k in at:
                    flow.join(at[j], at[k], c, c)
        for j, reached in zip(part, flow.source_side(source, sink)):
            side[j] = reached
    return [bool(x) for x in side]


def main_blocks(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are the main text."""
    odds = np.clip(features(found) @ weights, -8, 8) if found else np.zeros(0)
    has_article = any(said(b) == 1 for b in found)
    gain: list[int] = []
    never = UNIT * 1000 * (len(found) + 1)
    for b, x in zip(found, odds.tolist()):
        e = b.element
        if e.gone:
            gain.append(-never)
        else:
            x += INSIDE_ARTICLE if e.article else OUTSIDE_ARTICLE if has_article else INSIDE_CONTENT if e.content else 0
            gain.append(round(UNIT * x))
    edges = [(i - 1, i, round(UNIT * SMOOTH / (1 + found[i].apart))) for i in range(1, len(found)) if not (found[i].element.gone or found[i - 1].element.gone)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if not b.element.gone:
            up = id(b.element.up)
            if up in last and last[up] < i - 1:
                edges.append((last[up], i, round(UNIT * SIBLING)))
            last[up] = i
    return minimum_cut(gain, edges)


def main_text(page: bytes, weights: np.ndarray) -> str:
    """The blocks of the main text, joined by two line feeds."""
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, main_blocks(found, weights)) if keep)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def train(pages: DataFrame, most_pages: int = TRAIN_PAGES, most_chars: int = TRAIN_CHARS) -> np.ndarray:
    """Weights of the classifier, fitted on the blocks of at most ``most_pages`` pages of at most ``most_chars`` characters.

    The pages are those of least hash of url and page_id, so the same for the same table; their elements are the labels, and
    no feature knows of these elements.
    """
    html = F.col("html").cast("string")
    picked = (
        pages.where(F.length(html) <= most_chars).select(F.xxhash64("url", "page_id").alias("h"), html.alias("html"))
        .orderBy("h", "html").limit(most_pages).select("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in _bytes(batch.column(0)):
                found = blocks(page)
                labels = [said(b) for b in found]
                at = [i for i, y in enumerate(labels) if y is not None]
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array(features(found)[at].tolist(), pa.list_(pa.float64())), pa.array([labels[i] for i in at], pa.int32())], ["x", "y"])

    rows = picked.mapInArrow(run, "x array<double>, y int").toPandas()
    if rows.empty:
        return PRIOR.copy()
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy(np.float64)
    order = np.lexsort(np.c_[x, y].T)  # sums do not depend on the order of rows
    return fit(x[order], y[order])


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``; other columns do not matter.

    Null or empty pages, and pages without main text, have the empty text; page_id and url may be null; repeated rows are
    judged alike.  ``weights``: of ``train`` (if None, fitted on these pages).
    """
    weights = train(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES, 2):
            texts = [main_text(page, weights) for page in _bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    taken = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return taken.mapInArrow(run, "page_id long, url string, text string, n_chars long")
