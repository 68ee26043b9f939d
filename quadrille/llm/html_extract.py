"""Main text of HTML pages by minimum-cut labelling.

A page becomes a sequence of blocks, the texts between block-level tags, each with its
place in the DOM. A logistic classifier over a block's features (tags above it, words of
classes and ids, length, links, punctuation, neighbours) gives the odds that it is content;
its logarithm, bounded, is the capacity of the block's edge to the source or the sink.
Neighbouring blocks, and blocks with one parent or grandparent, are joined by smoothness
edges whose capacity falls with their distance in the DOM. A maximum flow then separates
content from boilerplate: the blocks still reachable from the source are the article.

The classifier is trained here, on pages that ``html_training`` makes from a seed in many
layouts with known labels; no page of the input takes part, so a page's text depends on
nothing but the page. No single feature decides: classes that say something of the page or
its topic (``has-sidebar``, ``tag-news``) are left out, and a word like "comments" inside a
longer name counts little, and nothing where the part holds most of the page.

Scripts, styles, titles, form controls and other parts without running text are never
blocks. Text of blocks is decoded (character references), white space inside a block
becomes one blank, blocks are joined in page order by one blank. Defined results: a null or
empty page, and a page without content blocks, give the empty text. Broken markup is read
as far as it goes: an unclosed tag ends with its parent, a cut tag at the end is dropped.
Repeated rows and repeated page ids give a row each; other columns of the pages are left
behind, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import claim, emit, rows
from .html_training import labelled_pages

_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br caption search".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_SKIP = frozenset("script style textarea title xmp iframe noembed noframes noscript template head button select option svg math canvas object audio video map datalist".split())
#: What may stand in a head; any other start tag ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes object".split())
#: Elements that a tag does not leave by itself, but for a head.
_HOLDS = frozenset("head template noscript svg math object".split())
_CLOSES_P = _BLOCK - {"br", "body", "html"}
_BAD_TAG = frozenset("nav footer aside header menu dialog search".split())
_GOOD_TAG = frozenset("article main".split())
_BAD = r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|foot\w*|header|masthead|side-?bar|side|cookies?|consent|notice|popup|modal|newsletter|subscri\w*|share|sharing|social|related|recommend\w*|comments?|disqus|repl(?:y|ies)|breadcrumbs?|pager|pagination|toolbar|widgets?|login|signup|legal|copyright)"
_GOOD = r"(?:article|content|main|post|entry|story|body|text)"
_BAD_NAME, _GOOD_NAME = re.compile(f"{_BAD}\\Z"), re.compile(f"{_GOOD}\\Z")
_BAD_PART, _GOOD_PART = re.compile(f"(?:^|[-_]){_BAD}(?:$|[-_0-9])"), re.compile(f"(?:^|[-_]){_GOOD}(?:$|[-_0-9])")
#: Names that tell a state or a topic, not what a part is.
_STATE = re.compile(r"(?:no|has|with|without|is|not|tag|category|cat|format|type|page|theme|layout)[-_]")
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>)", re.S)
_CUT = re.compile(r"<(?:/?[a-zA-Z!?][^<>]*)?\Z", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: _Node, linked: float):
        self.text, self.node, self.linked = text, node, linked


class _Node:
    """An element. ``own`` are the marks of its tag and attributes: g and b (tags or roles of
    articles and of boilerplate), h (header), f (form), G and B (names of classes and ids), l
    and w (parts of such names, good and bad)."""

    __slots__ = ("tag", "parent", "own", "skip", "depth", "link", "chars", "marks", "holds")

    def __init__(self, tag: str, parent: _Node | None, attrs: str = ""):
        self.tag, self.parent, self.chars = tag, parent, 0
        self.depth = parent.depth + 1 if parent else 0
        own = {"g"} if tag in _GOOD_TAG else {"h"} if tag == "header" else {"b"} if tag in _BAD_TAG else {"f"} if tag == "form" else set()
        skip = tag in _SKIP
        names: list[str] = []
        for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
            value, name = a or b or c, name.lower()
            if name in ("class", "id") and tag not in ("html", "body"):  # these say something of the page
                names += [x for x in value.lower().split() if not _STATE.match(x)]
            elif name == "role":
                own |= {"b"} if value.lower() in _ROLES else {"g"} if value.lower() in ("main", "article") else set()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
                skip = True
        good, bad = any(map(_GOOD_NAME.match, names)), any(map(_BAD_NAME.match, names))
        if bad and not good and tag not in _GOOD_TAG:
            own.add("B")
        elif good and not bad:
            own.add("G")
        elif bad or any(map(_BAD_PART.search, names)) and not any(map(_GOOD_PART.search, names)):
            own.add("w")
        elif any(map(_GOOD_PART.search, names)):
            own.add("l")
        self.own = own
        self.holds = self if tag in _HOLDS else parent.holds if parent is not None else None
        self.skip = skip or (parent is not None and parent.skip)
        self.link = tag == "a" or (parent is not None and parent.link)


def _mark(nodes: list[_Node]) -> None:
    """What the elements above a block say together. Inner marks outweigh outer ones: a good
    mark ends with a bad one below it. Forms, and bad parts of names, that hold most of the
    page's text say nothing; bad names that do are marks of their own (D)."""
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.chars += n.chars
    most = nodes[0].chars / 2
    for n in nodes:
        up = n.parent.marks if n.parent is not None else frozenset()
        own = n.own
        if not own:
            n.marks = up
            continue
        own = set(own)
        if n.chars > most:
            own -= {"f", "w"}
            if "B" in own:
                own = own - {"B"} | {"D"}
        if "h" in own and ("g" in up or "G" in up):
            own.discard("h")  # the head of an article, not of the page
        marks = set(up)
        if own & {"b", "B", "h", "f"}:
            marks -= {"g", "G", "l"}
        if own & {"g", "G"}:
            marks -= {"w"}
        n.marks = frozenset(marks | own)


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page with their places in the DOM."""
    html = html or ""
    found: list[Block] = []
    here = _Node("#root", None)
    nodes = [here]
    parts: list[str] = []
    linked = [0, 0]

    def text(s: str) -> None:
        if s and not here.skip:
            s = unescape(s)
            parts.append(s)
            linked[0] += len(s) * here.link
            linked[1] += len(s)

    def flush() -> None:
        if parts:
            s = _SPACE.sub(" ", "".join(parts)).strip()
            if s:
                node = here
                while node.parent is not None and node.tag not in _BLOCK:
                    node = node.parent
                node.chars += len(s)
                found.append(Block(s, node, linked[0] / max(linked[1], 1)))
            parts.clear()
            linked[:] = [0, 0]

    at, end = 0, len(html)
    if cut := _CUT.search(html, max(0, html.rfind("<"))):
        end = cut.start()
    while at < end:
        m = _TAG.search(html, at, end)
        if not m:
            text(html[at:end])
            break
        text(html[at : m.start()])
        at = m.end()
        if not (tag := m[2] and m[2].lower()):
            continue
        if m[1]:  # an end tag closes up to the nearest open tag of its name
            node = here
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                if tag in _BLOCK:
                    flush()
                here = node.parent
            continue
        if tag in _BLOCK:
            flush()
        if tag not in _IN_HEAD:  # the end tag of head may be left out
            if here.holds is not None and here.holds.tag == "head":
                here = here.holds.parent
        if tag in _VOID:
            continue
        if tag in _CLOSES_P or tag == "li":  # implied end tags
            node, stop = here, ("ul", "ol", "menu", "table", "td", "th", "div", "article", "section", "body", "blockquote", "main", "aside", "nav")
            while node.parent is not None and node.tag not in stop and node.tag != ("li" if tag == "li" else "p"):
                node = node.parent
            if node.parent is not None and node.tag == ("li" if tag == "li" else "p"):
                here = node.parent
        here = _Node(tag, here, m[3])
        nodes.append(here)
        if m[4] and tag not in _BLOCK:
            here = here.parent
        elif tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = close.end() if close else end
            here = here.parent
    flush()
    _mark(nodes)
    return found


_CUES = re.compile(r"cookies?\b|consent|subscribe|newsletter|sign (?:up|in)|log ?in|advert|sponsored|share (?:this|on)|follow us|privacy policy|terms of", re.I)
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_ENDS = tuple(".!?…。！？\"”»")
FEATURES = "bias article_tag bad_tag header form good_name good_part bad_name wide_bad_name bad_part outside linked all_linked log_words ten_words twenty_words forty_words held_by_parent ends p heading item cell rights cue before after linked_before linked_after unmarked page_linked".split()


_OWN_BAD = frozenset("bhfBw")


def features(found: list[Block]) -> np.ndarray:
    """One row for each block, in the order of ``FEATURES``."""
    n = len(found)
    words = np.array([len(b.text.split()) for b in found], float)
    links = np.array([b.linked for b in found])
    size = np.minimum(np.log1p(words), 5)
    shift = lambda v: (np.r_[0, v[:-1]], np.r_[v[1:], 0])
    marks = [b.node.marks for b in found]
    of = lambda c: np.array([c in m for m in marks], float)
    tag = [b.node.tag for b in found]
    is_in = lambda *names: np.array([t in names for t in tag], float)
    good, named = of("g"), of("G")
    inside = good if good.any() else named
    outside = (1 - inside) * inside.any()
    short = words < 40
    # Of the words of the page that are not links, the share of those with the same parent. A
    # part with a bad mark of its own is no child of what it stands in.
    home = [id(b.node if b.node.own & _OWN_BAD or b.node.parent is None else b.node.parent) for b in found]
    held: dict[int, float] = defaultdict(float)
    for x, free in zip(home, words * (1 - links), strict=True):
        held[x] += free
    total = max(sum(held.values()), 1)
    cols = [np.ones(n), good, of("b"), of("h"), of("f"), named, of("l"), of("B"), of("D"), of("w"), outside, links, links > 0.8, size, words >= 10, words >= 20, words >= 40, [held[x] / total for x in home]]
    cols += [[b.text.endswith(_ENDS) for b in found], is_in("p", "pre", "blockquote"), is_in("h1", "h2", "h3", "h4", "h5", "h6"), is_in("li", "dd", "dt"), is_in("td", "th")]
    cols += [[bool(_RIGHTS.match(b.text)) for b in found], short * np.array([bool(s and _CUES.search(b.text)) for s, b in zip(short, found, strict=True)]), *shift(size), *shift(links)]
    cols += [np.full(n, float(not any(marks))), np.full(n, links @ words / max(words.sum(), 1))]
    return np.array(cols, float).T


#: Log odds beyond this bound say no more, and what a smoothness edge between siblings weighs.
BOUND, SMOOTH = 8.0, 1.0


def costs(found: list[Block], weights: np.ndarray) -> list[tuple[float, float]]:
    """(cost of calling it boilerplate, cost of calling it content) of each block."""
    z = np.clip(features(found) @ weights, -BOUND, BOUND)
    return [(max(x, 0.0), max(-x, 0.0)) for x in z.tolist()]


def _apart(a: _Node, b: _Node, most: int = 8) -> int:
    """Steps from one element to another in the DOM, ``most`` at most."""
    d = 0
    while a is not b and d < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def edges(found: list[Block], smooth: float = SMOOTH) -> Iterator[tuple[int, int, float]]:
    """Smoothness edges: page neighbours, and the last block before under one parent or
    grandparent. Few for each block, so the graph is as long as the page."""
    last: dict[tuple[int, int], int] = {}
    for k, b in enumerate(found):
        if k:
            yield k - 1, k, 2 * smooth / max(1, _apart(found[k - 1].node, b.node))
        up, node = 1, b.node.parent
        while up <= 2 and node is not None:
            if (j := last.get((up, id(node)))) is not None and j != k - 1:
                yield j, k, smooth / (2 * up)
            last[up, id(node)] = k
            up, node = up + 1, node.parent


def min_cut(terminal: list[tuple[float, float]], smooth: Iterable[tuple[int, int, float]]) -> list[bool]:
    """Side of each node in a minimum cut (True: source), by Dinic's maximum flow. The part
    of a node's flow that goes straight from source to sink is settled first."""
    n = len(terminal)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def edge(a, b, c, back=0.0):
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, (a, b) in enumerate(terminal):
        if a > b:
            edge(s, k, a - b)
        elif b > a:
            edge(k, t, b - a)
    for a, b, c in smooth:
        edge(a, b, c, c)
    eps = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        q = deque([s])
        while q:
            v = q.popleft()
            for e in head[v]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    q.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        nxt = [0] * (n + 2)
        while True:  # one augmenting path of the level graph after another
            path, v = [], s
            while v != t:
                while nxt[v] < len(head[v]):
                    e = head[v][nxt[v]]
                    if cap[e] > eps and level[to[e]] == level[v] + 1:
                        break
                    nxt[v] += 1
                if nxt[v] < len(head[v]):
                    path.append(head[v][nxt[v]])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    nxt[v] += 1
                else:
                    break
            if v != t:
                break
            flow = min(cap[e] for e in path)
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow


def train(pages: Iterable[tuple[str, dict[str, bool]]], l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights of the classifier by Newton's method on logistic loss, from pages and the labels
    of their blocks' texts."""
    xs, ys = [], []
    for html, label in pages:
        found = blocks(html)
        xs.append(features(found))
        ys.append([float(label[b.text]) for b in found])
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (p - y) + l2 * w)
    return w


#: Pages that the classifier is trained on.
TRAINING_PAGES = 600
_trained: dict[int, np.ndarray] = {}


def weights(pages: int = TRAINING_PAGES) -> np.ndarray:
    if pages not in _trained:
        _trained[pages] = train(labelled_pages(pages))
    return _trained[pages]


def labels(found: list[Block], w: np.ndarray, smooth: float = SMOOTH) -> list[bool]:
    return min_cut(costs(found, w), edges(found, smooth))


def extract(html: str | None, w: np.ndarray | None = None) -> str:
    found = blocks(html)
    if not found:
        return ""
    return " ".join(b.text for b, content in zip(found, labels(found, weights() if w is None else w), strict=True) if content)


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; no shuffle. The classifier, of fixed size, is
    trained on the driver."""
    w = weights()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()

        def found():
            for i, url, html in rows(batches):
                text = extract(html, w)
                yield i, url, text, len(text)

        return emit(found(), TEXTS, 500, weigh=lambda r: 2 * r[3])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
