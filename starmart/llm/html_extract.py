"""Main-text extraction by a tree-structured graphical model of the DOM.

The elements of a page that hold or group text are the nodes of a tree.  Every
node is content or not; a log-linear potential scores that from the node's own
features (tag, words of class and id, amount and punctuation of its own text, share
of links), and a potential on each edge scores the pair (parent, child).  Sum-product
message passing, upward and downward, gives each node's exact marginal; text of
nodes with a marginal of at least one half is the main text.  The weights maximise
the likelihood of labelled pages (:mod:`starmart.llm.labelled_pages`): the gradient is
the difference between observed features and those expected under the marginals
of nodes and edges.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by ``\\n`` in page order.  Scripts, styles,
templates and fields of forms are no text; formulas, drawings, buttons and what stands
in for an unsupported element are, if their nodes are content.  Inline elements do
not split a block, block elements do.

A tag ends at the first ``>`` outside a quoted value, or at the first one at all if
a quote is never closed.  A head ends with ``</head>``, or at a tag or text that
cannot stand in it.  Time is linear in the length of a page, however broken: no
quote is scanned twice in vain, and an end tag finds its start tag by the positions
kept for each name.

Defined results: a null or empty page, and one without content, gives an empty text;
broken markup is closed as far as needed (an end tag closes up to its start tag, or
nothing); text outside any element belongs to the page's root.  Every page is worked
on by itself; other columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template head title textarea select iframe datalist".split())
RAW = frozenset("script style textarea title iframe".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
FOREIGN = ("svg", "math")  # where a tag that ends in "/>" has no end tag
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img input"
    " math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot munder mover munderover semantics svg g text tspan".split())
# An opening tag of the key closes an open element of the value, looking no higher than the scope.
CLOSES = {
    **{t: ("p",) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()},
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "option": ("option",), "body": ("head",),
}
SCOPE = frozenset("html body table td th ul ol dl div section article main aside nav header footer form blockquote figure button object svg".split())
LIST_SCOPE = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)),
              "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "tbody": frozenset(("table",)), "tfoot": frozenset(("table",))}

# Stems that class and id names are made of, by what they mark.
STEMS = {
    "nav": "nav menu breadcrumb crumb toolbar topbar tabs pagination pager paging skip toc",
    "head": "header masthead banner logo branding site-title",
    "foot": "footer copyright legal colophon imprint",
    "side": "sidebar aside rail widget related recommend popular trending more-from secondary",
    "ad": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion teaser dfp",
    "note": "cookie consent notice alert popup modal newsletter subscribe overlay disclaimer gdpr toast signup",
    "talk": "comment comments reply replies respond disqus discussion thread reader",
    "share": "share social follow like twitter facebook",
    "form": "form search login contact input field",
    "meta": "byline author meta date tags tag category caption credit published",
    "text": "content article post entry story main body text prose page column wrapper container",
}
_STEM = {w: kind for kind, words in STEMS.items() for w in words.split()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_TAG_PART = re.compile(r">|=\s*+([\"'])")
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))|(\bhidden\b)")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_NO_CHAR = re.compile(r"&#[1-9][0-9]{7,};?")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?,;:。，、]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@dataclass
class Node:
    parent: int
    tag: str
    features: list[str]
    chars: int = 0
    linked: int = 0
    marks: int = 0
    label: int | None = None


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (node, text) in page order


def _attribute_features(tag: str, attributes: str) -> tuple[tuple[str, ...], int | None]:
    found, label = [f"tag={tag}"], None
    for name, a, b, c, hidden in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "aria-label"):
            kinds = {_STEM[w] for w in _NAME.findall(_CAMEL.sub("-", value).lower()) if w in _STEM}
            found += [f"name={k}" for k in kinds]
        elif hidden or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
            found.append("hidden")
        elif name == "data-label" and value in ("0", "1"):  # other values are a page's own
            label = int(value)
    return tuple(dict.fromkeys(found)), label


_common_features = functools.lru_cache(maxsize=1 << 14)(_attribute_features)


def _decode(text: str) -> str:
    """Character references decoded; a number beyond all characters is the replacement character."""
    if "&#" in text:
        text = _NO_CHAR.sub("\ufffd", _ZEROS.sub("&#", text))
    return html.unescape(text)


class _TagEnds:
    """Where tags end.  Quotes from which the page's end was reached are kept, so none is followed twice."""

    def __init__(self, text: str) -> None:
        self.text, self.last, self.dead = text, text.rfind(">"), set()
        self.quotes = {q: text.rfind(q) for q in "\"'"}

    def after(self, at: int) -> int:
        """The position of the ``>`` that ends a tag whose attributes begin at ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        opened, i = [], at
        while (m := _TAG_PART.search(self.text, i)) is not None:
            if not m[1]:
                return m.start()
            opened.append(m.end())
            if m.end() in self.dead or self.quotes[m[1]] < m.end():
                break
            i = self.text.find(m[1], m.end()) + 1
        self.dead.update(opened)
        return self.text.find(">", at)


def parse(source: str | None) -> Page:
    """The tree of a page's grouping elements, and its text blocks."""
    page = Page([Node(-1, "root", ["tag=root"])])
    stack: list[tuple[str, int]] = [("root", 0)]  # open elements and their nodes (inline ones have their parent's)
    parts: list[str] = []
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    blocks_at: list[int] = [0]  # and those of its block elements
    links = skipped = 0
    text = source or ""
    ends_of = _TagEnds(text)
    at = 0

    def top(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def push(tag: str, node: int) -> None:
        open_at.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks_at.append(len(stack))
        stack.append((tag, node))

    def flush() -> None:
        if parts:
            block = _SPACE.sub(" ", _decode("".join(parts))).strip()
            parts.clear()
            if block:
                node = page.nodes[stack[-1][1]]
                node.chars += len(block)
                node.marks += len(_SENTENCE.findall(block))
                page.blocks.append((stack[-1][1], block))

    def add(piece: str) -> None:
        if stack[-1][0] == "head" and piece.strip():
            pop(len(stack) - 1)
        if piece and not skipped:
            parts.append(piece)
            if links:
                page.nodes[stack[-1][1]].linked += len(piece.strip())

    def pop(to: int) -> None:
        nonlocal links, skipped
        if blocks_at[-1] >= to:
            flush()
        while len(stack) > to:
            tag, _ = stack.pop()
            open_at[tag].pop()
            links -= tag == "a"
            skipped -= tag in SKIPPED
        while blocks_at[-1] >= to:
            blocks_at.pop()

    while (m := _TOKEN.search(text, at)) is not None:
        tag = (m[2] or "").lower()
        end = ends_of.after(m.end()) if tag else m.end() - 1
        if end < 0:  # no tag ends from here on: the rest is text
            break
        add(text[at : m.start()])
        at = end + 1
        if not tag:
            continue
        if m[1]:
            k = top((tag,))
            if k and (tag not in INLINE or k > blocks_at[-1]):  # a stray end of an inline element does not close blocks
                pop(k)
            if tag == "p" and not skipped:
                flush()
            continue
        if tag not in IN_HEAD and (k := top(("head",))) > top(("template",)):
            pop(k)
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                add(" " if tag != "wbr" else "")
            else:
                flush()
            continue
        closed = text[end - 1] == "/"
        if closed and top(FOREIGN):
            continue
        if tag in CLOSES:
            ends, scope = CLOSES[tag], LIST_SCOPE.get(tag, SCOPE)
            while (k := top(ends)) > top(scope):
                pop(k)
                if tag not in ("tbody", "tfoot", "tr"):
                    break
        if tag in SKIPPED:
            skipped += 1
            push(tag, stack[-1][1])
            if tag in RAW:
                stop = _RAW_END[tag].search(text, at)
                at = stop.start() if stop else len(text)
            continue
        if closed and tag in FOREIGN:
            continue
        if tag == "text":  # labels of a drawing stand apart
            add(" ")
        node = stack[-1][1]
        if tag not in INLINE:
            flush()
            if not skipped:
                attributes = text[m.end() : end]
                features, label = (_common_features if len(attributes) < 512 else _attribute_features)(tag, attributes)
                page.nodes.append(Node(node, tag, list(features), label=label))
                node = len(page.nodes) - 1
        links += tag == "a"
        push(tag, node)
    add(text[at:])
    pop(1)
    flush()
    return page


def _size(n: int) -> int:
    return 0 if n == 0 else 1 if n < 25 else 2 if n < 80 else 3 if n < 250 else 4


def node_features(page: Page) -> list[list[str]]:
    """Features of each node: its own, its text's, and those of its whole subtree."""
    nodes = page.nodes
    chars, linked, marks = ([getattr(x, f) for x in nodes] for f in ("chars", "linked", "marks"))
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
    out = []
    for i, x in enumerate(nodes):
        f = ["bias", *x.features, f"own={_size(x.chars)}", f"all={_size(chars[i])}"]
        if x.chars:
            f += [f"links={min(3, 4 * x.linked // x.chars)}", f"marks={min(4, x.marks)}"]
        if chars[i]:
            f += [f"all_links={min(3, 4 * linked[i] // chars[i])}", f"dense={min(3, 100 * marks[i] // chars[i])}"]
        out.append(f)
    return out


@dataclass
class TreeModel:
    node: dict[str, float]  # weight of a feature towards content
    edge: dict[str, float]  # weight of "kind:parent label, child label"


def _edge_kind(tag: str) -> str:
    return tag if tag in ("div", "section", "article", "main", "ul", "li", "p", "table", "tr", "td") else "other"


class Forest:
    """Trees of several pages as arrays, in one numbering where parents come first."""

    def __init__(self, pages: Sequence[Page], model: TreeModel | None = None, names: tuple[dict, dict] | None = None) -> None:
        sizes = [len(p.nodes) for p in pages]
        base = np.cumsum([0, *sizes])
        self.start = base
        self.parent = np.array([-1 if x.parent < 0 else x.parent + b for p, b in zip(pages, base) for x in p.nodes], np.int64)
        self.depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                self.depth[i] = self.depth[p] + 1
        features = [f for p in pages for f in node_features(p)]
        kinds = [_edge_kind(x.tag) for p in pages for x in p.nodes]
        self.score = np.zeros((len(self.parent), 2))
        self.pair = np.zeros((len(self.parent), 2, 2))  # [child, parent's label, child's label]
        if model is not None:
            w = model.node
            self.score[:, 1] = [sum(w.get(f, 0.0) for f in fs) for fs in features]
            tables = {k: np.array([[model.edge.get(f"{k}:{a}{b}", 0.0) for b in (0, 1)] for a in (0, 1)]) for k in set(kinds)}
            if kinds:
                self.pair = np.stack([tables[k] for k in kinds])
        if names is not None:
            self.rows = np.array([i for i, fs in enumerate(features) for f in fs if f in names[0]], np.int64)
            self.cols = np.array([names[0][f] for fs in features for f in fs if f in names[0]], np.int64)
            self.kind = np.array([names[1][k] for k in kinds], np.int64)

    def marginals(self) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product: P(label) of each node, P(parent's label, label) of each edge."""
        n = len(self.parent)
        up, message = self.score.copy(), np.zeros((n, 2))
        levels = np.split(np.argsort(self.depth, kind="stable"), np.cumsum(np.bincount(self.depth))[:-1])
        for at in reversed(levels[1:]):  # children tell their parents
            joint = self.pair[at] + up[at][:, None, :]
            message[at] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            message[at] -= message[at].max(axis=1, keepdims=True)
            np.add.at(up, self.parent[at], message[at])
        belief = up.copy()
        edges = np.zeros((n, 2, 2))
        for at in levels[1:]:  # and parents their children
            rest = belief[self.parent[at]] - message[at]
            joint = rest[:, :, None] + self.pair[at] + up[at][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            belief[at] = np.logaddexp(joint[:, 0], joint[:, 1])
            edges[at] = np.exp(joint)
        belief -= belief.max(axis=1, keepdims=True)
        p = np.exp(belief)
        total = edges.sum(axis=(1, 2), keepdims=True)
        return p / p.sum(axis=1, keepdims=True), edges / np.where(total > 0, total, 1)


def train(sources: Sequence[str], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> TreeModel:
    """Weights that maximise the likelihood of pages whose elements carry ``data-label`` (inherited from the parent)."""
    pages = [parse(s) for s in sources]
    labels = []
    for p in pages:
        own: list[int] = []
        for x in p.nodes:
            own.append(x.label if x.label is not None else (own[x.parent] if x.parent >= 0 else 0))
        labels += own
    y = np.array(labels)
    names = {f: i for i, f in enumerate(sorted({f for p in pages for fs in node_features(p) for f in fs}))}
    kinds = {k: i for i, k in enumerate(sorted({_edge_kind(x.tag) for p in pages for x in p.nodes} | {"other"}))}
    trees = Forest(pages, names=(names, kinds))
    w, e = np.zeros(len(names)), np.zeros((len(kinds), 2, 2))
    child = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros_like(e)
    np.add.at(seen, (trees.kind[child], y[trees.parent[child]], y[child]), 1)
    # Adagrad on the log likelihood of a page
    ws, es = np.full(len(w), 1e-8), np.full(e.shape, 1e-8)
    for _ in range(rounds):
        trees.score[:, 1] = np.bincount(trees.rows, w[trees.cols], len(y))
        trees.pair = e[trees.kind]
        p, q = trees.marginals()
        gw = np.bincount(trees.cols, (y - p[:, 1])[trees.rows], len(w)) / len(pages) - decay * w
        expected = np.zeros_like(e)
        np.add.at(expected, trees.kind[child], q[child])
        ge = (seen - expected) / len(pages) - decay * e
        ws += gw * gw
        es += ge * ge
        w += rate * gw / np.sqrt(ws)
        e += rate * ge / np.sqrt(es)
    return TreeModel({f: float(w[i]) for f, i in names.items()}, {f"{k}:{a}{b}": float(e[i, a, b]) for k, i in kinds.items() for a in (0, 1) for b in (0, 1)})


def extract_texts(sources: Sequence[str | None], model: TreeModel) -> list[str]:
    pages = [parse(s) for s in sources]
    trees = Forest(pages, model)
    p = trees.marginals()[0][:, 1] if len(trees.parent) else np.zeros(0)
    return ["\n".join(t for node, t in page.blocks if p[start + node] >= 0.5) for page, start in zip(pages, trees.start)]


def extract(df: DataFrame, model: TreeModel, html_col: str = "html", text_col: str = "text", pages: int = 64) -> DataFrame:
    """Add ``text_col``: the main text of ``html_col``.  ``pages`` pages are worked on at once."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # one weight a feature: some kilobytes

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), pages):
                out += extract_texts(batch.slice(at, pages).to_pylist(), shared.value)
            yield pa.array(out, pa.string())

    return df.withColumn(text_col, run(F.col(html_col)))
