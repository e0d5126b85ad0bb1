"""HTML extraction: a tree-structured graphical model over a page's elements.

Each element is content or not.  Its own features (names, class words, amounts
of text and of links) give a unary potential; each parent-child edge has a 2x2
potential that depends on the child's kind.  One upward and one downward pass of
sum-product messages give exact marginals; elements at 0.5 or more are content.

The weights are those of the likelihood of labelled pages.  The pages are made
by :func:`labelled_pages`, as no table labels pages: layouts with and without
semantic elements, and each kind of furniture that pages carry.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns
from .html_tree import INLINE_PLAIN, Node, Page, parse

# Class words that the made pages use for each kind of part.
_CONTENT = "article post entry content body story main text page single hentry blog news prose markdown articlebody copy".split()
_FURNITURE = {
    "menu": "nav navigation navbar menu topbar breadcrumb breadcrumbs tabs pagination pager toc submenu".split(),
    "header": "header masthead banner logo branding top site hero tagline".split(),
    "footer": "footer bottom copyright legal imprint colophon credits".split(),
    "sidebar": "sidebar side aside widget related recommended popular trending more archive tags rail secondary complementary".split(),
    "notice": "cookie consent notice gdpr alert popup modal overlay banner warning privacy message toast".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner adsbygoogle dfp partner commercial".split(),
    "form": "form search login signup newsletter subscribe contact subscription register".split(),
    "comments": "comment comments reply replies discussion disqus respond commentlist thread reactions feedback".split(),
    "share": "share social sharing follow buttons toolbar meta byline author print".split(),
}
_TAGS = {
    "menu": ("nav", "div", "ul", "menu"),
    "header": ("header", "div"),
    "footer": ("footer", "div"),
    "sidebar": ("aside", "div", "section"),
    "notice": ("div", "section", "dialog", "aside"),
    "advert": ("div", "aside", "section", "ins"),
    "form": ("form", "div", "section"),
    "comments": ("section", "div", "ol", "ul"),
    "share": ("div", "ul", "p"),
}
_EDGE_KINDS = 4


@dataclass(frozen=True)
class TreeModel:
    """weights: by feature name; edges: log potentials [kind][parent state][child state]."""

    weights: dict[str, float]
    edges: tuple[tuple[tuple[float, float], tuple[float, float]], ...]


def features(page: Page) -> list[list[str]]:
    """Names of the features of each node."""
    total = sum(n.chars for n in page.nodes) or 1
    deep, links, kids = [n.chars for n in page.nodes], [n.link_chars for n in page.nodes], [0] * len(page.nodes)
    for i in range(len(page.nodes) - 1, 0, -1):
        p = page.nodes[i].parent
        deep[p] += deep[i]
        links[p] += links[i]
        kids[p] += 1
    out = []
    for i, n in enumerate(page.nodes):
        own = ["bias", f"tag={n.tag}", f"own={_step(n.chars)}", f"deep={_step(deep[i])}", f"links={round(4 * links[i] / deep[i]) if deep[i] else 'none'}"]
        own.append(f"share={round(4 * deep[i] / total)}")
        own += [f"mark={w}" for w in n.marks]
        if not n.marks:
            own.append(f"bare={n.tag}")
        out.append(own)
    return out


def _step(n: int) -> int:
    return min(6, (n.bit_length() + 1) // 2) if n else 0


def edge_kind(node: Node) -> int:
    """Edges to plain text elements, marked elements, sections and others differ."""
    if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "td", "tr", "table", "tbody", "dl", "dd", "dt", "figure", "figcaption"):
        return 0 if not node.marks else 1
    return 2 if node.tag in ("div", "span", "center") else 3


def marginals(page: Page, unary: list[float], edges) -> tuple[list[float], list[list[list[float]]]]:
    """P(content) of each node and, for training, of each edge's states.

    ``unary`` is the log potential of content over not content.
    """
    n = len(page.nodes)
    up = [[0.0, u] for u in unary]  # log beliefs of a subtree, by state
    sent: list = [None] * n
    kinds = [edge_kind(x) for x in page.nodes]
    for i in range(n - 1, 0, -1):
        t, (b0, b1) = edges[kinds[i]], up[i]
        m = [_lse(t[0][0] + b0, t[0][1] + b1), _lse(t[1][0] + b0, t[1][1] + b1)]
        sent[i] = m
        p = up[page.nodes[i].parent]
        p[0] += m[0]
        p[1] += m[1]
    full: list = [None] * n
    full[0] = up[0]
    pairs: list = [None] * n
    for i in range(1, n):
        t, (b0, b1), f, m = edges[kinds[i]], up[i], full[page.nodes[i].parent], sent[i]
        out0, out1 = f[0] - m[0], f[1] - m[1]  # what the parent hears from all others
        pairs[i] = [[out0 + t[0][0] + b0, out0 + t[0][1] + b1], [out1 + t[1][0] + b0, out1 + t[1][1] + b1]]
        full[i] = [_lse(pairs[i][0][0], pairs[i][1][0]), _lse(pairs[i][0][1], pairs[i][1][1])]
    return [1 / (1 + math.exp(max(-60.0, min(60.0, f[0] - f[1])))) for f in full], pairs


def _lse(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if a - b < 40 else a


def train(pages: list[tuple[Page, list[int]]], steps: int = 100, rate: float = 0.6, decay: float = 2e-3) -> TreeModel:
    """Weights that maximise the pages' likelihood: gradient ascent with Adagrad steps."""
    names = sorted({f for page, _ in pages for own in features(page) for f in own})
    place = {f: i for i, f in enumerate(names)}
    held = [(page, labels, [[place[f] for f in own] for own in features(page)]) for page, labels in pages]
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-2)
    e, e2 = np.zeros((_EDGE_KINDS, 2, 2)), np.full((_EDGE_KINDS, 2, 2), 1e-2)
    for step in range(steps):
        gw, ge = -decay * w * len(held), -decay * e * len(held)
        edges = e.tolist()
        for page, labels, own in held[step % 4 :: 4]:
            unary = [float(w[ids].sum()) for ids in own]
            p, pairs = marginals(page, unary, edges)
            for i, ids in enumerate(own):
                gw[ids] += labels[i] - p[i]
                if i:
                    a = np.array(pairs[i])
                    a = np.exp(a - a.max())
                    kind = edge_kind(page.nodes[i])
                    ge[kind] -= a / a.sum()
                    ge[kind, labels[page.nodes[i].parent], labels[i]] += 1
        g2 += gw * gw
        e2 += ge * ge
        w += rate * gw / np.sqrt(g2)
        e += rate * ge / np.sqrt(e2)
    return TreeModel(dict(zip(names, w.tolist())), tuple(tuple(tuple(r) for r in k) for k in e.tolist()))


def content_marginals(page: Page, model: TreeModel) -> list[float]:
    get = model.weights.get
    unary = [sum(get(f, 0.0) for f in own) for own in features(page)]
    return marginals(page, unary, model.edges)[0]


def extract(markup: str | None, model: TreeModel) -> str:
    """The main text of a page: its content blocks, one a line; empty if none."""
    page = parse(markup or "")
    if not page.pieces:
        return ""
    p = content_marginals(page, model)
    out, held, at = [], [], -1
    for block, node, text in page.pieces:
        if block != at:
            if held and (line := " ".join("".join(held).split())):
                out.append(line)
            held, at = [], block
        if p[node] >= 0.5:
            held.append(text)
    if held and (line := " ".join("".join(held).split())):
        out.append(line)
    return "\n".join(out)


@dataclass
class _Maker:
    """Makes a page and the label of each of its nodes, in page order."""

    rng: random.Random
    parts: list[str] = field(default_factory=list)
    labels: list[int] = field(default_factory=lambda: [0])

    def words(self, lo: int, hi: int) -> str:
        n = self.rng.randint(lo, hi)
        return " ".join("".join(self.rng.choice("aeioubcdfghklmnprstvéüñ") for _ in range(self.rng.randint(2, 9))) for _ in range(n)).capitalize()

    def open(self, tag: str, label: int, marks: list[str] = []) -> None:
        attr = f' {self.rng.choice(("class", "id"))}="{self.rng.choice((" ", "-", "_")).join(marks)}"' if marks else ""
        self.parts.append(f"<{tag}{attr}>")
        if not (tag in INLINE_PLAIN and (not marks or tag == "a")):
            self.labels.append(label)

    def leaf(self, tag: str, label: int, text: str, marks: list[str] = []) -> None:
        self.open(tag, label, marks)
        self.parts.append(f"{text}</{tag}>")

    def link(self, lo: int = 1, hi: int = 4) -> str:
        return f'<a href="/x">{self.words(lo, hi)}</a>'

    def furniture(self, kind: str, bare: bool = False) -> None:
        rng = self.rng
        tag = rng.choice(_TAGS[kind]) if not bare else _TAGS[kind][0]
        marks = [] if bare or (tag not in ("div", "section", "ul", "ol", "p") and rng.random() < 0.5) else rng.sample(_FURNITURE[kind], rng.randint(1, 2))
        self.open(tag, 0, marks)
        inner = "li" if tag in ("ul", "ol", "menu") else rng.choice(("p", "div", "li", "span"))
        for _ in range(rng.randint(1, 8)):
            if kind in ("menu", "share") or rng.random() < (0.8 if kind in ("sidebar", "header", "footer") else 0.15):
                if inner == "li" and tag not in ("ul", "ol", "menu"):
                    self.open("ul", 0)
                    for _ in range(rng.randint(2, 6)):
                        self.leaf("li", 0, self.link())
                    self.parts.append("</ul>")
                else:
                    self.leaf("li" if tag in ("ul", "ol", "menu") else "p", 0, self.link())
            elif rng.random() < 0.3 and inner != "li":
                self.parts.append(self.words(3, 30))
            else:
                name = "li" if tag in ("ul", "ol", "menu") else rng.choice(("p", "div", "h3", "p"))
                self.leaf(name, 0, self.words(3, 60 if kind in ("comments", "notice", "advert") else 15))
        self.parts.append(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        style = rng.random()
        if style < 0.45:
            tag, marks = "article", [] if rng.random() < 0.6 else rng.sample(_CONTENT, 1)
        elif style < 0.6:
            tag, marks = "main", [] if rng.random() < 0.6 else rng.sample(_CONTENT, 1)
        else:
            tag, marks = rng.choice(("div", "section", "div")), rng.sample(_CONTENT, rng.randint(1, 2))
        self.open(tag, 1, marks)
        inner = rng.random() < 0.25
        if inner:
            self.open("div", 1, rng.sample(_CONTENT, 1) if rng.random() < 0.7 else [])
        if rng.random() < 0.85:
            self.leaf("h1", 1, self.words(2, 10))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6, 9, 14))):
            kind = rng.random()
            if kind < 0.72:
                text = self.words(1, rng.choice((3, 12, 60, 120)))
                if rng.random() < 0.2:
                    text = f"<b>{text}<br>" if rng.random() < 0.5 else f"{text} {self.link()} {self.words(2, 20)}"
                    self.leaf("p", 1, text)
                else:
                    self.leaf("p", 1, text)
            elif kind < 0.8:
                self.leaf(rng.choice(("h2", "h3")), 1, self.words(1, 7))
            elif kind < 0.87:
                self.open(rng.choice(("ul", "ol")), 1)
                closing = self.parts[-1][1:3]
                for _ in range(rng.randint(1, 5)):
                    self.leaf("li", 1, self.words(1, 20))
                self.parts.append(f"</{closing}>")
            elif kind < 0.9:
                self.leaf("blockquote", 1, self.words(5, 40))
            elif kind < 0.92:
                self.leaf("pre", 1, self.words(3, 30))
            elif kind < 0.94:
                self.open("table", 1)
                for _ in range(2):
                    self.open("tr", 1)
                    for _ in range(2):
                        self.leaf("td", 1, self.words(1, 6))
                    self.parts.append("</tr>")
                self.parts.append("</table>")
            else:
                self.furniture(rng.choice(("advert", "share", "form", "sidebar", "notice")))
        if inner:
            self.parts.append("</div>")
        if rng.random() < 0.15:
            self.furniture("comments")
        self.parts.append(f"</{tag}>")

    def page(self) -> str:
        rng = self.rng
        self.open("html", 0)
        if rng.random() < 0.8:
            self.open("head", 0)
            self.parts.append("<title>x</title><style>p{}</style></head>")
        self.open("body", 0)
        wrapped = rng.random() < 0.35
        if wrapped:
            self.open("div", 0, rng.sample(["wrapper", "container", "page", "site", "wrap", "outer", "layout", "root"], 1) if rng.random() < 0.8 else [])
        for kind in ("header", "menu", "notice", "advert", "form", "sidebar"):
            if rng.random() < (0.75 if kind == "menu" else 0.35):
                self.furniture(kind, bare=rng.random() < 0.4 and kind in ("menu", "header", "form", "sidebar"))
        self.article()
        for kind in ("comments", "sidebar", "advert", "form", "share", "notice", "footer"):
            if rng.random() < (0.75 if kind == "footer" else 0.35):
                self.furniture(kind, bare=rng.random() < 0.4 and kind in ("footer", "form", "sidebar"))
        if wrapped:
            self.parts.append("</div>")
        if rng.random() < 0.9:
            self.parts.append("</body></html>")
        return "".join(self.parts)


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[int]]]:
    """``n`` made pages with the label of each node of their trees."""
    out = []
    for k in range(n):
        maker = _Maker(random.Random(seed * 1_000_003 + k))
        out.append((maker.page(), maker.labels))
    return out


@lru_cache(maxsize=4)
def default_model(pages: int = 300, seed: int = 7) -> TreeModel:
    """The model of ``pages`` made pages; trained once a process."""
    return train([(parse(m), labels) for m, labels in labelled_pages(pages, seed)])


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url and the main text of every row of ``pages``.

    Null and empty html give an empty text, as do pages without content; null
    ids and urls are passed on; each input row gives one row.  Other columns are
    not read.
    """
    check_columns(pages, "page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h, shared.value) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    # A nullable id comes as floats; as text it keeps its digits.
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, "page_id string, url string, text string")
    return rows.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType)).withColumn("n_chars", F.length("text").cast("long"))
