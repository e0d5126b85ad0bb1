"""A page as a tree of nodes and a list of text pieces, by one pass over its markup."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

# Element names by their role in the markup.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Their content is no text of the page: code, forms, what browsers with scripts and frames do not show, notes on formulas.
RAW = frozenset("script style title noscript template iframe textarea noembed noframes annotation annotation-xml desc metadata".split())
#: Drawings and formulas: their text belongs to the element around them.
FOREIGN = frozenset("svg math".split())
CLOSES_P = BLOCKS - {"button", "caption", "dd", "dt", "li", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "iframe", "noscript", "select", "textarea", "title", "head", "body", "html", "legend"} | {"dd", "dt", "li"}
#: A start tag ends open elements of these names, up to the named borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
}
INLINE_PLAIN = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark object q s samp small span strike strong sub sup time tt u var wbr".split())


@dataclass
class Node:
    """An element that the model judges; ``marks`` are words of class, id and role."""

    tag: str
    parent: int
    depth: int
    marks: tuple[str, ...] = ()
    chars: int = 0
    link_chars: int = 0
    children: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (block number, node, text) in page order.
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def _marks(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    out: list[str] = []
    for name, value in _ATTR.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            out += [w for w in _SPLIT.split(html.unescape(value.strip("\"'")).lower()) if w]
        elif name in ("hidden", "aria-hidden"):
            out.append("hidden" if value.strip("\"'").lower() != "false" else "shown")
    return tuple(dict.fromkeys(out))


def parse(markup: str) -> Page:
    """Nodes in page order (parents first) and text pieces of ``markup``.

    Unclosed and misnested elements are closed as browsers do in the common
    cases; an unfinished tag at the end is dropped; text in scripts, styles,
    titles and the like is not taken.  Text of formulas, drawings and embedded
    objects is inline text.
    """
    page = Page([Node("#root", -1, 0)])
    # Open elements: name, node that holds their text, own node or -1.
    stack: list[tuple[str, int]] = [("#root", 0)]
    block, at, links, foreign = 0, 0, 0, 0
    size = len(markup)

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            node = stack[-1][1]
            data = html.unescape(raw) if "&" in raw else raw
            page.pieces.append((block, node, data))
            n = len(data)
            page.nodes[node].chars += n
            if links:
                page.nodes[node].link_chars += n
        elif raw:
            page.pieces.append((block, stack[-1][1], " "))

    def close_to(depth: int) -> None:
        nonlocal block, links, foreign
        while len(stack) > depth:
            name, _ = stack.pop()
            if name in FOREIGN:
                foreign -= 1
            elif name in BLOCKS:
                block += 1
            elif name == "a":
                links -= 1

    while at < size:
        start = markup.find("<", at)
        if start < 0:
            text(markup[at:])
            break
        m = _TOKEN.match(markup, start)
        if not m:  # a lone "<" is text, unless a tag's name could follow at the end
            nxt = markup.find("<", start + 1)
            end = size if nxt < 0 else nxt
            text(markup[at:end])
            at = end
            continue
        text(markup[at:start])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        if m.group(4) != ">":  # unfinished at the end
            break
        name = name.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close_to(i)
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            else:
                if name in BLOCKS:
                    block += 1
            continue
        attributes = m.group(3)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(markup, at)
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea", "iframe"):
                at = end.end() if end else size
            if name in BLOCKS and not foreign:
                block += 1
            continue
        if name == "br":
            page.pieces.append((block, stack[-1][1], " "))
            continue
        if name in BLOCKS:
            block += 1
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close_to(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if name in ENDS:
                ends, borders = ENDS[name]
                lowest = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in borders:
                        break
                    if stack[i][0] in ends:
                        lowest = i
                if lowest:
                    close_to(lowest)
        if name in VOID or ((foreign or name in FOREIGN) and attributes.endswith("/")):
            continue
        marks = _marks(attributes)
        parent = stack[-1][1]
        if foreign or name in FOREIGN or (name in INLINE_PLAIN and not (marks and name not in ("a",))):
            own = parent
        else:
            own = len(page.nodes)
            page.nodes.append(Node(name, parent, page.nodes[parent].depth + 1, marks))
            page.nodes[parent].children += 1
        foreign += name in FOREIGN
        if name == "a":
            links += 1
        stack.append((name, own))
    return page
