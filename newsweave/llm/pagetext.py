"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree. Each node is content or not; a node's own look (tag, words of
class, id and role, length and link share of its text) gives its unary potential, a table over the labels of
parent and child ties them together. The sum-product algorithm passes messages from the leaves to the root
and back, which gives every node's exact probability of being content; the text directly in the nodes of
at least ``CONTENT`` is the main text.

Both kinds of potentials are fitted to labelled pages (with a penalty, so that nothing is certain).
``labelled_pages`` holds 25 pages made for this, for callers without their own (a documented default, not a corpus); ``train`` takes any.

Reading a page follows what browsers do with its faults: tags left open end with their parent, a new
paragraph or list item ends the one before, stray end tags count for nothing, quotes open a value only behind an equals sign. Scripts,
styles and other text that is not shown are left out, character references decoded in each run of text. Of elements inside a line only ``br``
parts words. White space inside a block (a line
break too) becomes one space; blocks are joined in page order by one line break; nothing is cut off.

Null and empty pages have empty text. Pages without any element are one block in the body. Rows are
independent: repeated rows, empty tables and further columns (kept; those named as a result are replaced) need no care. Very long pages are
read whole.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsweave.llm.common import cells, map_batches, once, schema_of, with_columns
from newsweave.llm.labelled_pages import LABELLED

#: Least probability of a node whose text is given; added to every pair's count; steps and rate of the training, penalty by kind of look.
CONTENT, ADDED, STEPS, RATE = 0.5, 0.5, 3000, 0.02
PENALTY = {"word": 0.03, "tag": 0.05, "size": 0.5, "links": 0.3, "loose": 0.05, "flow": 4.0}

# Fixed by HTML: elements that start a block, that have no content, whose text is not shown, and what a new element ends.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("script style title template noscript iframe textarea noembed noframes head".split())
ENDS_P = BLOCKS - {"body", "button", "caption", "html", "legend", "option", "select", "tbody", "td", "tfoot", "th", "thead", "tr"}
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
             "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
#: Where the search for an element that a new one ends stops.
WALLS = frozenset("table ul ol dl select button body html td th article section div main aside nav header footer form".split())

#: Elements whose text may be anything.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot blockquote pre figcaption caption center".split())

#: A quote opens a value only behind an equals sign; elsewhere it is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>|<[!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMED = re.compile(r"\b(?:class|id|role|hidden|style|aria-hidden|data-main|data-off)\b", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    """A block element."""

    tag: str
    parent: int
    words: tuple[str, ...] = ()
    main: bool = False
    #: Directly in the body of the page.
    loose: bool = False
    #: Characters of text and of linked text directly in it, and below it as well.
    own: int = 0
    size: int = 0
    linked: int = 0
    kinds: list[int] = field(default_factory=list)


def named_words(attributes: str) -> tuple[tuple[str, ...], dict[str, str]]:
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    words = []
    for name in ("class", "id", "role"):
        for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", found.get(name, "")).lower()):
            words.append(w)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        words.append("hidden")
    return tuple(dict.fromkeys(words)), found


def parsed(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes (a parent before its children; the first is the root) and blocks of text (node, text) in page order."""
    nodes, blocks = [Node("html", -1)], []
    #: Open elements: tag, and the node that its text belongs to.
    stack: list[tuple[str, int]] = [("html", 0)]
    text: list[str] = []
    links, linked, at = 0, 0, 0

    def close_block():
        nonlocal linked
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            node = nodes[stack[-1][1]]
            node.own += len(joined)
            node.linked += min(linked, len(joined))
            blocks.append((stack[-1][1], joined))
        linked = 0

    def pop_to(depth: int):
        nonlocal links
        for tag, _ in stack[depth:]:
            if tag in BLOCKS:
                close_block()
            elif tag == "a":
                links -= 1
        del stack[depth:]

    while True:
        m = TOKEN.search(page, at)
        plain = page[at:m.start() if m else len(page)]
        if plain:
            # a character reference ends where its run of text does
            text.append(html.unescape(plain) if "&" in plain else plain)
            if links:
                linked += len(plain.strip())
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag in BLOCKS:
                        close_block()
                    pop_to(i)
                    break
                # an end tag inside a line does not end the blocks around it
                if stack[i][0] in BLOCKS and tag not in BLOCKS:
                    break
            continue
        if tag in UNSHOWN:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else (at if tag == "head" else len(page))
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            close_block()
            ended = ENDS_SAME.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            if ended:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ended:
                        pop_to(i)
                        if tag not in ("tr", "tbody", "tfoot", "thead"):
                            break
                    elif stack[i][0] in WALLS and not (stack[i][0] in ("td", "th") and tag in ("tr", "tbody", "tfoot", "thead")):
                        break
            if tag == "hr":
                continue
            node = Node(tag, stack[-1][1], loose=nodes[stack[-1][1]].tag in ("html", "body"))
            if NAMED.search(m[3]):
                node.words, attributes = named_words(m[3])
                node.main = "data-main" in attributes or (nodes[node.parent].main and "data-off" not in attributes)
            else:
                node.main = nodes[node.parent].main
            nodes.append(node)
            stack.append((tag, len(nodes) - 1))
        elif tag in EMPTY:
            # of all that stands inside a line only a line break parts words
            if tag == "br":
                text.append(" ")
        elif not m[3].endswith("/"):
            if tag == "a":
                links += 1
            stack.append((tag, stack[-1][1]))
    close_block()
    for n in nodes:
        n.size, n.kinds = n.own, []
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], nodes[nodes[i].parent]
        p.size += n.size
        p.linked += n.linked
    return nodes, blocks


def looks(n: Node) -> list[str]:
    """What the unary potential sees of a node. Paragraphs, headings, items and cells are what their parent is: only their tag counts."""
    out = [f"tag={n.tag}"]
    if n.size and n.tag not in FLOW:
        out += [f"size={min(4, int(math.log2(n.size + 1) / 2.5))}", f"links={min(3, 4 * n.linked // n.size)}"]
    elif n.loose and n.size:
        out.append("loose=flow")
    return out + [f"word={w}" for w in n.words] + [f"word={w[:5]}.." for w in n.words if len(w) > 5]


class TreeModel:
    """Log potentials: ``look[feature]`` of content against other, ``tie[parent][child]`` of two labels together."""

    def __init__(self, pages: tuple[str, ...]):
        names: dict[str, int] = {}
        rows, truth, pairs = [], [], np.full((2, 2), ADDED)
        for page in pages:
            nodes, _ = parsed(page)
            for n in nodes[1:]:
                rows.append([names.setdefault(f, len(names)) for f in looks(n)])
                truth.append(int(n.main))
                pairs[int(nodes[n.parent].main), int(n.main)] += 1
        # what an element is called says most; what flow elements are says least
        penalty = np.array([PENALTY["word"] if f.startswith("word=") else PENALTY["flow"] if f[4:] in FLOW else PENALTY[f.split("=")[0]] for f in names])
        weights = fitted(rows, np.array(truth), penalty)
        self.look = {f: float(weights[i]) for f, i in names.items()}
        joint = pairs / pairs.sum()
        self.tie = np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0))).tolist()

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of each node, by messages to the root and back."""
        n = len(nodes)
        unary = [0.0] + [sum(self.look.get(f, 0.0) for f in looks(x)) for x in nodes[1:]]
        # evidence at and below a node for content against other; what a child tells its parent is kept for the way back
        below, told = unary[:], [0.0] * n
        (t00, t01), (t10, t11) = self.tie
        for i in range(n - 1, 0, -1):
            told[i] = log_sum(t10, t11 + below[i]) - log_sum(t00, t01 + below[i])
            below[nodes[i].parent] += told[i]
        # the page as a whole is not content
        above = [-20.0] + [0.0] * (n - 1)
        for i in range(1, n):
            p = nodes[i].parent
            rest = above[p] + below[p] - told[i]
            above[i] = log_sum(t01, t11 + rest) - log_sum(t00, t10 + rest)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, a + b)))) for a, b in zip(above, below)]

    def text(self, page: str) -> str:
        nodes, blocks = parsed(page)
        if len(nodes) == 1:
            return "\n".join(t for _, t in blocks)
        p = self.marginals(nodes)
        return "\n".join(t for node, t in blocks if p[node] >= CONTENT)


def fitted(rows: list[list[int]], y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Weights of looks that make the labels likely (logistic regression), kept small by a quadratic penalty for each; by gradient
    steps from zero, so the same for the same pages."""
    x = np.zeros((len(rows), len(penalty)))
    for i, found in enumerate(rows):
        x[i, found] = 1
    weights = np.zeros(len(penalty))
    for _ in range(STEPS):
        weights += RATE * (x.T @ (y - 1 / (1 + np.exp(-x @ weights))) - penalty * weights)
    return weights


def log_sum(a: float, b: float) -> float:
    return (a + math.log1p(math.exp(b - a))) if a > b else (b + math.log1p(math.exp(a - b)))


def train(pages=None) -> tuple[str, ...]:
    """The labelled pages as a model's key: models are made from them once in each worker."""
    return tuple(pages if pages is not None else LABELLED)


def main_text(pages: DataFrame, model: tuple[str, ...], page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out`` and its code points in ``n_chars``; columns of these names are replaced."""
    own = [c for c in pages.columns if c not in (out, "n_chars")]

    def run(batches):
        tree = once(TreeModel, model)
        for b in batches:
            texts = [tree.text(t) if t else "" for t in cells(b, page)]
            yield with_columns(b.select(own), **{out: pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    return map_batches(pages, run, schema_of(pages.select(*own)) + f"`{out}` string, n_chars long")
