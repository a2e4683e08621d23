"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Each node is main text or not. A node's tag, the words of its class and id, its share of link text and its length
speak for either; a parent and its child mostly agree. These potentials are learned from labelled pages. Messages
then go up and down a page's tree (sum-product), and a node's text stays where its marginal says main text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .labelled import LABELLED

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("head script style template noscript title svg iframe object canvas math".split())
RAW = frozenset("script style template noscript title textarea iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rt rp s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES_ALIKE = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HINT = re.compile(r"[a-z]+")
_MARK = re.compile(r"\bdata-(main|not)\b")


class Node:
    """An element that may be judged, with what stands in it directly."""

    __slots__ = ("tag", "parent", "hints", "mark", "shown", "chars", "linked", "words")

    def __init__(self, tag: str, parent: int, hints: tuple, mark: str | None, shown: bool):
        self.tag, self.parent, self.hints, self.mark, self.shown = tag, parent, hints, mark, shown
        self.chars = self.linked = self.words = 0


def tree(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents first, and the text in page order as (node, text); a node of -1 separates blocks.

    Inline elements without class or id belong to the node around them.
    """
    nodes = [Node("#root", -1, (), None, True)]
    texts: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the nodes they are or belong to
    links = 0
    at, end = 0, len(page)

    def close(upto: int) -> None:
        nonlocal links
        for tag, _ in stack[upto:]:
            links -= tag == "a"
            if tag not in INLINE:
                texts.append((-1, " "))
        del stack[upto:]

    def add(raw: str) -> None:
        owner = stack[-1][1]
        if raw and nodes[owner].shown:
            text = entities.unescape(raw) if "&" in raw else raw
            own, size = nodes[owner], len(text.strip())
            own.chars += size
            own.words += text.count(" ") + 1 if size else 0
            if links:
                own.linked += size
            texts.append((owner, text))

    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = found["tag"] or found["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if found["close"] or found["close2"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        rest = found["rest"] or found["rest2"] or ""
        if tag in VOID:
            if tag not in INLINE:
                texts.append((-1, " "))
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if tag in CLOSES_ALIKE:
            alike, within = CLOSES_ALIKE[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in alike:
                    close(depth)
                elif stack[depth][0] in within:
                    break
        hints, mark = (), None
        if "=" in rest or "data-" in rest:
            named = " ".join(a or b or c for _, a, b, c in _NAMES.findall(rest)).lower()
            hints = tuple(_HINT.findall(named)) if named else ()
            if "data-" in rest and (marked := _MARK.search(rest)):
                mark = marked[1]
        owner = stack[-1][1]
        if tag not in INLINE:
            texts.append((-1, " "))
        if tag not in INLINE or hints:
            nodes.append(Node(tag, owner, hints, mark, nodes[owner].shown and tag not in UNSHOWN))
            owner = len(nodes) - 1
        if rest.endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            shut = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(page, at)
            stop = shut.start() if shut else end
            if tag == "textarea":
                stack.append((tag, owner))
                add(page[at:stop])
                stack.pop()
            at = stop
            if shut:
                closing = page.find(">", stop)
                at = end if closing < 0 else closing + 1
            continue
        links += tag == "a"
        stack.append((tag, owner))
    return nodes, texts


def _length(words: int) -> str:
    return "none" if not words else "few" if words < 5 else "some" if words < 20 else "many"


def observed(nodes: list[Node]) -> list[list[tuple[str, str]]]:
    """What is seen of each node: tag, hints, and how long and how linked the text in it is."""
    chars, linked, words = ([getattr(n, k) for n in nodes] for k in ("chars", "linked", "words"))
    for i in range(len(nodes) - 1, 0, -1):
        parent = nodes[i].parent
        chars[parent] += chars[i]
        linked[parent] += linked[i]
        words[parent] += words[i]
    seen = []
    for i, node in enumerate(nodes):
        share = linked[i] / chars[i] if chars[i] else 0
        level = "none" if share == 0 else "some" if share < 0.5 else "most"
        seen.append(
            [("tag", node.tag), ("length", _length(words[i])), ("links", level), *(("hint", h) for h in node.hints)]
        )
    return seen


@dataclass
class TreeModel:
    """Log potentials: of each observation for main text against not, and of parent and child states."""

    odds: dict[tuple[str, str], float] = field(default_factory=dict)
    edges: tuple[tuple[float, float], tuple[float, float]] = ((0.99, 0.01), (0.01, 0.99))
    root: tuple[float, float] = (0.99, 0.01)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of main text for each node, by messages up the tree and down again."""
        get = self.odds.get
        local = []
        for seen in observed(nodes):
            x = math.exp(max(-30.0, min(30.0, sum(get(s, 0.0) for s in seen))))
            local.append((1 / (1 + x), x / (1 + x)))
        (e00, e01), (e10, e11) = self.edges
        size = len(nodes)
        below = [list(p) for p in local]  # local potential times the messages of children
        up = [(1.0, 1.0)] * size
        for i in range(size - 1, 0, -1):
            b0, b1 = below[i]
            scale = b0 + b1
            m0, m1 = (e00 * b0 + e01 * b1) / scale, (e10 * b0 + e11 * b1) / scale
            up[i] = (m0, m1)
            above = below[nodes[i].parent]
            above[0] *= m0
            above[1] *= m1
            if above[0] + above[1] < 1e-200:
                above[0] *= 1e200
                above[1] *= 1e200
        outside = [(1.0, 1.0)] * size  # what the rest of the tree says about a node
        outside[0] = self.root
        result = [0.0] * size
        for i in range(size):
            if i:
                p = nodes[i].parent
                w0 = outside[p][0] * below[p][0] / up[i][0]
                w1 = outside[p][1] * below[p][1] / up[i][1]
                scale = w0 + w1
                w0, w1 = w0 / scale, w1 / scale
                outside[i] = (e00 * w0 + e10 * w1, e01 * w0 + e11 * w1)
            s0, s1 = outside[i][0] * below[i][0], outside[i][1] * below[i][1]
            result[i] = s1 / (s0 + s1)
        return result


def _labels(nodes: list[Node], by_tag: bool) -> list[int] | None:
    """1 for main text: as marked, or by what the tags of a page mean; None if they do not say."""
    labels = []
    for node in nodes:
        above = labels[node.parent] if node.parent >= 0 else 0
        if by_tag:
            if node.tag in ("article", "main"):
                above = 1
            elif node.tag in ("nav", "header", "footer", "aside", "form"):
                above = 0
        elif node.mark:
            above = int(node.mark == "main")
        labels.append(above)
    return labels if any(labels) else None


def train(pages: list[tuple[str, bool, float]], smoothing: float = 0.1) -> TreeModel:
    """A model from labelled pages: html, whether its tags are the labels (else its marks), and a weight."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    totals = [Counter(), Counter()]
    edges = [[0.01, 0.01], [0.01, 0.01]]
    for page, by_tag, weight in pages:
        nodes, _ = tree(page)
        labels = _labels(nodes, by_tag)
        if labels is None:
            continue
        for i, (node, seen) in enumerate(zip(nodes, observed(nodes), strict=True)):
            if not node.shown:
                continue
            for kind, value in seen:
                counts[labels[i]][kind, value] += weight
                totals[labels[i]][kind] += weight
            if node.parent >= 0:
                edges[labels[node.parent]][labels[i]] += weight
    odds = {}
    for what in counts[0].keys() | counts[1].keys():
        kind = what[0]
        # Hints differ from site to site: how often one was seen counts, not its share of all hints.
        # And one name in a class says more than a tag, a length or links, which all kinds of text share.
        least, within = (smoothing / 5, "tag") if kind == "hint" else (smoothing, kind)
        share = [(counts[s][what] + least) / (totals[s][within] + 1) for s in (0, 1)]
        odds[what] = math.log(share[1] / share[0])
    rows = tuple(tuple(x / sum(row) for x in row) for row in edges)
    return TreeModel(odds, rows)


def main_text(page: str | None, model: TreeModel) -> str:
    """The main text of a page: character references decoded, each run of white space one space, blocks joined by one."""
    if not page:
        return ""
    nodes, texts = tree(page)
    main = model.marginals(nodes)
    return " ".join("".join(text for node, text in texts if node < 0 or main[node] >= 0.5).split())


@dataclass(frozen=True)
class ExtractionParams:
    """``sample_pages`` bounds the pages of the table that teach the model, by what their tags mean."""

    sample_pages: int = 256
    own_weight: float = 0.02


def fitted(pages: DataFrame, params: ExtractionParams = ExtractionParams()) -> TreeModel:
    """A model from the marked pages of this package and a bounded sample of ``pages`` (id, html)."""
    known = pages.where("html is not null").withColumn("hash", F.xxhash64("html"))
    # Hashes alone are sorted out first, so that no task sends more pages than the sample has.
    chosen = known.select("hash").distinct().orderBy("hash").limit(params.sample_pages)
    found = known.join(F.broadcast(chosen), "hash", "left_semi").dropDuplicates(["hash"])
    sample = [r["html"] for r in found.select("html").collect()]
    return train([(p, False, 1.0) for p in LABELLED] + [(p, True, params.own_weight) for p in sample])


def extracted(
    pages: DataFrame,
    id_column: str = "page_id",
    html_column: str = "html",
    params: ExtractionParams = ExtractionParams(),
    model: TreeModel | None = None,
) -> DataFrame:
    """A row for each row of ``pages``: id, text (empty if there is none).

    Null and empty pages have no text. Repeated rows and null ids come out as they go in; an empty table gives no
    rows. Other columns are not read.
    """
    source = pages.select(F.col(id_column).alias("id"), F.col(html_column).alias("html"))
    learned = model or fitted(source, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, learned) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return in_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, text string")
