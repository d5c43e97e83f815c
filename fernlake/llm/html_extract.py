"""Operator 10: main text of web pages, by boosted trees over DOM nodes.

Pages are parsed into block elements (inline elements belong to their block).
Gradient-boosted trees over each node's features (subtree text, tag and link
density, attribute tokens, depth, sibling statistics, place in the page) give its
log-odds of being content. Hierarchical decoding then picks, by one pass up and
one pass down the tree, the set of nodes with the largest weighted log-odds among
all sets that hold every ancestor of each of their members, so that no content
lies inside what was called boilerplate.

The trees are trained here, by distant supervision: on at most
``MAX_TRAIN_PAGES`` pages (lowest hashes of page_id among all) that mark their parts with
semantic elements (article or main against nav, aside, header, footer, form or
blocks with advertising tokens). Those elements' names and roles are not among
the features, so that the trees also work where pages don't use them.

Training collects numbers of a bounded number of nodes; extraction is a
projection in Arrow batches without a shuffle. Whole pages are read.

Defined results, one row for each input row: null html gives null text and no
nodes; empty html or html without text gives empty text; without pages to learn
from every block's text outside script, style and head is kept; repeated rows
and repeated or null page_id give a row each; empty tables give empty results;
extra columns are ignored, whatever they are called. Very long and very deep pages are parsed whole. Ties: a node whose
log-odds add up to exactly zero goes; of equal splits of a tree the first feature and lowest threshold is taken.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.common import pick, table

#: Pages and nodes that the trees are trained on at most.
MAX_TRAIN_PAGES = 400
MAX_TRAIN_NODES = 60_000

TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "template", "svg", "iframe", "title")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
SKIPPED = frozenset(("head", "script", "style", "textarea", "noscript", "template", "svg", "iframe", "title", "select", "button"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ITEMS = frozenset(("ul", "ol", "li", "dl", "dt", "dd", "menu"))
CELLS = frozenset(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"))
CONTENT = frozenset(("article", "main"))
OTHER = frozenset(("nav", "aside", "footer", "header", "form", "dialog"))
GOOD = frozenset("article body content entry main page post story text".split())
BAD = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie footer header login menu meta nav navbar navigation newsletter pagination popup promo related share sidebar social sponsor sponsored subscribe tags toolbar widget".split())
ADS = frozenset("ad ads advert advertisement banner promo sponsor sponsored".split())
#: An element that opens closes these open ones first, up to their parent's end.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SENTENCE = re.compile(r"[.!?…。](?:\s|$)")
TOKEN = re.compile(r"[a-z]+")

NAMES = (
    "depth own_chars own_words own_links own_sentences chars words links nodes sentences link_density text_density leaf_words children siblings same_tag place_among before_chars after_chars "
    "parent_density parent_links parent_children heading item cell paragraph good bad path_good path_bad page_before page_share"
).split()


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "parts", "links", "tokens", "label")

    def __init__(self, tag, parent, tokens, label):
        self.tag, self.parent, self.tokens, self.label = tag, parent, tokens, label
        self.depth = parent.depth + 1 if parent else 0
        self.children, self.parts, self.links = [], [], 0


def parse(source: str) -> list[Node]:
    """Block elements in document order; the first is the root. Text parts stay with the block they stand in."""
    root = Node("html", None, (), None)
    nodes, stack, inline, links = [root], [root], 0, 0  # links: how many <a> are open
    i, skip = 0, 0

    def text(t):
        nonlocal links
        if not t or skip:
            return
        t = entities.unescape(t) if "&" in t else t
        node = stack[-1]
        node.parts.append((t, len(node.children)))
        if links:
            node.links += len(t.strip())

    while (m := TAG.search(source, i)) is not None:
        text(source[i : m.start()])
        i = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if tag == "a" and links:
                    links -= 1
                continue
            if tag == "br":
                text("\n")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    links = 0
                    break
            if tag == "head":
                skip = 0
            continue
        if tag in RAW:
            end = RAW[tag].search(source, i)
            i = end.end() if end else len(source)
            continue
        if tag == "a":
            links = 1
        if tag in INLINE:
            continue
        if tag in VOID:
            text("\n" if tag in ("br", "hr") else " ")
            continue
        if tag == "head":
            skip = 1
            continue
        if tag in ("html", "body"):
            skip = 0
            if tag == "html":
                continue
        links = 0
        if stack[-1].tag == "p":  # a block ends an open paragraph
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in LIMITS[tag]:
                    break
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
        parent = stack[-1]
        tokens = ()
        if "=" in m[3]:
            tokens = tuple(x for name, *v in ATTRIBUTE.findall(m[3]) if name.lower() in ("class", "id", "role") for x in TOKEN.findall("".join(v).lower()))
        label = parent.label
        if tag in CONTENT:
            label = True
        elif label is not True and (tag in OTHER or ADS.intersection(tokens)):
            label = False
        elif label is True and (tag in ("nav", "aside", "form") or ADS.intersection(tokens)):
            label = False
        node = Node(tag, parent, tokens, label)
        parent.children.append(node)
        nodes.append(node)
        if not m[3].rstrip().endswith("/") or tag in ("div", "p", "li"):
            stack.append(node)
    text(source[i:])
    return nodes


def own_text(node: Node) -> str:
    return " ".join("".join(t for t, _ in node.parts).split())


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node, columns as in ``NAMES``."""
    n = len(nodes)
    at = {id(v): k for k, v in enumerate(nodes)}
    texts = [own_text(v) for v in nodes]
    own = np.array([(len(t), t.count(" ") + 1 if t else 0, v.links, len(SENTENCE.findall(t)) if t else 0) for t, v in zip(texts, nodes)], float)
    parent = np.array([at[id(v.parent)] if v.parent else -1 for v in nodes])
    sums = np.column_stack([own, np.ones(n), (own[:, 0] > 0).astype(float)])
    for k in range(n - 1, 0, -1):
        sums[parent[k]] += sums[k]
    before = np.concatenate([[0], own[:, 0].cumsum()[:-1]])
    total = max(own[:, 0].sum(), 1)
    good = np.array([len(GOOD.intersection(v.tokens)) for v in nodes], float)
    bad = np.array([len(BAD.intersection(v.tokens)) for v in nodes], float)
    path_good, path_bad = good.copy(), bad.copy()
    around = np.zeros((n, 5))
    for k, v in enumerate(nodes):
        if k:
            path_good[k] += path_good[parent[k]]
            path_bad[k] += path_bad[parent[k]]
        kin = v.children
        if kin:
            ks = [at[id(c)] for c in kin]
            same: dict[str, int] = {}
            for c in kin:
                same[c.tag] = same.get(c.tag, 0) + 1
            for j, (c, x) in enumerate(zip(kin, ks)):
                around[x] = (len(kin), same[c.tag], (j + 1) / len(kin), sums[ks[j - 1], 0] if j else 0, sums[ks[j + 1], 0] if j + 1 < len(ks) else 0)
    density = sums[:, 0] / sums[:, 4]
    linked = sums[:, 2] / np.maximum(sums[:, 0], 1)
    up = np.maximum(parent, 0)
    kind = [[v.tag in HEADINGS, v.tag in ITEMS, v.tag in CELLS, v.tag in ("p", "pre", "blockquote")] for v in nodes]
    return np.column_stack([
        [v.depth for v in nodes], own, sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 4], sums[:, 3], linked, density, sums[:, 1] / np.maximum(sums[:, 5], 1),
        [len(v.children) for v in nodes], around, density[up], linked[up], [len(nodes[p].children) for p in up], np.array(kind, float), good, bad, path_good, path_bad, before / total, sums[:, 0] / total,
    ])


class Trees:
    """Gradient boosting of the logistic loss by complete trees over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 48, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])  # x > cut[b] when bin > b
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            s = 1 / (1 + np.exp(-f))
            g, h = y - s, s * (1 - s)
            inner, at = 2**self.depth - 1, np.zeros(len(y), int)
            feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
            for level in range(self.depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    best, cut = 1e-6, -1
                    if len(rows) > 1:
                        gs, hs = g[rows].sum(), h[rows].sum()
                        for j in range(x.shape[1]):
                            if not len(cuts[j]):
                                continue
                            gl = np.bincount(binned[rows, j], g[rows], len(cuts[j]) + 1).cumsum()[:-1]
                            hl = np.bincount(binned[rows, j], h[rows], len(cuts[j]) + 1).cumsum()[:-1]
                            gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                            if gain.max() > best:
                                best, cut = gain.max(), int(gain.argmax())
                                feature[node], threshold[node] = j, cuts[j][cut]
                    right = x[rows, feature[node]] > threshold[node]
                    at[rows] = 2 * node + 1 + right
            leaf = at - inner
            gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value = self.rate * gl / (hl + self.ridge)
            self.trees.append((feature, threshold, value))
            f += value[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            f += value[at - len(feature)]
        return f


def decode(nodes: list[Node], odds: np.ndarray, own_chars: np.ndarray) -> np.ndarray:
    """The ancestor-closed set of nodes with the largest sum of weighted log-odds."""
    worth = odds * np.log1p(own_chars)
    at = {id(v): k for k, v in enumerate(nodes)}
    best = worth.copy()
    for k in range(len(nodes) - 1, 0, -1):
        if best[k] > 0:
            best[at[id(nodes[k].parent)]] += best[k]
    keep = np.zeros(len(nodes), bool)
    keep[0] = best[0] > 0
    for k in range(1, len(nodes)):
        keep[k] = keep[at[id(nodes[k].parent)]] and best[k] > 0
    return keep


def assemble(nodes: list[Node], keep: np.ndarray) -> str:
    """Text of the kept blocks in document order, a line for each; a block's text is split where a child block stands."""
    at = {id(v): k for k, v in enumerate(nodes)}
    lines: list[str] = []
    todo: list = [nodes[0]]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            lines.append(x)
            continue
        if not keep[at[id(x)]]:
            continue
        groups: dict[int, list[str]] = {}
        for t, place in x.parts:
            groups.setdefault(place, []).append(t)
        order: list = []
        for place in range(len(x.children) + 1):
            if place in groups:
                order += [line for part in "".join(groups[place]).split("\n") if (line := " ".join(part.split()))]
            if place < len(x.children):
                order.append(x.children[place])
        todo += reversed(order)
    return "\n".join(lines)


def extract(batch: list[str | None], trees: Trees | None) -> list[tuple[str | None, int, int]]:
    """(text, number of text nodes kept, of text nodes) of each page; one call of the trees for all."""
    parsed = [parse(h) if h else [] for h in batch]
    xs = [features(p) if p else np.zeros((0, len(NAMES))) for p in parsed]
    odds = trees.log_odds(np.concatenate(xs)) if trees and any(map(len, xs)) else np.ones(sum(map(len, xs)))
    out, i = [], 0
    for h, p, x in zip(batch, parsed, xs):
        o, i = odds[i : i + len(p)], i + len(p)
        if h is None:
            out.append((None, 0, 0))
        elif not p:
            out.append(("", 0, 0))
        else:
            keep = decode(p, o, x[:, 1])
            out.append((assemble(p, keep), int((keep & (x[:, 1] > 0)).sum()), int((x[:, 1] > 0).sum())))
    return out


def teaches(nodes: list[Node]) -> bool:
    """Whether a page marks both content and other parts."""
    return {v.label for v in nodes} >= {True, False}


def teaching(pages: DataFrame) -> DataFrame:
    """The page_ids of all pages that can teach; only those that name an article or main element are parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[teaches(parse(h)) for h in b["html"]], ["page_id"]]

    return pages.filter(F.col("html").rlike("(?i)<(?:article|main)")).select(F.col("page_id").cast("long"), "html").mapInPandas(run, "page_id long").distinct()


def labelled_nodes(pages: DataFrame) -> DataFrame:
    """Label and features of the nodes with text of pages that use semantic elements."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, h in zip(b["page_id"], b["html"]):
                nodes = parse(h)
                if teaches(nodes):
                    x = features(nodes)
                    out += [(int(page), k, bool(v.label), x[k].tolist()) for k, v in enumerate(nodes) if v.label is not None and x[k, 1] > 0]
            yield pd.DataFrame(out, columns=["page_id", "node", "label", "x"])

    return pages.mapInPandas(rows, "page_id long, node int, label boolean, x array<double>")


def fit(pages: DataFrame, max_pages: int = MAX_TRAIN_PAGES, max_nodes: int = MAX_TRAIN_NODES) -> Trees | None:
    """Trees trained on a bounded number of pages and nodes, or None where no page can teach."""
    p = pick(pages, "page_id", "html").filter("page_id is not null and html is not null and length(html) > 0")
    ids = [r[0] for r in teaching(p).orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages).collect()]
    if not ids:
        return None
    rows = labelled_nodes(p.filter(F.col("page_id").isin(ids))).orderBy(F.xxhash64("page_id", "node"), "page_id", "node").limit(max_nodes).toPandas()
    if not len(rows) or rows["label"].nunique() < 2:
        return None
    rows = rows.sort_values(["page_id", "node"], kind="stable")
    return Trees().fit(np.array(rows["x"].tolist()), rows["label"].to_numpy(float))


def apply(pages: DataFrame, trees: Trees | None) -> DataFrame:
    """page_id, text, n_kept, n_blocks; one row for each input row."""
    p = pick(pages, "page_id", "html")

    def run():
        @F.pandas_udf("struct<text:string,n_kept:int,n_blocks:int>")
        def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for i in range(0, len(b), 256):
                    out += extract([x if isinstance(x, str) else None for x in b.iloc[i : i + 256]], trees)
                yield pd.DataFrame(out, columns=["text", "n_kept", "n_blocks"])

        return extracted

    return p.select("page_id", run()("html").alias("e")).select("page_id", "e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return apply(pages, fit(pages))


QUERIES = {"op10_html_extract": query}
