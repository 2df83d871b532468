"""Main text of web pages by boosted trees over the nodes of the element tree.

Method: every node (an element that is a block or has naming attributes, or a run of
text) is described by its own and its subtree's density (letters, links, words, marks),
its tag, learned weights of its attribute tokens, depth, place in the page and statistics
of its siblings, parent and ancestors.  Gradient-boosted trees give each node the
probabilities that its subtree is all main text, none of it, or mixed.  Hierarchical
decoding picks the most probable labelling of the whole tree in which nothing contradicts
itself: under a node that is all main text (or none) every node is so too, and only a
mixed node's children are free.  A page's text are the runs that end up as main text.

The trees are trained on the driver, on a bounded number of invented, labelled pages
(``labelled_pages``; ``PAGES`` of them) or on pages given by the caller, and sent to the
tasks as one small object.  Pages are worked on in batches within a task; there is no
shuffle.

Defined results: null and empty html have the empty text; rows with repeated ids are
worked on one by one; columns of the input stay, but ones named like the outputs are
replaced.  Scripts, styles, templates, controls and comments are never text.  Elements
that aren't closed end where HTML lets them end, at the latest with the page.  Memory
grows with the largest page.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosted_trees, common, html_dom, labelled_pages
from .boosted_trees import BoostedTrees
from .html_dom import Pages

NAME = "op13_html_extraction"
ORACLE_SQL = None

#: Labelled pages that the trees are trained on, and the seed of their rules.
PAGES, SEED = 1500, 11
#: Characters of html that are worked on at once.
BATCH_CHARS = 2 << 20
MIXED, MAIN, OTHER = 0, 1, 2

#: Fixed list: groups of tags that are features.
GROUPS = ("nav menu", "header", "footer", "aside", "form fieldset label legend", "article main", "section", "p",
          "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody thead tr", "td th", "div center", "blockquote pre",
          "figure figcaption", "address", "#text", "span a b strong em i small")
GROUP_OF = {tag: k for k, tags in enumerate(GROUPS) for tag in tags.split()}
#: Those of which a node's ancestors are features as well.
ABOVE = ("nav menu", "header", "footer", "aside", "form fieldset label legend", "article main", "section", "li dt dd",
         "table tbody thead tr")


def token_weights(pages: Pages, labels: np.ndarray) -> dict[str, float]:
    """How much more often a naming token stands on elements of main text than on
    others (log odds, smoothed)."""
    seen: dict[str, list[int]] = {}
    for tokens, label in zip(pages.tokens, labels.tolist()):
        for t in tokens:
            seen.setdefault(t, [0, 0, 0])[label] += 1
    return {t: float(np.clip(np.log((n[MAIN] + 0.5) / (n[OTHER] + 0.5)), -4, 4)) if n[MAIN] + n[OTHER] >= 2 else 0.0
            for t, n in seen.items()}


class Tokens:
    """Weights of an element's tokens; one that isn't known counts as the longest known
    one within it."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.parts = weights, sorted((t for t in weights if len(t) > 3), key=lambda t: (-len(t), t))
        self.known: dict[tuple[str, ...], tuple[float, float, int]] = {(): (0.0, 0.0, 0)}

    def weight(self, token: str) -> float:
        if token in self.weights:
            return self.weights[token]
        return next((self.weights[p] for p in self.parts if p in token), 0.0)

    def __call__(self, tokens: tuple[str, ...]) -> tuple[float, float, int]:
        found = self.known.get(tokens)
        if found is None:
            w = [-4.0 if t == "_hidden" else self.weight(t) for t in tokens]
            if len(self.known) > 50_000:
                self.known = {(): (0.0, 0.0, 0)}
            found = self.known[tokens] = (min(w), max(w), len(w))
        return found


def features(pages: Pages, tokens: Tokens) -> np.ndarray:
    """One row per node."""
    n = len(pages)
    parent, depth, end = (np.array(x, np.int64) for x in (pages.parent, pages.depth, pages.end))
    up, nodes = np.maximum(parent, 0), np.arange(n)
    page = np.array(pages.page, np.int64)
    root = np.searchsorted(page, page)

    def below(values):
        """Sum over each node's subtree."""
        total = np.r_[0, np.cumsum(values)]
        return total[end] - total[:-1]

    def above(values):
        """Sum over each node's ancestors, itself included."""
        change = np.zeros(n + 1)
        change[:n] += values
        np.add.at(change, end, -values)
        return np.cumsum(change)[:n]

    own = np.zeros((4, n))
    if pages.counts:
        counts = np.array(pages.counts, np.float64).T
        own[:, counts[0].astype(np.int64)] = counts[1:]
    letters, linked, words, marks = (below(x) for x in own)
    runs = below(own[0] > 0)
    elements = below(np.ones(n))
    group = np.array([GROUP_OF.get(t, -1) for t in pages.tag])
    paragraphs, items = below(group == GROUP_OF["p"]), below(group == GROUP_OF["li"])
    whole = np.maximum(letters[root], 1)
    before = np.r_[0, np.cumsum(own[0])[:-1]]
    before = before - before[root]
    low, high, named = np.array([tokens(t) for t in pages.tokens]).T
    link_share = linked / np.maximum(letters, 1)

    order = np.argsort(parent, kind="stable")
    groups = np.flatnonzero(np.r_[True, np.diff(parent[order]) != 0])
    sizes = np.diff(np.r_[groups, n])
    place, siblings = np.empty(n), np.empty(n)
    place[order] = np.arange(n) - np.repeat(groups, sizes)
    siblings[order] = np.repeat(sizes, sizes)
    family = {}
    for name, x in (("letters", letters), ("links", link_share), ("words", words / np.maximum(runs, 1))):
        mean = np.empty(n)
        mean[order] = np.repeat(np.add.reduceat(x[order], groups) / sizes, sizes)
        family[name] = mean
    next_, last = np.zeros(n), np.zeros(n)
    same = parent[order[1:]] == parent[order[:-1]]
    next_[order[:-1][same]], last[order[1:][same]] = letters[order[1:][same]], letters[order[:-1][same]]
    largest = np.zeros(n)
    np.maximum.at(largest, root, own[0])

    columns = [
        np.log1p(letters), np.log1p(own[0]), np.log1p(words / np.maximum(runs, 1)), link_share,
        np.log1p(letters / elements), marks / np.maximum(words, 1), np.log1p(runs), np.log1p(elements),
        paragraphs / np.maximum(runs, 1), items / np.maximum(runs, 1), letters / whole, before / whole,
        (before + letters) / whole, np.log1p(letters[root]), depth, place, siblings, place / np.maximum(siblings, 1),
        siblings - place, np.log1p(family["letters"]), family["links"], np.log1p(family["words"]),
        np.log1p(next_), np.log1p(last), letters / np.maximum(letters[up], 1), link_share[up],
        np.log1p((words / np.maximum(runs, 1))[up]), low, high, named, low[up], high[up],
        above(np.minimum(low, 0)), above(np.maximum(high, 0)), below(np.minimum(low, 0)), below(np.maximum(high, 0)),
        np.log1p(letters / np.maximum(runs, 1)) - np.log1p(largest[root]), group[up],
    ]
    columns += [group == k for k in range(len(GROUPS))]
    for tags in ABOVE:
        k = GROUPS.index(tags)
        columns += [above((group == k).astype(float)), below(group == k) / np.maximum(elements, 1)]
    return np.stack(columns, axis=1).astype(np.float32)


def decode(pages: Pages, log_shares: np.ndarray) -> np.ndarray:
    """Labels of the nodes: the most probable ones of those that agree with each other."""
    n = len(pages)
    parent, depth, end = (np.array(x, np.int64) for x in (pages.parent, pages.depth, pages.end))
    total = np.vstack([np.zeros(3), np.cumsum(log_shares, axis=0)])
    uniform = (total[end] - total[:-1])[:, [MAIN, OTHER]]  # the whole subtree alike
    children, free, label = np.zeros(n), np.zeros(n), np.full(n, MIXED)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)] if n and depth.max() < 200 else \
        np.split(np.argsort(depth, kind="stable"), np.flatnonzero(np.diff(np.sort(depth))) + 1)
    for nodes in reversed(levels):
        free[nodes] = np.where(end[nodes] - nodes == 1, -np.inf, log_shares[nodes, MIXED] + children[nodes])
        best = np.maximum(free[nodes], uniform[nodes].max(axis=1))
        inner = parent[nodes] >= 0
        np.add.at(children, parent[nodes[inner]], best[inner])
    for nodes in levels:
        own = np.where(free[nodes] >= uniform[nodes].max(axis=1), MIXED,
                       np.where(uniform[nodes, 0] >= uniform[nodes, 1], MAIN, OTHER))
        given = np.where(parent[nodes] >= 0, label[np.maximum(parent[nodes], 0)], MIXED)
        label[nodes] = np.where(given == MIXED, own, given)
    return label


class Extractor:
    """A fitted model: token weights and trees."""

    def __init__(self, html: list[str], mark: str = labelled_pages.MARK):
        """Fit to pages in which every run of main text holds ``mark``."""
        pages = Pages()
        for h in html:
            pages.add(h)
        labels, texts = self.truth(pages, mark)
        self.weights = token_weights(pages, labels)
        x = features(pages, Tokens(self.weights))
        self.trees = BoostedTrees(classes=3).fit(x[texts], labels[texts])

    @staticmethod
    def truth(pages: Pages, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Label of each node, and whether it has any text."""
        main, any_ = np.zeros(len(pages) + 1), np.zeros(len(pages) + 1)
        for runs in pages.runs:
            for node, _, text in runs:
                if node >= 0:
                    any_[node + 1], main[node + 1] = 1, mark in text
        main, any_ = np.cumsum(main), np.cumsum(any_)
        end = np.array(pages.end, np.int64)
        main, any_ = main[end] - main[:-1], any_[end] - any_[:-1]
        return np.where(main == 0, OTHER, np.where(main == any_, MAIN, MIXED)), any_ > 0

    def texts(self, html: list[str | None]) -> list[str]:
        """Main text of each page."""
        pages = Pages()
        for h in html:
            pages.add(h or "")
        if not hasattr(self, "tokens"):
            self.tokens = Tokens(self.weights)
        x = features(pages, self.tokens)
        log_shares = self.trees.log_shares(x)
        log_shares[np.expm1(x[:, 0]) == 0] = 0  # nodes without text say nothing
        return pages.texts(decode(pages, log_shares) == MAIN)


@functools.lru_cache(maxsize=2)
def default_extractor(count: int = PAGES, seed: int = SEED) -> Extractor:
    """Trained on ``count`` invented pages; a few seconds on the driver."""
    return Extractor(labelled_pages.pages(count, seed))


def extract(pages: DataFrame, html: str = "html", extractor: Extractor | None = None) -> DataFrame:
    """Add ``text`` (main text, blocks joined by empty lines) and ``n_chars``."""
    for module in (html_dom, boosted_trees, labelled_pages, sys.modules[__name__]):
        common.by_value(module)
    model = pages.sparkSession.sparkContext.broadcast(extractor or default_extractor())

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out, held, weight = [], [], 0
            for h in column:
                held.append(h)
                weight += len(h or "")
                if weight > BATCH_CHARS:
                    out += model.value.texts(held)
                    held, weight = [], 0
            yield pd.Series(out + (model.value.texts(held) if held else []), dtype=object)

    out = common.fresh(pages, stem="main_out")
    keep = [f"`{c}`" for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.withColumn(out, main_text.asNondeterministic()(F.col(html))).select(
        *keep, F.col(out).alias("text"), F.char_length(out).cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = common.read(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
