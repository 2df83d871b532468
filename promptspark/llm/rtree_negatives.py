"""Hard negatives by inner product, found in packed R-trees.

Method: rows are dealt to shards of equal size, and each shard is packed into an R-tree
by sort-tile-recursive cuts: rows of one label together, then tile by tile along the
coordinates that vary most, leaves of ``LEAF`` rows, ``FANOUT`` children above them.
The minimum bounding box of a node gives, coordinate by coordinate, the interval of its
rows' inner products with an anchor.  A best-first queue opens the node with the highest
upper end next and drops boxes that hold only unwanted labels, lie outside the score
window, or whose upper end is strictly below the k-th score so far (an equal one may
still hold a smaller id).

Anchors meet the rows in blocks: every (shard, block of anchors) is one group of a
cogroup, of bounded size on both sides, and each returns its k best rows.  A window per
anchor with k rows per shard merges them; Spark cuts its input to k before shuffling.
First the positives are found so, then the negatives within the window of each
positive's score.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component, take no part; rows that repeat in full count once; rows that share an id but
differ otherwise are different rows, and each is an anchor of its own; shorter vectors
are padded with zeros; scores beyond a long are cut at its ends; an anchor without
positives, or a positive without rows in its window, has no row in the result.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NAME = "op11_hard_negatives"

ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
             AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

#: Rows of a shard, anchors of a block, rows of a leaf, children of an inner node.
SHARD, BLOCK, LEAF, FANOUT = 8192, 1024, 256, 8

_LONG = 2 ** 63 - 1


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    top = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    bound = 2 * top[0] * top[1] * a.shape[1]  # twice: a box's ends are sums of two products
    if bound < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2 ** 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -_LONG, _LONG).astype(np.int64)


def tiles(points: np.ndarray, rows: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive order of ``rows``: slabs along one coordinate after the other
    until a slab is one leaf."""
    pages = -(-len(rows) // LEAF)
    if pages <= 1 or len(dims) == 0:
        return rows
    slabs = max(int(np.ceil(pages ** (1 / len(dims)))), 2 if len(dims) > 1 else pages)
    step = -(-pages // slabs) * LEAF
    rows = rows[np.argsort(points[rows, dims[0]], kind="stable")]
    return np.concatenate([tiles(points, rows[k:k + step], dims[1:]) for k in range(0, len(rows), step)])


class RTree:
    """A packed tree over the rows of a shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, points: np.ndarray):
        spread = np.argsort(-points.astype(np.float64).var(axis=0), kind="stable") if len(points) else np.arange(0)
        parts, starts, at = [], [], 0
        for label in np.unique(labels):
            part = tiles(points, np.flatnonzero(labels == label), spread)
            starts += range(at, at + len(part), LEAF)
            at += len(part)
            parts.append(part)
        order = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.ids, self.rows, self.labels, self.points = ids[order], rows[order], labels[order], points[order]
        self.floats = self.points.astype(np.float64)
        # per node: [begin, end) of rows of a leaf, or of nodes; leaves come first
        begin = np.array(starts, np.int64)
        self.leaves = len(begin)
        self.begin, self.end = begin, np.r_[begin[1:], at] if len(begin) else begin
        boxes = [np.minimum.reduceat(self.points, begin), np.maximum.reduceat(self.points, begin),
                 np.minimum.reduceat(self.labels, begin), np.maximum.reduceat(self.labels, begin)] if len(begin) else None
        level, first = boxes, 0
        while boxes is not None and len(level[0]) > 1:
            cut = np.arange(0, len(level[0]), FANOUT)
            self.begin = np.r_[self.begin, first + cut]
            self.end = np.r_[self.end, first + np.minimum(cut + FANOUT, len(level[0]))]
            first += len(level[0])
            level = [f.reduceat(x, cut) for f, x in zip((np.minimum, np.maximum) * 2, level)]
            boxes = [np.concatenate(pair) for pair in zip(boxes, level)]
        self.boxes = boxes
        self.begin, self.end = self.begin.tolist(), self.end.tolist()
        self.opened = 0

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the inner products of each anchor with each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        low, high = self.boxes[:2]
        return dot(up, low) + dot(down, high), dot(up, high) + dot(down, low)

    def search(self, anchor: np.ndarray, own_row: int, label: int, same: bool, k: int, lower: np.ndarray,
               upper: np.ndarray, windows: list[tuple[int, int]], exact: bool) -> list[list[tuple[int, int, int]]]:
        """For each score window [low, high] the first ``k`` rows (-score, id, row) with
        the anchor's label (``same``) or another one."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        if self.boxes is None:
            return found
        label_low, label_high = self.boxes[2:]
        wanted = ((label_low <= label) & (label <= label_high) if same
                  else (label_low < label) | (label < label_high)).tolist()
        lower, upper = lower.tolist(), upper.tolist()
        floats = anchor.astype(np.float64)
        highest = max((w[1] for w in windows), default=0)
        below = [w[0] for w in windows]  # scores under these are of no use any more

        def use(node: int) -> bool:
            if not wanted[node]:
                return False
            low, high = lower[node], upper[node]
            for b, w in zip(below, windows):
                if high >= b and low <= w[1]:
                    return True
            return False

        root = len(self.begin) - 1
        queue = [(-upper[root], root)] if use(root) else []
        while queue:
            _, node = heapq.heappop(queue)
            if not use(node):
                continue
            begin, end = self.begin[node], self.end[node]
            if node >= self.leaves:
                for child in range(begin, end):
                    if use(child):
                        heapq.heappush(queue, (-upper[child], child))
                continue
            self.opened += 1
            scores = ((self.floats[begin:end] @ floats).astype(np.int64) if exact
                      else dot(self.points[begin:end], anchor[None])[:, 0])
            fit = (self.labels[begin:end] == label) == same
            if same:
                fit &= self.rows[begin:end] != own_row
            near = np.flatnonzero(fit & (scores >= min(below)) & (scores <= highest))
            if len(near) == 0:
                continue
            these = scores[near]
            for j, (low, high) in enumerate(windows):
                new = near[(these >= below[j]) & (these <= high)]
                if len(new) > k:  # the k-th score of this leaf alone
                    new = new[scores[new] >= np.partition(scores[new], -k)[-k]]
                if len(new):
                    found[j] = heapq.nsmallest(k, found[j] + list(zip(
                        (-scores[new]).tolist(), self.ids[begin + new].tolist(), self.rows[begin + new].tolist())))
                    if len(found[j]) == k:
                        below[j] = max(low, -found[j][-1][0])
        return found


def _cells(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int):
    """Every shard together with every block of anchors."""
    def every(n):
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    left = rows.select("row", "id", "label", "vec", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"),
                       F.explode(every(blocks)).alias("block"))
    # anchors come from the same rows; new names keep a cogroup from mixing up both sides
    right = anchors.select(*[F.col(c).alias(f"of_{c}") for c in anchors.columns]).withColumns({
        "block": F.pmod(F.xxhash64("of_row", F.lit(7)), F.lit(blocks)),
        "shard": F.explode(every(shards))})
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))


def _searcher(same: bool, k: int, low: int, high: int):
    """Search of one cell; positives (``same``) or the negatives of each positive."""
    def search(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        anchors = anchors.rename(columns=lambda c: c.removeprefix("of_"))
        if len(rows) and len(anchors):
            width = max(rows.vec.map(len).max(), anchors.vec.map(len).max(), 1)
            tree = RTree(rows.id.to_numpy(np.int64), rows.row.to_numpy(np.int64), rows.label.to_numpy(np.int64),
                         matrix(rows.vec, width))
            points = matrix(anchors.vec, width)
            lower, upper = tree.bounds(points)
            largest = [max(abs(int(x.max())), abs(int(x.min()))) for x in (tree.points, points)]
            exact = largest[0] * largest[1] * width < 2 ** 53
            positives = [None] * len(anchors) if same else anchors.positives
            for k_, (row, anchor_id, label, these) in enumerate(zip(anchors.row, anchors.id, anchors.label, positives)):
                windows = ([(-_LONG, _LONG)] if same else
                           [(-(-low * int(p["score"]) // 100), high * int(p["score"]) // 100) for p in these])
                hits = tree.search(points[k_], row, label, same, k, lower[k_], upper[k_], windows, exact)
                for j, best in enumerate(hits):
                    p = {"id": None, "score": None} if same else these[j]
                    out += [(row, anchor_id, j, p["id"], p["score"], i, -s, r) for s, i, r in best]
        names = ["row", "anchor_id", "place", "positive_id", "positive_score", "id", "score", "found"]
        return pd.DataFrame(out, columns=names).astype({"positive_id": "Int64", "positive_score": "Int64"})

    return search


_FOUND = ("row long, anchor_id long, place int, positive_id long, positive_score long, id long, score long, found long")


def whole_vectors(rows: DataFrame, id: str, label: Column, vector: str, scale: int) -> DataFrame:
    """(row, id, label, vec) of the rows that take part; ``vec`` is the floor of each
    component times ``scale``."""
    return (rows.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"),
                        F.col(vector).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
                   & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale)))
            .dropDuplicates(["id", "label", "vec"])
            .withColumn("row", F.monotonically_increasing_id()))


def hard_negatives(rows: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding",
                   label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor (rows where ``anchor``, over ``id`` and ``label``, holds) and each
    of its first ``positives`` rows of its label, the first ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` percent of the positive's."""
    common.by_value(sys.modules[__name__])
    rows = common.cut(whole_vectors(rows, id, F.col("label") if label is None else label, vector, scale))
    anchors = rows.where(anchor)
    n, m = rows.count(), anchors.count()
    shards, blocks = max(-(-n // SHARD), 1), max(-(-m // BLOCK), 1)

    def first(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("row", "place").orderBy(F.desc("score"), "id", "found")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    near = first(_cells(rows, anchors, shards, blocks).applyInPandas(
        _searcher(True, positives, low, high), _FOUND), positives)
    near = near.groupBy("row").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "id", "score"))),
        lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    with_positives = common.cut(anchors.join(near, "row"))
    hard = first(_cells(rows, with_positives, shards, blocks).applyInPandas(
        _searcher(False, negatives, low, high), _FOUND), negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                       F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 50, against all rows."""
    rows = common.read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives(rows, F.col("id") % 50 == 0, label=label)
