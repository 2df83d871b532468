"""Hard negatives against a search of all rows."""

import math
import random

import numpy as np
import pytest
from llm_cases import SF, sf_dir_with

from promptspark.llm import rtree_negatives as M

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, relabel=True):
    seen = set()
    for k, v, c in rows:
        if None in (k, v, c) or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = int(math.fmod(c + 1, 10)) if relabel and k % 7 == 0 else c
        seen.add((k, c, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    seen = sorted(seen)
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in (r for r in seen if r[0] % 50 == 0):
        all_ = sorted(((-score(a, b), b[0], b) for b in seen if b != a), key=lambda t: t[:2])
        for s, i, _ in [t for t in all_ if t[2][1] == a[1]][:5]:
            fit = [t for t in all_ if t[2][1] != a[1] and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(a[0], i, r + 1, t[1], -s, -t[0]) for r, t in enumerate(fit)]
    return sorted(out)


def rows_of(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows)
    assert want and rows_of(M.query(spark, SF)) == want


def test_many_shards_blocks_and_leaves(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(M, "SHARD", 150)
    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "LEAF", 5)
    monkeypatch.setattr(M, "FANOUT", 3)
    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 0.25, 0.5, -0.5, 1.0]) for _ in range(3)], rng.randrange(3)) for k in range(0, 1500, 2)]
    where = sf_dir_with(spark, tmp_path, embeddings=spark.createDataFrame(rows, ROWS))
    assert rows_of(M.query(spark, where)) == brute(rows)


def test_nulls_ties_repeats_and_lengths(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5], 2), (50, [0.25, 1.0, 0.0], 1), (1, [1.0, 0.5], 1),
            (2, [1.0, 0.5], 1), (3, [0.75, 0.5], 2), (4, [0.75, 0.5], 2), (5, [0.75, 0.5], 3), (6, [0.75, 0.5], 4),
            (8, [0.5, nan], 2), (9, [inf, 0.1], 2), (10, None, 2), (11, [0.5, None], 2), (12, [0.5, 0.5], None),
            (None, [0.7, 0.5], 2), (13, [], 2), (100, [], 2), (150, [-1.0, -1.0], 5), (15, [1.0, 1.0], 5),
            (16, [0.0, 0.0], 6), (200, [0.0, 0.0], 6)]
    where = sf_dir_with(spark, tmp_path, embeddings=spark.createDataFrame(rows, ROWS))
    assert rows_of(M.query(spark, where)) == brute(rows)


def test_empty_table(spark, tmp_path):
    where = sf_dir_with(spark, tmp_path, embeddings=spark.createDataFrame([], ROWS))
    assert rows_of(M.query(spark, where)) == []


def test_large_numbers_stay_exact():
    a, b = np.array([[2 ** 26 + 1, 3]]), np.array([[2 ** 27 + 1, -5]])
    assert M.dot(a, b)[0, 0] == (2 ** 26 + 1) * (2 ** 27 + 1) - 15
    assert M.dot(np.array([[2 ** 62, 1]]), np.array([[2 ** 10, 1]]))[0, 0] == 2 ** 63 - 1


@pytest.mark.parametrize("dims", [1, 2, 7])
def test_boxes_hold_scores_and_prune(dims):
    rng = np.random.default_rng(dims)
    labels = rng.integers(0, 4, 3000)
    points = (rng.normal(0, 9, (4, dims))[labels] * 20 + rng.normal(0, 5, (3000, dims))).astype(np.int64)
    tree = M.RTree(np.arange(3000), np.arange(3000), labels, points)
    lower, upper = tree.bounds(points[:20])
    scores = M.dot(points[:20], tree.points)
    for leaf in range(tree.leaves):
        s = scores[:, tree.begin[leaf]:tree.end[leaf]]
        assert (lower[:, leaf] <= s.min(axis=1)).all() and (s.max(axis=1) <= upper[:, leaf]).all()
    assert sorted(tree.rows) == list(range(3000)) and (np.diff(tree.begin[:tree.leaves]) <= M.LEAF).all()
    for k in range(20):
        got = tree.search(points[k], k, labels[k], True, 5, lower[k], upper[k], [(-M._LONG, M._LONG)], True)[0]
        all_ = M.dot(points[k:k + 1], points)[0]
        assert got == sorted((-int(all_[i]), i, i) for i in range(3000) if labels[i] == labels[k] and i != k)[:5]
    assert tree.opened < 20 * tree.leaves
