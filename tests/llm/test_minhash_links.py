import collections
import random

import pytest
from llm_cases import ascii_lower, awkward, awkward_rows, blank_words, empty, sf_dir_with

from promptspark.llm import minhash_links as M


def brute(rows, threshold=75):
    sets = []
    for i, t in rows:
        w = blank_words(ascii_lower(t or ""))
        sets.append((i, {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None or not x or not y:
                continue
            n = len(x & y)
            if 100 * n >= threshold * (len(x) + len(y) - n):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((str(i), len(s), str(root(i) if i is not None else None), i is None or root(i) == i) for i, s in sets)


def digest(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def copies(n, seed, size=80):
    """Near copies of a few texts around the threshold, many in one group."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [[rng.choice(words) for _ in range(rng.choice([7, 20, size, 3 * size]))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(texts[0] if rng.random() < .6 else rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("limit", [2, 64])
def test_against_all_pairs(spark, limit):
    rows = copies(120, limit)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(M.near_duplicates(df, list_limit=limit, block=8)) == brute(rows)


def test_query_on_awkward_tables(spark, tmp_path):
    d = sf_dir_with(spark, tmp_path, documents=awkward(spark).withColumnRenamed("lang", "sketch"))
    rows = [r[:2] for r in awkward_rows()]
    # Rows that share an id are one document: both texts tie to it.
    assert digest(M.query(spark, d)) == brute(rows)


def test_contained_texts_that_outgrow_their_sketches(spark):
    rng = random.Random(12)
    rows = []
    for p in range(1500):
        longer = rng.choice([100, 120, 160])
        w = [f"p{p}w{j}" for j in range(longer + 4)]
        rng.shuffle(w)
        rows += [(2 * p, " ".join(w)), (2 * p + 1, " ".join(w[:longer * 3 // 4 + 4]))]  # exactly 75 %
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2] == []


def test_union_sketch_is_ordered_as_the_sketch(spark):
    from pyspark.sql import functions as F
    w = [[f"{p}w{j}" for j in range(124)] for p in range(2000)]
    rows = [(p, " ".join(x), " ".join(x[:94])) for p, x in enumerate(w)]
    docs = spark.createDataFrame(rows, "id long, long string, short string")
    a, b = (M.sketches(docs, "id", c, 5, M.K).select("id", F.col("n").alias(f"n_{c}"), F.col("sketch").alias(c))
            for c in ("long", "short"))
    passed = a.join(b, "id").where(M.estimate_passes(F.col("long"), F.col("short"), F.col("n_long"), F.col("n_short"),
                                                     M.K, M.NEED, M.THRESHOLD))
    assert passed.count() == len(rows)


def test_every_text_of_a_shared_id_keeps_its_links(spark):
    rows = []
    for g in range(20):  # id 100 g + 1 holds two texts, each with a near copy elsewhere
        for half, other in enumerate((100 * g + 2, 100 * g + 3)):
            w = [f"g{g}h{half}w{j}" for j in range(80)]
            rows += [(100 * g + 1, " ".join(w)), (other, " ".join(w[:-4]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(M.near_duplicates(df)) == brute(rows)
    assert digest(M.near_duplicates(df, list_limit=1, block=2)) == brute(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    got = {r.id: r.component for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    for x in {v for e in edges for v in e}:
        assert got.get(x, x) == root(x)


def test_one_of_each_group_stays(spark):
    rows = copies(60, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = collections.defaultdict(list)
    for i, _, c, _ in brute(rows):
        groups[c].append(int(i))
    kept = [r.doc_id for r in M.deduplicate(df).collect()]
    assert sorted(kept) == sorted(min(g) for g in groups.values())


def test_empty_table(spark):
    assert M.near_duplicates(empty(spark)).count() == 0
