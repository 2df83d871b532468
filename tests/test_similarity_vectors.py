"""Similarity, blocking joins and clustering against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from promptspark.functions.text import normalize_text
from promptspark.operators import similarity as sm
from promptspark.operators import vectors as vc
from conftest import one


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def sim(a, b):
    m = max(len(a.encode()), len(b.encode()))
    return 1.0 if m == 0 else 1.0 - lev(a, b) / m


def test_similarity_values(spark):
    df = spark.createDataFrame([("hello", "hello"), ("", ""), ("hello", "hallo"), ("hello", "world")],
                               "a string, b string")
    v = [r[0] for r in df.select(sm.similarity("a", "b")).collect()]
    assert v[0] == 1.0 and v[1] == 1.0 and v[2] > 0.7 and v[3] < 0.5


def test_word_jaccard_and_cosine(spark):
    df = spark.createDataFrame([(1, "hello world", "world hello"), (2, "hello world", "goodbye universe"),
                                (3, "hello world hello", "hello"), (4, "hello", "world")],
                               "k long, a string, b string")
    j = {r.k: r.j for r in df.select("k", sm.word_jaccard("a", "b").alias("j")).collect()}
    assert j[1] == 1.0 and j[2] == 0.0
    c = {r.k: r.word_cosine for r in sm.word_cosine(df, "k", "a", "b").collect()}
    assert c[3] > 0.8 and c[4] == 0.0


def test_vector_cosine_and_norm(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [1.0])],
                               "a array<float>, b array<float>")
    rows = df.select(vc.cosine("a", "b").alias("c"), vc.norm(vc.normalize("a")).alias("n")).collect()
    assert [r.c for r in rows] == [1.0, 0.0, 0.0] and rows[2].n == pytest.approx(1.0)


def _fixture_texts(spark, n=250):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    sents = docs.select(F.explode(F.split("text", r"\.")).alias("s")).select(normalize_text("s").alias("t")) \
        .filter(F.length("t").between(20, 120)).limit(n).collect()
    texts = [r.t for r in sents]
    rnd = random.Random(7)
    # near copies: a few edits each
    for t in list(texts[:60]):
        chars = list(t)
        for _ in range(rnd.randint(1, 6)):
            i = rnd.randrange(len(chars))
            chars[i] = rnd.choice("abcdeé ")
        texts.append("".join(chars))
    return texts


def test_similarity_join_equals_brute_force(spark):
    texts = _fixture_texts(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.lid, r.rid) for r in sm.similarity_join(df, df, 0.85).collect()
           if r.lid != r.rid}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and sim(a, b) >= 0.85}
    assert want and got == want


def test_leader_clusters_equal_sequential_greedy(spark):
    rnd = random.Random(3)
    n = 120
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.03}
    # sequential scan
    used, lead = set(), {}
    adj = {i: set() for i in range(n)}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    for i in range(n):
        if i in used:
            continue
        used.add(i)
        lead[i] = i
        for j in range(i + 1, n):
            if j not in used and j in adj[i]:
                used.add(j)
                lead[j] = i
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "node long, ord long")
    e = spark.createDataFrame(sorted(edges), "a long, b long")
    got = {r.node: r.leader for r in sm.leader_clusters(nodes, e).collect()}
    assert got == lead


def test_pattern_matches_equal_all_windows(spark):
    """J5 seeding + count filter finds exactly what scanning every window finds."""
    from promptspark.functions.text import words
    from promptspark.operators import patterns as pt
    from promptspark.plans.similarity_plans import benchmark_library
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text") \
        .orderBy("doc_id").limit(60)
    lib = benchmark_library(spark, "/root/testdata/sf0.001").drop("item_id")
    got = {(r.doc_id, r.id, r.start_word, round(r.similarity, 12))
           for r in pt.pattern_matches(docs, lib).collect()}
    hay = docs.select("doc_id", words(normalize_text("text")).alias("hw"))
    pat = lib.select("id", normalize_text("content").alias("nd")).withColumn("n", F.size(words("nd")))
    allw = hay.crossJoin(pat).filter(F.size("hw") >= F.col("n")).withColumn(
        "starts", F.sequence(F.lit(0), F.size("hw") - F.col("n")))
    want = {(r.doc_id, r.id, r.m.start, round(r.m.similarity, 12)) for r in
            allw.select("doc_id", "id", sm.best_window("nd", "n", "hw", 0.85, "starts").alias("m"))
            .filter("m IS NOT NULL").collect()}
    assert got == want


@pytest.mark.parametrize("sides, tau", [("right", 0.85), ("right", 0.4), ("left", 0.85)])
def test_joins_with_a_small_side_equal_brute_force(spark, monkeypatch, sides, tau):
    """Whichever side is broadcast, texts of all widths of characters; ids that repeat keep their rows."""
    rng = random.Random(3)
    def some(n):
        letters = rng.choice(["ab e", "aé b", "a語😀 "])
        return "".join(rng.choice(letters) for _ in range(n))
    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 5))):
            t[rng.randrange(len(t))] = rng.choice("ae é😀")
            t.insert(rng.randrange(len(t)), rng.choice("abé"))
        return "".join(t)
    few = ["", "a", "😀"] + [some(rng.randint(2, 60)) for _ in range(25)]
    many = ["", "b", "é"] + [changed(rng.choice(few[3:])) for _ in range(80)] + [some(rng.randint(1, 60)) for _ in range(40)]
    many += many[5:8]
    a = spark.createDataFrame([(i if i < 123 else i - 118, t) for i, t in enumerate(many)] + [(900, None)], "lid int, text string")
    b = spark.createDataFrame([*enumerate(few), (901, None)], "rid int, text string")
    want = sorted((i if i < 123 else i - 118, j) for i, x in enumerate(many) for j, y in enumerate(few) if sim(x, y) >= tau)
    left, right, ids = (b, a, ("rid", "lid")) if sides == "left" else (a, b, ("lid", "rid"))
    if sides == "left":
        monkeypatch.setattr(sm, "BROADCAST_TEXTS", 100)
    got = sm.similarity_join(left, right, tau, *ids, "text", "text").collect()
    assert len(want) > 20 and sorted((r.lid, r.rid) for r in got) == want
    assert all(abs(r.similarity - sim(many[r.lid], few[r.rid])) < 1e-12 for r in got)
    assert sm.similarity_join(left, right.where("false"), tau, *ids, "text", "text").count() == 0


def test_a_library_meets_texts_without_shuffling_them(spark):
    texts = spark.range(50).selectExpr("id as lid", "repeat('some words ', 1 + id % 9) as text")
    lib = spark.createDataFrame([(1, "some words some words "), (2, "nothing")], "rid int, text string")
    got = sm.similarity_join(texts, lib, 0.85, "lid", "rid")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.lid % 9, r.rid) for r in got.collect()} == {(1, 1)}
