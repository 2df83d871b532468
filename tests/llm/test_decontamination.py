import hashlib
import random
import re

from llm_cases import ascii_lower, awkward, awkward_rows, empty, sf_dir_with

from promptspark.llm import suffix_automaton as M


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))


def brute(text, items, window=10):
    w, hit, own = words(text), set(), set()
    for name, t in items:
        iw = words(t)
        m = min(window, len(iw))
        grams = {tuple(iw[i:i + m]) for i in range(len(iw) - m + 1)} if m else set()
        for j in range(len(w) - m + 1 if m else 0):
            if tuple(w[j:j + m]) in grams:
                hit |= set(range(j, j + m))
                own.add(name)
    return w, hit, own


def test_automaton_against_all_windows():
    rng = random.Random(3)
    for _ in range(1500):
        alphabet = [bytes([97 + i]) for i in range(rng.choice([2, 3]))]
        window = rng.choice([3, 4, 5])
        items = [(str(i) if rng.random() < .9 else None, [rng.choice(alphabet) for _ in range(rng.randint(0, 9))])
                 for i in range(rng.randint(0, 5))]
        doc = [rng.choice(alphabet + [b"z"] * rng.randint(0, 1)) for _ in range(rng.randint(0, 30))]
        spans, found = M.Automaton(items, window).stream(doc)
        hit, own = set(), set()
        for name, w in items:
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                for j in range(len(doc) - m + 1):
                    if doc[j:j + m] == w[i:i + m]:
                        hit |= set(range(j, j + m))
                        own.add(name)
        assert {p for a, b in spans for p in range(a, b)} == hit and found == own


def bench(spark):
    rows = awkward_rows()
    t = rows[0][1].split()
    return [(1, " ".join(t[5:25])), (1, " ".join(t[5:25])), (2, "one two"), (3, ""), (4, None), (None, " ".join(t[30:45])),
            (10, rows[3][1].upper()), (11, "x" * 200_000)]


def test_query_on_awkward_tables(spark, tmp_path):
    items = bench(spark)
    d = sf_dir_with(spark, tmp_path, documents=awkward(spark).withColumnRenamed("lang", "hit"),
                    benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                 if r.doc_id is not None else (-1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                 for r in M.query(spark, d).collect())
    want = []
    for row in awkward_rows():
        w, hit, own = brute(row[1], items)
        ids = sorted(str(x) for x in own if x is not None)
        want.append((row[0] if row[0] is not None else -1, len(w), len(hit), len(ids),
                     hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)


def test_blocks_give_the_same_as_one(spark):
    docs = awkward(spark)
    items = spark.createDataFrame(bench(spark), "item_id long, text string")
    one = M.hits(docs, items).select("doc_id", "hit").collect()
    many = M.hits(docs, items, block_words=40).select("doc_id", "hit").collect()
    key = lambda r: str(r)
    assert sorted(map(key, one)) == sorted(map(key, many))


def test_cleaned_text(spark):
    rows = awkward_rows()
    items = spark.createDataFrame([(1, " ".join(rows[0][1].split()[5:25]))], "item_id long, text string")
    docs = awkward(spark).withColumnRenamed("source", "spans").withColumnRenamed("lang", "hit")
    out = M.decontaminate(docs, items)
    assert out.columns == docs.columns
    assert dict(out.dtypes)["hit"] == "string"
    got = {r.doc_id: r.text for r in out.collect()}
    assert words(got[0]) == [w for k, w in enumerate(words(rows[0][1])) if not 5 <= k < 25]
    assert got[1] == rows[1][1] and got[24] is None
    assert out.count() == len(rows)
    only = spark.createDataFrame([(1, rows[0][1], "", "", 0)], docs.schema)
    assert M.decontaminate(only, items, max_coverage=0.1).count() == 0


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert M.hits(empty(spark), items).count() == 0
    assert {tuple(r.hit.spans) for r in M.hits(awkward(spark), items).collect()} == {()}
