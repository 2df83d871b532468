import collections
import hashlib
import random
import re

from llm_cases import SF, awkward, awkward_rows, empty, sf_dir_with

from pyspark.sql import functions as F

from promptspark.llm import line_dedup as M

LAST = 2 ** 63 - 1


def one_edit(a, b):
    n = min(len(a), len(b))
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    s = 0
    while s < n - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return max(len(a), len(b)) - p - s <= 1


def brute(rows):
    lines = []
    for i, t in rows:
        for k, x in enumerate(t.split("\n") if t is not None else []):
            w = tuple(v for v in re.split(r"[\x20\x09-\x0D]+", x.lower()) if v)
            if len(w) >= M.MIN_WORDS:
                lines.append((i if i is not None else LAST, k, w, t))
    first = {}
    for place, k, w, _ in sorted(lines, key=lambda x: x[:2]):
        first.setdefault(w, (place, k))
    near = collections.defaultdict(set)
    for w in first:
        if len(w) >= M.MIN_FUZZY_WORDS:
            near[w].add(w)
            for j in range(len(w)):
                near[w[:j] + w[j + 1:]].add(w)
    drop = {a for ws in near.values() for a in ws for b in ws if first[b] < first[a] and one_edit(a, b)}
    gone = collections.defaultdict(set)
    for place, k, w, t in lines:
        if w in drop or (place, k) > first[w]:
            gone[place, t].add(k)
    out = []
    for i, t in rows:
        g = sorted(gone[i if i is not None else LAST, t])
        out.append((str(i), len(t.split("\n")) if t is not None else 0, len(g),
                    hashlib.sha256(",".join(map(str, g)).encode()).hexdigest()))
    return sorted(out)


def digest(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_removed, r.removed_sha256) for r in df.collect())


def random_rows():
    rng = random.Random(1)
    base = [[rng.choice("ab") for _ in range(rng.randint(6, 11))] for _ in range(12)]
    rows = []
    for i in range(400):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                j, how = rng.randrange(len(w)), rng.random()
                if how < .3:
                    w[j] = rng.choice("abcdefgh")
                elif how < .6:
                    w.insert(j, rng.choice("abcdefgh"))
                else:
                    del w[j]
            lines.append(rng.choice(["", " ", "\t"]) + " ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows


def test_random_lines(spark, tmp_path):
    rows = random_rows()
    d = sf_dir_with(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert digest(M.query(spark, d)) == brute(rows)


def test_query_on_awkward_tables(spark, tmp_path):
    d = sf_dir_with(spark, tmp_path, documents=awkward(spark).withColumnRenamed("lang", "text_key"))
    assert digest(M.query(spark, d)) == brute([r[:2] for r in awkward_rows()])


def test_cleaned_texts(spark):
    line = "one two three four five six seven eight nine"
    rows = [(1, f"{line}\nkeep this one\n{line}"), (2, f"{line} ten\nanother line of its own here"), (3, None),
            (4, line.upper()), (5, "short\nshort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as line_doc", "2 as id")
    out = M.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {
        1: f"{line}\nkeep this one", 2: "another line of its own here", 3: None, 4: "", 5: "short"}


def test_short_lines(spark):
    rows = [(1, "Yes\ntwo words\n\none two three\nfour words stand here\nfive words stand over there"),
            (2, "yes\n \nno\nTwo  words\none two four\nfour words sit here\nwords stand over there"),
            (3, "\nNO\none two three\nfive words stand there\ntwo\n\nfour other words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in M.dedup_lines(docs).collect()} == {
        1: rows[0][1], 2: " \nno\none two four", 3: "\ntwo\n\nfour other words here now"}
    kept = {r.doc_id: r.text for r in M.dedup_lines(docs, min_words=4, min_fuzzy_words=8).collect()}
    assert kept == dict(rows)


def test_short_random_lines(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 6)))
                          for _ in range(rng.randint(0, 6)))) for i in range(400)]
    lines = [(i, k, tuple(x.split())) for i, t in rows for k, x in enumerate(t.split("\n")) if x]
    gone = {i: [] for i, _ in rows}
    seen = []
    for i, k, w in lines:
        if any(v == w or (min(len(v), len(w)) >= 4 and one_edit(v, w)) for v in seen):
            gone[i].append(k)
        seen.append(w)
    d = sf_dir_with(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    want = {i: (len(g), hashlib.sha256(",".join(map(str, g)).encode()).hexdigest()) for i, g in gone.items()}
    assert {r.doc_id: (r.n_removed, r.removed_sha256) for r in M.query(spark, d).collect()} == want


def test_empty_table(spark):
    assert M.dedup_lines(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = M.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_half_keys_are_those_of_the_halves(spark):
    """Lines share a key exactly when they share a half, for any number of words; no line is split into words."""
    lines = ["a", "a b", "b a", "a b c", "a b c d", "a b x c d", "x b c d", "a b c d e f é", "é", "b c d", "ab c d e"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = {r.x: (r.n, r.k) for r in df.select("x", M.n_words(F.col("x")).alias("n"), M.half_keys(
        F.col("x"), M.n_words(F.col("x"))).alias("k")).collect()}

    def halves(w):
        return [(side, m, tuple(w[:m // 2] if side == "p" else w[len(w) - m // 2:])) for m in (len(w), len(w) - 1) for side in "ps"]

    want = {}
    for x in lines:
        n, keys = got[x]
        assert n == len(x.split())
        for half, key in zip(halves(x.split()), keys, strict=True):
            assert want.setdefault(half, key) == key
    assert len(set(want.values())) == len(want)
    found = M.occurrences_of(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), "doc_id", "text", 1, 4)
    # the text into lines, and uneven lines into words
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2


def test_keys_alone_are_the_keys_of_the_variants(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"], p, s) for p in (True, False) for s in (True, False)],
                               "w array<string>, p boolean, s boolean")
    for r in df.select(M.variants(F.col("w"), F.col("p"), F.col("s")).alias("v"),
                       M.variants(F.col("w"), F.col("p"), F.col("s"), only_keys=True).alias("k")).collect():
        assert [v.key for v in r.v] == r.k
