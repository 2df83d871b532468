"""Mined patterns against a sequential scan; matching with a shuffled index; numbering."""

import random
import re

import pytest
from pyspark.sql import functions as F

from promptspark.functions.text import let
from promptspark.operators import patterns as pt
from promptspark.operators import similarity as sm
from test_similarity_vectors import sim

DOCS = "doc_id long, text string"


def norm(t):
    return " ".join(t.split()).lower()


def category(t):
    low = t.lower()
    for name, keys in (("role", ("you are", "your role", "expert")), ("examples", ("example", "instance", "e.g.")),
                       ("constraints", ("must", "should not", "constraint"))):
        if any(k in low for k in keys):
            return name
    return "general"


def sequential(rows, tau=0.85, min_frequency=2, low=20, high=500):
    """The greedy scan: candidates in order, a group per first member."""
    cands = []
    for doc, text in rows:
        for p in text.split("\n\n"):
            if len(norm(p).split()) >= 10:
                cands.append((doc, p.strip(), norm(p)))
        for s in text.split("."):
            if 5 <= len(norm(s).split()) <= 50:
                cands.append((doc, s.strip(), norm(s)))
    used, out, number = set(), [], 0
    for i, (doc, content, n) in enumerate(cands):
        if i in used:
            continue
        group = [i] + [j for j in range(i + 1, len(cands)) if j not in used
                       and (cands[j][2] == n or sim(n, cands[j][2]) >= tau)]
        used.update(group)
        best = max(group, key=lambda j: (len(cands[j][1].encode()), j))
        tokens = -(-len(cands[best][1]) // 4)
        if len(group) >= min_frequency and low <= tokens <= high:
            number += 1
            cat = category(cands[best][1])
            out.append((f"{cat}_{number:03d}", cands[best][1], len(group), tokens, cat, len({cands[j][0] for j in group})))
    return out


def corpus(seed, width):
    rng = random.Random(seed)
    letters = {1: "abcde", 2: "abéüc", 4: "ab😀ч語"}[width]
    def sentence():
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(9, 22)))
    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 6))):
            i = rng.randrange(len(t))
            t[i:i + rng.randint(0, 1)] = rng.choice([letters[0], " ", "Z", "é", ""])
        return "".join(t)
    pool = [sentence() for _ in range(8)] + ["You are an expert " + sentence(), "it must be so " + sentence()]
    rows = []
    for d in range(22):
        parts = [changed(rng.choice(pool)) if rng.random() < 0.7 else sentence() for _ in range(rng.randint(1, 4))]
        rows.append((d, rng.choice([". ", ".\n\n", "\n\n"]).join(parts)))
    return rows + [(100, ""), (101, "."), (102, "a b c d e f g h i j")]


@pytest.mark.parametrize("seed, width", [(1, 1), (2, 2), (3, 4)])
def test_mined_patterns_equal_the_sequential_scan(spark, seed, width):
    rows = corpus(seed, width)
    got = pt.mine_patterns(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["id", "content", "frequency", "avg_tokens", "category", "n_prompts"]
    want = sequential(rows)
    assert len(want) > 3 and sorted(map(tuple, got.collect())) == sorted(want)


def test_bounds_are_parameters_and_nothing_is_no_pattern(spark):
    rows = corpus(4, 1)
    got = pt.mine_patterns(spark.createDataFrame(rows, DOCS), tau=0.9, min_frequency=3, min_tokens=5, max_tokens=30)
    assert sorted(map(tuple, got.collect())) == sorted(sequential(rows, 0.9, 3, 5, 30))
    assert pt.mine_patterns(spark.createDataFrame([], DOCS)).count() == 0


def test_numbering_over_many_ranges(spark):
    rows = [(k * 7 % 1009, str(k)) for k in range(1009)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(7)
    got = pt.numbered(df, "k", "n")
    assert got.columns == ["k", "v", "n"] and all(r.n == r.k + 1 for r in got.collect())
    assert pt.numbered(df.where("false"), "k", "n").count() == 0


@pytest.mark.parametrize("tau", [0.5, 0.75, 0.9])
def test_pairs_of_one_table_equal_brute_force(spark, tau):
    rng = random.Random(int(tau * 100))
    texts = ["", "", "a", "é", "😀😀", "ab"] + ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 14))) for _ in range(90)]
    got = sm.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), tau).collect()
    want = {(i, j) for i in range(len(texts)) for j in range(i) if sim(texts[i], texts[j]) >= tau}
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in got} == want and len(got) == len(want)


def test_matches_with_a_shuffled_index_and_mixed_widths(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    patterns = [" ".join(word() for _ in range(rng.randint(3, 12))) for _ in range(6)] + ["ünï cödé wörds häre"]
    rows = []
    for d in range(30):
        p = list(rng.choice(patterns))
        for _ in range(rng.randint(0, 5)):
            p[rng.randrange(len(p))] = rng.choice("aé ")
        rows.append((d, " ".join([word() for _ in range(rng.randint(0, 30))] + ["".join(p), rng.choice(["", "😀", "é"])]
                                 + [word() for _ in range(rng.randint(0, 200))])))
    rows += [(50, ""), (51, None), (52, patterns[0].upper() + "  " + patterns[0])]
    docs = spark.createDataFrame(rows, DOCS)
    lib = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(patterns)] + [("none", " ")], "id string, content string")
    want = set()
    for d, t in rows:
        w = norm(t or "").split()
        for k, p in enumerate(patterns):
            n = len(p.split())
            found = [(sim(p, " ".join(w[s:s + n])), -s) for s in range(len(w) - n + 1)]
            if found and max(found)[0] > 0.85:
                want.add((d, f"p{k}", -max(found)[1], -max(found)[1] + n, round(max(found)[0], 9)))
    for most in (pt.BROADCAST_SEGMENTS, 0):
        monkeypatch.setattr(pt, "BROADCAST_SEGMENTS", most)
        got = pt.pattern_matches(docs, lib).collect()
        assert want and {(*tuple(r)[:4], round(r.similarity, 9)) for r in got} == want and len(got) == len(want)


def test_windows_are_tested_by_their_own_bound(spark):
    """One part of 4 windows: the bound on edits, the length and the row of buckets are the window's own."""
    words = ["abcde", "fghij", "klmno", "pq", "rstuvwxyz", "z"]
    places = [0, 6, 12, 18, 21, 31, 33]  # the last one is the end
    def kept(rows, n=2, chars=11, k=2, width=1):
        df = spark.createDataFrame([(width, n, k, chars, 2, 3, rows, chars, [0, 1, 2, 3, 4], words, places)], (
            "width int, n int, k int, L int, segs int, step int, rows array<struct<wb:long,found:int>>, nbytes int, "
            "starts array<int>, part array<string>, places array<int>"))
        return df.select(let(F.struct(*df.columns), lambda v: F.filter(v.starts, lambda s: pt._may_match(v, s, 0.85))).alias("s")).first().s
    # windows of 11, 11, 8, 12 and 11 characters; at 11 bytes one edit is allowed, at 12 too
    everywhere = [(b, 1) for b in range(-2, 12)]
    assert kept(everywhere) == [0, 1, 3, 4]
    assert kept([(b, 0) for b in range(-2, 12)]) == []
    assert kept([(0, 1)]) == [0] and kept([(2, 1)]) == [1] and kept([(6, 1)]) == [3]
    assert kept(everywhere, width=2) == [0, 1, 3, 4]


@pytest.mark.parametrize("edits", [0, 4, 8])
def test_a_pattern_in_text_of_its_own_syllables(spark, edits):
    rng = random.Random(11 + edits)
    word = lambda: "".join(rng.choice(["th", "in", "er", "on", "än"]) for _ in range(rng.randint(1, 4)))
    pattern = " ".join(word() for _ in range(12))
    def changed():
        p = list(pattern)
        for _ in range(edits):
            p[rng.randrange(len(p))] = rng.choice(["", "e", "xy", "ü"])
        return "".join(p)
    rows = [(d, " ".join([word() for _ in range(40)] + [changed() for _ in range(d % 3)])) for d in range(9)]
    want = set()
    for d, t in rows:
        w, n = norm(t).split(), len(pattern.split())
        sims = [(sim(pattern, " ".join(w[s:s + n])), -s) for s in range(len(w) - n + 1)]
        if max(sims)[0] > 0.85:
            want.add((d, -max(sims)[1], round(max(sims)[0], 9)))
    lib = spark.createDataFrame([("p", pattern)], "id string, content string")
    got = pt.pattern_matches(spark.createDataFrame(rows, DOCS), lib).collect()
    assert {(r.doc_id, r.start_word, round(r.similarity, 9)) for r in got} == want and len(got) == len(want)
    assert want or edits
