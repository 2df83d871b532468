"""The scan of texts for a library's windows against all windows, however the texts are cut."""

import random

import pytest

from promptspark.operators import patterns as pt
from promptspark.operators import window_scan as ws
from promptspark.operators.edit_pairs import myers


def similarity(x, y):
    most = max(len(t.encode()) for t in (x, y))
    return 1.0 - myers(x, y, 1 << 30) / most if most else 1.0


def best_windows(texts, patterns, tau):
    out = set()
    for i, t in enumerate(texts):
        w = t.split(" ") if t else []
        for j, p in enumerate(patterns):
            n = p.count(" ") + 1
            found = [(similarity(p, " ".join(w[s:s + n])), -s) for s in range(len(w) - n + 1)]
            if found and max(found)[0] > tau:
                out.add((i, j, -max(found)[1], round(max(found)[0], 9)))
    return out


def some_texts(rng, letters, n):
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 3)))
    patterns = [" ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(9)]
    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 6))):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "é", "語", "th"])
        return " ".join("".join(t).split())
    texts = [" ".join([word() for _ in range(rng.randint(0, 25))] + [changed(rng.choice(patterns)), changed(rng.choice(patterns))]
                      + [word() for _ in range(rng.randint(0, 40))]) for _ in range(n)]
    texts = [" ".join(t.split()) for t in texts]
    return texts + ["", patterns[0], " ".join(["aa"] * 60)], patterns + ["aa aa aa aa", patterns[3]]


@pytest.mark.parametrize("seed, letters, tau", [
    (1, ["th", "in", "er", "on"], 0.85), (2, ["é", "e", "än", "th"], 0.85), (3, ["語", "ч", "a", "😀"], 0.85), (4, ["th", "é", "on"], 0.7)])
def test_scan_equals_all_windows(monkeypatch, seed, letters, tau):
    texts, patterns = some_texts(random.Random(seed), letters, 40)
    want = best_windows(texts, patterns, tau)
    def got():
        return {(*m[:3], round(m[3], 9)) for m in ws.Library(patterns, tau).matches(texts)}
    assert len(want) > 30 and got() == want
    for name, value in (("CHARS", 150), ("HITS", 40), ("WORDS", 16), ("WINDOWS", 7), ("PAIRS", 3), ("CLEAR", 1.0), ("LARGEST", 3)):
        monkeypatch.setattr(ws, name, value)
    assert got() == want


@pytest.mark.parametrize("tau", [0.85, 0.4])
def test_whole_texts_equal_all_pairs(monkeypatch, tau):
    rng = random.Random(5)
    texts, patterns = some_texts(rng, ["th", "é", "on", "語"], 15)
    texts += [p[rng.randint(0, len(p) // 8):] for p in patterns] + ["", "é", "a"]
    patterns += ["", "b"]
    want = {(i, j, round(similarity(t, p), 9)) for i, t in enumerate(texts) for j, p in enumerate(patterns) if similarity(t, p) >= tau}
    for most in (ws.CHARS, 90):
        monkeypatch.setattr(ws, "CHARS", most)
        assert want and {(i, j, round(s, 9)) for i, j, _, s in ws.Library(patterns, tau, whole=True).matches(texts)} == want
    assert ws.Library([], tau).matches(texts) == [] and ws.Library(patterns, tau).matches([]) == []


def test_a_small_library_shuffles_matches_only(spark):
    docs = spark.createDataFrame([(1, "say some words HERE now"), (None, "some words here"), (2, None)], "doc_id long, text string")
    lib = spark.createDataFrame([("p", "some words here"), (None, "some words here"), ("e", " ")], "id string, content string")
    got = pt.pattern_matches(docs, lib)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange") == 1
    assert [tuple(r) for r in got.collect()] == [(1, "p", 1, 4, 1.0)]
