"""Pairs of a cell against brute force, and what is dealt to cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptspark.operators import edit_pairs as ep
from promptspark.operators import similarity as sm
from test_similarity_vectors import sim


def changed(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(len(t))
        t[i:i + rng.randint(0, 1)] = rng.choice(["", "e", "th", " ", "é"])
    return "".join(t)


def texts(seed, length, n):
    """Unlike texts of one vocabulary, with changed copies on both sides of the bound."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "in", "er", "on", "än", "s"]) for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(n):
        t = ""
        while len(t) < length * rng.uniform(0.9, 1.1):
            t += word() + " "
        out += [t, changed(rng, t, round(length * rng.uniform(0, 0.3)))]
    return sorted({*out, "ab" * (length // 2), "ab" * (length // 2) + "c"})


@pytest.mark.parametrize("length, n", [(12, 30), (60, 20), (130, 10), (300, 5), (900, 2), (1600, 1)])
@pytest.mark.parametrize("tau", [0.5, 0.85])
def test_pairs_equal_brute_force(length, n, tau):
    ts = texts(length, length, n)
    cell = ep.Texts(ts, np.ones(len(ts), bool), tau)
    got = {tuple(sorted((cell.texts[x], cell.texts[y]))) for x, y, _ in cell.pairs()}
    want = {(a, b) for i, b in enumerate(ts) for a in ts[:i] if sim(a, b) >= tau}
    assert want and got == want


def test_visitors_meet_homes_only():
    ts = texts(3, 40, 30)
    home = np.array([i % 3 == 0 for i in range(len(ts))])
    cell = ep.Texts(ts, np.ones(len(ts), bool), 0.85)
    everything = {(x, y): d for x, y, d in cell.pairs()}
    at = dict(zip(ts, home))
    some = ep.Texts(ts, home, 0.85)
    assert {(x, y): d for x, y, d in some.pairs()} == {
        p: d for p, d in everything.items() if at[cell.texts[p[0]]] or at[cell.texts[p[1]]]}


def test_distances_and_beginnings():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 40)))
        b = changed(rng, a, rng.randint(0, 9)) if a and rng.random() < 0.7 else a[::-1] + "x"
        d = [*range(len(b) + 1)]
        for i, x in enumerate(a):
            row = [i + 1]
            for j, y in enumerate(b):
                row.append(min(d[j] + (x != y), d[j + 1] + 1, row[j] + 1))
            d = row
        for k in (0, 2, d[-1], 60):
            assert ep.distance(a, b, k) == (d[-1] if d[-1] <= k else -1)


def test_texts_are_dealt_a_few_times_and_not_their_grams(spark, monkeypatch):
    """Before, each text was dealt as its grams, once per gram size and place."""
    rng = random.Random(9)
    ts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(30, 200))) for _ in range(3000)]
    monkeypatch.setattr(sm, "CELL_TEXTS", 500)
    df = spark.createDataFrame([(t,) for t in ts], "t string")
    cells = sm._cells(df, 0.85).groupBy("cell").agg(F.count("t").alias("n"), F.sum(F.col("home").cast("int")).alias("own")).collect()
    assert len(cells) > 4 and sum(r.own for r in cells) == len(ts) and sum(r.n for r in cells) < 4 * len(ts)
    assert max(r.n for r in cells) < len(ts) * 2 / 3


def test_cells_cut_by_hash_lose_no_pair(spark, monkeypatch):
    ts = texts(7, 50, 60)
    want = {(a, b) for i, b in enumerate(ts) for a in ts[:i] if sim(a, b) >= 0.85}
    monkeypatch.setattr(sm, "CELL_TEXTS", 5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)] + [(len(ts), None)], "id long, text string")
    got = [tuple(sorted((ts[r.a], ts[r.b]))) for r in sm.similar_pairs(df, 0.85).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sm.similar_pairs(df.where("false"), 0.85).count() == 0
