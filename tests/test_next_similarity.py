"""Whole texts compared with their neighbours: bit vectors against the distance table, and
ranges, nulls and repeated ids against the column functions."""

import random
import time

from pyspark.sql import functions as F

from promptspark.operators import edit_pairs
from promptspark.operators import similarity as sm


def test_distances_of_many_pairs_at_once(monkeypatch):
    rng = random.Random(5)
    def text(most, letters="abé 😀"):
        return "".join(rng.choice(letters) for _ in range(rng.choice([1, 63, 64, 65, 128, rng.randint(0, most)])))
    pairs = [("", ""), ("", "ab"), ("ab", ""), ("same", "same"), ("é" * 200, "e" * 64)]
    pairs += [(text(700), text(700, "abcd ")) for _ in range(150)]
    pairs += [(t, t[:20] + "zz" + t[31:]) for t in (text(900) for _ in range(40))]
    want = [edit_pairs.myers(x, y, 1 << 30) for x, y in pairs]
    assert edit_pairs.distances(pairs) == want and edit_pairs.distances([]) == []
    monkeypatch.setattr(edit_pairs, "LANES", 5)
    monkeypatch.setattr(edit_pairs, "ENTRIES", 40)
    assert edit_pairs.distances(pairs) == want


def test_long_texts_are_compared_by_bits():
    rng = random.Random(6)
    x, y = ("".join(rng.choice("abcdefgh ") for _ in range(20_000)) for _ in range(2))
    began = time.process_time()
    [d] = edit_pairs.distances([(x, y)])
    assert abs(len(x) - len(y)) <= d <= 20_000 and time.process_time() - began < 20  # 4e8 cells


def test_neighbours_over_ranges_with_nulls_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abÉ") for _ in range(rng.randint(1, 4)))
    rows = [(3 * k, "  ".join(word() for _ in range(rng.randint(0, 30)))) for k in range(40)]
    rows += [(7, "A b c"), (7, "a B C"), (121, "last one"), (121, "last  One"), (8, None), (None, "x y"), (50, "\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["similarity", "normalized_similarity", "word_jaccard", "word_cosine"]
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    pairs = spark.createDataFrame([(a[0], a[1], b[1]) for a, b in zip(order, order[1:])], "doc_id long, ta string, tb string")
    want = pairs.select("doc_id", sm.similarity("ta", "tb").alias(names[0]), sm.normalized_similarity("ta", "tb").alias(names[1]),
                        sm.word_jaccard("ta", "tb").alias(names[2])).join(sm.word_cosine(pairs, "doc_id", "ta", "tb"), "doc_id")

    def plain(df):
        return sorted((tuple(r) for r in df.select("doc_id", *names).collect()), key=repr)

    for chars in (10, sm.NEIGHBOUR_CHARS):  # some 70 ranges, most of them with one row or none, and 4
        monkeypatch.setattr(sm, "NEIGHBOUR_CHARS", chars)
        got = sm.next_similarity(docs)
        assert got.columns == ["doc_id", *names]
        # of rows that share an id either may come first
        assert [r for r in plain(got) if r[0] not in (6, 7, 120, 121)] == [r for r in plain(want) if r[0] not in (6, 7, 120, 121)]
        count = {i: sum(r[0] == i for r in plain(want)) for i in (6, 7, 120, 121)}
        assert count == {i: sum(r[0] == i for r in plain(got)) for i in count} and count[7] == 4 and count[121] == 1
    assert sm.next_similarity(docs.where("doc_id = 8")).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b c")], "doc_id long, text string")
    got = sm.next_similarity(twice).where("doc_id = 1").collect()
    assert len(got) == 4 and len({round(r.word_cosine, 9) for r in got}) == 1
    assert sm.next_similarity(twice.where(F.lit(False))).count() == 0
