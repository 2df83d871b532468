import collections
import math
import random

import pytest
from llm_cases import SF, awkward, awkward_rows, empty, sf_dir_with

from promptspark.llm import ngram_scores as M


def brute(rows, alpha=0.4, cutoff=1, leave_out=True):
    count = [collections.Counter() for _ in range(4)]
    texts = [(t or "").encode().lower().split() for _, t in rows]
    grams = [[collections.Counter(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) for n in range(4)] for w in texts]
    for mine in grams:
        for n in (1, 2, 3):
            count[n].update(mine[n])
    out = []
    for (i, _), w, mine in zip(rows, texts, grams):
        def seen(n, gram):
            return count[n][gram] - (mine[n][gram] if leave_out else 0)

        total = sum(count[1].values()) - (len(w) if leave_out else 0)
        s, by = 0.0, [0, 0, 0, 0]
        for j in range(len(w)):
            three, two, one = tuple(w[j - 2:j + 1]), tuple(w[j - 1:j + 1]), (w[j],)
            if j >= 2 and seen(3, three) >= cutoff:
                s += math.log10(seen(3, three) / seen(2, three[:2]))
                by[3] += 1
            elif j >= 1 and seen(2, two) >= cutoff:
                s += math.log10(seen(2, two) / seen(1, two[:1])) + (math.log10(alpha) if j >= 2 else 0)
                by[2] += 1
            else:
                n = seen(1, one)
                s += math.log10(max(n, 1) / max(total, 1)) + math.log10(alpha) * (min(j, 2) + (n == 0))
                by[1] += 1
        out.append((str(i), len(w), round(s, 4), by[3], by[2], by[1]))
    return sorted(out)


def digest(df):
    return sorted((str(r.doc_id), r.n_words, round(r.log_score, 4), r.n_triples, r.n_pairs, r.n_singles)
                  for r in df.collect())


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[3:] == w[3:] and g[2] == pytest.approx(w[2], rel=1e-6, abs=2e-3)


def test_query_on_awkward_tables(spark, tmp_path):
    d = sf_dir_with(spark, tmp_path, documents=awkward(spark).withColumnRenamed("lang", "block"))
    same(digest(M.query(spark, d)), brute([r[:2] for r in awkward_rows()]))


def test_many_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(M, "RANGE_KEYS", 2000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    same(digest(M.score(docs)), brute([tuple(r) for r in docs.collect()]))


def test_query_counts_all_ngrams(spark, tmp_path):
    rows = [(1, "a b c d"), (2, "a b e"), (3, "x y z"), (4, "b"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = digest(M.score(docs, leave_out=False))
    same(got, brute(rows, leave_out=False))
    assert {g[0]: g[3] for g in got} == {"1": 2, "2": 1, "3": 1, "4": 0, "5": 0}
    got = digest(M.query(spark, sf_dir_with(spark, tmp_path, documents=docs)))
    same(got, brute(rows))
    assert {g[0]: g[3:] for g in got} == {"1": (0, 1, 3), "2": (0, 1, 2), "3": (0, 0, 3), "4": (0, 0, 1), "5": (0, 0, 0)}


def test_prose_scores_over_junk_and_copies_over_both(spark):
    rng = random.Random(1)
    common_words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    def prose():
        return " ".join(common_words[min(int(rng.expovariate(0.08)), 59)] for _ in range(100))
    rows = [(k, prose()) for k in range(80)]
    rows += [(100 + k, " ".join("".join(rng.choice("qwrtzpsdfg") for _ in range(8)) for _ in range(100))) for k in range(5)]
    rows += [(200, prose() + " unique"), (201, rows[0][1])]
    got = {r.doc_id: r for r in M.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    junk, usual = [got[100 + k].mean_log_score for k in range(5)], [got[k].mean_log_score for k in range(1, 80)]
    assert max(junk) < min(usual) and max(usual) < got[0].mean_log_score == pytest.approx(got[201].mean_log_score)
    assert any(got[k].n_pairs > 1 and got[k].n_singles > 1 for k in range(1, 80))


def test_small_blocks_with_and_without_a_cutoff(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(M, "RANGE_KEYS", 2000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for cutoff in (1, 2, 3):
        same(digest(M.score(docs, cutoff=cutoff)), brute(rows, cutoff=cutoff))
    same(digest(M.score(docs, cutoff=2, leave_out=False)), brute(rows, cutoff=2, leave_out=False))
    same(digest(M.score(docs)), brute(rows, cutoff=1))


def test_mean_is_null_without_words(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, "a a a")], "doc_id long, text string")
    got = {r.doc_id: r for r in M.score(rows).collect()}
    assert got[1].mean_log_score is None and got[2].log_score == 0.0 and got[3].n_words == 3


def test_packing():
    import numpy as np
    for keys in ([5], [1, 2, 3], [0, 2 ** 47, 2 ** 48 - 1], list(range(0, 2 ** 40, 2 ** 31))):
        k = np.array(keys, dtype=np.uint64)
        assert M.unpack(M.pack(k)).tolist() == keys
    for counts in ([1], [1, 1, 2, 9, 1, 2 ** 40], [3] * 100):
        c = np.array(counts, dtype=np.int64)
        assert M.unpack_counts(M.pack_counts(c), len(c)).tolist() == counts


def test_empty_table(spark):
    assert M.score(empty(spark)).count() == 0
