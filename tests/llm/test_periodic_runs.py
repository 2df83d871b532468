"""Periodic runs against a direct search for runs."""

import hashlib
import random
import zlib

import pytest

from promptspark.llm import periodic_runs as M

from llm_cases import SF, awkward, awkward_rows, blank_words, empty, sf_dir_with


def runs_of(words, *limits):
    return M.runs_of([words], *limits)[0]


def brute_runs(w, min_words=6, min_periods=4):
    """Every maximal stretch by period; only smallest periods are kept."""
    n, out = len(w), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_words, min_periods * q):
                part = w[i:i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = blank_words(text)
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w) if len(w) < 5000 else None
    return w, runs


def digest(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words(letters):
    rng = random.Random(letters)
    for _ in range(250):
        w = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            part = [b"%d" % rng.randrange(letters + 1) for _ in range(rng.randrange(1, 7))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (part * rng.randrange(2, 7))[:rng.randrange(1, 30)]
        assert runs_of(w) == brute_runs(w), w
        for least, periods in ((1, 3), (10, 5)):
            assert runs_of(w, least, periods) == brute_runs(w, least, periods), w


def test_runs_within_runs_and_powers():
    w = (b"a b b b b b b b c " * 5).split()
    assert runs_of(w) == brute_runs(w) and len(runs_of(w)) == 6
    assert runs_of([b"x"] * 5) == [] and runs_of([b"x"] * 6) == [(0, 6, 1)]
    assert runs_of([b"x", b"y"] * 4) == [(0, 8, 2)] and runs_of([b"x", b"y"] * 3 + [b"x"]) == []
    assert runs_of([b"x"] * 50_000) == [(0, 50_000, 1)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    w = [c.encode() for c in fib[-1]]
    assert runs_of(w, 1, 3) == brute_runs(w, 1, 3)


def test_stretches_hold_every_run():
    rng, texts = random.Random(9), [[], [b"1"] * 9, [b"1"] * 9, [b"1"] * 5]
    for _ in range(100):
        w = [b"%d" % rng.randrange(30) for _ in range(200)]
        part = [b"%d" % rng.randrange(30) for _ in range(rng.randrange(1, 40))]
        w += (part * 6)[:rng.randrange(4 * len(part), 6 * len(part) + 1)] + [b"%d" % rng.randrange(30) for _ in range(100)]
        texts.append(w)
    assert M.runs_of(texts) == [brute_runs(w) for w in texts]


def test_query_on_real_and_awkward_tables(spark, tmp_path):
    for where, rows in ((SF, [tuple(r)[:2] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]),
                        (sf_dir_with(spark, tmp_path, documents=awkward(spark)), [r[:2] for r in awkward_rows()])):
        got = sorted(map(str, (tuple(r) for r in M.query(spark, where).collect())))
        want = []
        for k, t in rows:
            w, runs = brute_row(k, t)
            want.append((k, *digest(w, runs_of([x.encode() for x in w]) if runs is None else runs)))
        assert got == sorted(map(str, want))
    assert any(r[1] for r in want)


def test_empty_table_and_clashing_names(spark, tmp_path):
    assert M.query(spark, sf_dir_with(spark, tmp_path, documents=empty(spark))).count() == 0
    docs = spark.createDataFrame([(1, "so " * 8 + "it goes", "old", 7), (2, None, None, None)],
                                 "doc_id long, text string, runs string, runs_out int")
    out = M.find_runs(docs)
    assert out.columns == ["doc_id", "text", "runs_out", "runs", "collapsed"]
    a, b = out.orderBy("doc_id").collect()
    assert [tuple(r) for r in a.runs] == [(0, 8, 1)] and a.collapsed == "so it goes" and a.runs_out == 7
    assert b.runs == [] and b.collapsed == ""
    with pytest.raises(ValueError):
        M.find_runs(docs, min_periods=2)
