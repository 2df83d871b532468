import hashlib
import random

import numpy as np
import pytest
from llm_cases import awkward, awkward_rows, empty, sf_dir_with

from promptspark.llm import maximal_repeats as M


def brute(rows, length=50):
    """(id, bytes) -> removed flags, judged on the input."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - length + 1):
                w = b[p:p + length]
                if i < first.get(w, i + 1):
                    first[w] = i
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest(rows):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def test_query_on_awkward_tables(spark, tmp_path):
    d = sf_dir_with(spark, tmp_path, documents=awkward(spark).withColumnRenamed("lang", "block"))
    assert digest(M.query(spark, d).collect()) == brute([r[:2] for r in awkward_rows()])


@pytest.mark.parametrize("hot", [0, 3, 10 ** 6])
def test_small_blocks_and_hot_minimisers(spark, monkeypatch, hot):
    monkeypatch.setattr(M, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(M, "RANGE_SEGMENTS", 100)
    monkeypatch.setattr(M, "RANGE_MINIMISERS", 300)
    rng = random.Random(hot)
    parts = ["".join(rng.choice("abc ") for _ in range(rng.randint(20, 120))) for _ in range(10)] + ["a" * 90, "ab" * 60]
    rows = [(rng.randint(0, 60), "".join(rng.choice(parts) + rng.choice(["", "x", "é"]) for _ in range(rng.randint(0, 6))))
            for _ in range(80)]
    df = M.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
    got = sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256)
                 for r in df.collect())
    assert got == brute(rows)


def test_interval_tree_lists_all_maximal_repeats():
    rng = random.Random(2)
    for _ in range(200):
        pieces = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 14))) for _ in range(rng.randint(1, 4))})
        least = 3
        _, _, repeats = M.first_documents(pieces, np.full(len(pieces), -1, np.int16),
                                          np.arange(len(pieces)), least)
        want = []
        for w in {p[i:j] for p in pieces for i in range(len(p)) for j in range(i + least, len(p) + 1)}:
            places = [(p, i) for p in pieces for i in range(len(p) - len(w) + 1) if p[i:i + len(w)] == w]
            left = {p[i - 1] if i else None for p, i in places}
            right = {p[i + len(w)] if i + len(w) < len(p) else None for p, i in places}
            if len(places) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                want.append((len(w), len(places), min(pieces.index(p) for p, _ in places)))
        assert sorted(repeats) == sorted(want)


def test_minimisers_depend_on_the_window_only():
    a = np.frombuffer(bytes(random.Random(1).choices(b"abcd", k=300)), np.uint8)
    whole = M.minimisers(a, 50, 24)
    for p in (0, 17, 250):
        assert M.minimisers(a[p:p + 50], 50, 24).tolist() == [whole[p]]


def test_empty_table(spark):
    assert M.remove_repeats(empty(spark)).count() == 0
