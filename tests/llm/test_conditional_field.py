import hashlib
import random
import re
import time

import numpy as np
import pytest
from llm_cases import awkward, awkward_rows, empty, sf_dir_with

from promptspark.llm import conditional_field_pii as M

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@pytest.fixture(scope="module")
def field():
    return M.train(M.LABELLED)


def test_base_patterns():
    rng = random.Random(2)
    for _ in range(8000):
        t = "".join(rng.choice("ab.@-+ 0123456789(.é") for _ in range(rng.randint(0, 60)))
        assert M.base_spans(t) == brute(t), t
        t = "".join(rng.choice("012.25 ") for _ in range(40))
        assert M.base_spans(t) == brute(t), t


def test_linear_time(field):
    began = time.time()
    M.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "+" * 1000 + "+1(" + "(" * 100_000)
    M.field_spans(["1" * 200_000 + "a." * 100_000], field)
    assert time.time() - began < 20


def test_viterbi_is_the_best_path(field):
    import itertools
    e = np.random.RandomState(1).normal(size=(4, 4, len(M.TAGS)))
    f = M.Field({}, np.zeros((3, 0, 7)), np.random.RandomState(2).normal(size=(7, 7)))
    for row, tags in zip(e, f.viterbi(e)):
        def worth(path):
            return sum(row[t, k] for t, k in enumerate(path)) + sum(f.moves[a, b] for a, b in zip(path, path[1:]))
        assert tuple(tags) == max(itertools.product(range(7), repeat=4), key=worth)


def test_held_out_sentences():
    """Every third sentence is held out of training."""
    f = M.train([s for k, s in enumerate(M.LABELLED) if k % 3])
    right = total = plain = 0
    for s in M.LABELLED[::3]:
        tokens, tags = M.parse(s)
        got = f.decode([tokens])[0].tolist()
        right += sum(a == b for a, b in zip(got, tags))
        plain += tags.count(0)
        total += len(tags)
    assert right / total > max(0.8, plain / total + 0.1)


def test_added_spans(field):
    texts = ["please ring (212) 555-0143 after six", "write to max.muster (at) example (dot) org today",
             "ssn 321-54-9876 was found", "in 2019 they sold 24,500 units", "", "nothing here"]
    got = [[(k, t[a:b]) for k, a, b in spans] for t, spans in zip(texts, M.field_spans(texts, field))]
    assert got[0] == [("number", "(212) 555-0143")] and got[2] == [("ident", "321-54-9876")]
    assert got[1] and got[1][0][0] == "mail" and got[3] == got[4] == got[5] == []


def test_query_on_awkward_tables(spark, tmp_path):
    rows = awkward_rows() + [(40, "mail a.b@c.example.com or +1 (377) 555-0271, ip 10.0.0.1, card 4111 1111 1111 1111", "", "", 0)]
    docs = spark.createDataFrame(rows, awkward(spark).schema).withColumnRenamed("lang", "pii")
    d = sf_dir_with(spark, tmp_path, documents=docs)
    want = []
    for r in rows:
        s = brute(r[1] or "")
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append([str(r[0]), *[sum(x[0] == k for x in s) for k in M.BASE_KINDS], hashlib.sha256(base.encode()).hexdigest()])
    got = M.query(spark, d).collect()
    assert sorted([str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] for r in got) == sorted(want)
    assert next(r.spans for r in got if r.doc_id == 40) == "email:5:22,ip:48:56,card:63:82,phone:26:43"


def test_redaction(spark):
    labelled = M.labelled_table(spark)
    rows = [(1, "mail a.b@c.example.com now 😀 10.0.0.1"), (2, None), (3, "clean")]
    out = M.redact(spark.createDataFrame(rows, "doc_id long, text string"), labelled)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail [email] now 😀 [ip]", 2: None, 3: "clean"}


def test_empty_tables(spark):
    none = M.labelled_table(spark).limit(0)
    assert M.personal_data(empty(spark), none).count() == 0
    with pytest.raises(ValueError):
        M.personal_data(empty(spark), spark.range(M.MAX_LABELLED + 1).selectExpr("string(id) sentence"))
