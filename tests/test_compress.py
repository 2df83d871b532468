"""Compression with a library: substitution and its inverse, accounting, documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from promptspark.operators import compress as cp
from promptspark.operators import documents as dc
from promptspark.operators import extract as ex
from promptspark.operators import patterns as pt

LIB = "id string, content string, frequency long, avg_tokens long, category string"
DOCS = "doc_id long, text string"


def fixture():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    lib = [("role_001", "You are an expert " + say(12), 2, 20, "role"), ("general_002", say(9), 2, 15, "general"),
           ("constraints_003", "it must not " + say(7), 2, 12, "constraints")]
    rows = []
    for d in range(25):
        parts = [rng.choice([say(rng.randint(4, 30)) + ".", rng.choice(lib)[1], "[PATTERN:role_001] is literal ]",
                             rng.choice(lib)[1].replace("a", "A", 2) + " x"]) for _ in range(rng.randint(3, 9))]
        rows.append((d, rng.choice(["  ", "", "\t"]) + rng.choice(["\n", " \n ", "  "]).join(parts) + rng.choice(["", " \n"])))
    return lib, rows + [(90, ""), (91, "short"), (92, None), (93, lib[0][1] + " " + lib[0][1] + " " + say(200))]


@pytest.fixture(scope="module")
def compressed(spark):
    lib, rows = fixture()
    library, docs = spark.createDataFrame(lib, LIB), spark.createDataFrame(rows, DOCS)
    out = cp.compress_with_library(docs, library, config=ex.CompressionConfig("light"), context_path="lib.json").checkpoint()
    return lib, dict(rows), library, docs, out


def tokens(t):
    return -(-len(t) // 4)


def test_substitution_and_its_inverse(compressed):
    lib, texts, library, docs, out = compressed
    split = docs.select("doc_id", ex.split_parts(F.col("text"))["head"].alias("instr"))
    found = pt.pattern_matches(split.where("length(instr) > 196"), library, "doc_id", "instr")
    want = {}
    for r in sorted(found.collect(), key=lambda r: (r.start_word, -r.similarity, r.id)):
        if not want.get(r.doc_id) or want[r.doc_id][-1][1] <= r.start_word:
            want.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.id))
    instr = {r.doc_id: r.instr for r in split.collect()}
    some = 0
    for r in out.withColumn("back", cp.restore_windows("substituted", "marks")).collect():
        if r.text is None or tokens(r.text) < 50:
            assert not r.marks and r.task == r.text
            continue
        assert r.back == instr[r.doc_id]
        spans = [m.span() for m in re.finditer(r"\S+", instr[r.doc_id])]
        here, text = want.get(r.doc_id, []), instr[r.doc_id]
        assert [(m.id, m.matched) for m in r.marks] == [(i, text[spans[s][0]:spans[e - 1][1]]) for s, e, i in here]
        for s, e, i in reversed(here):
            text = text[:spans[s][0]] + f"[PATTERN:{i}]" + text[spans[e - 1][1]:]
        assert r.substituted == text
        assert all(text[m.at:].startswith(f"[PATTERN:{m.id}]") for m in r.marks)
        some += len(here)
    assert some > 10


def test_accounting_and_documents(spark, compressed):
    lib, texts, library, docs, out = compressed
    by_id = {r[0]: r for r in lib}
    for r in out.where("text is not null").collect():
        assert r.original_tokens == tokens(r.text)
        refs = [f"@{by_id[m.id][4].upper()}[{m.id}]" for m in r.marks]
        assert r.compressed_tokens == 10 + sum(map(tokens, refs)) + tokens(r.task)
        assert r.tokens_saved == max(0, r.original_tokens - r.compressed_tokens)
        assert sum(m.tokens_saved for m in r.marks) == sum(max(0, tokens(by_id[m.id][1]) - tokens(f"@{by_id[m.id][4].upper()}[{m.id}]"))
                                                          for m in r.marks)
        assert r.document == "@HIERATIC v1.0\n@CONTEXT: lib.json\n\n" + "".join(f"{x}\n\n" for x in refs) + f"@TASK\n{r.task}\n\n"
        saved = sum(m.tokens_saved for m in r.marks)
        if r.target_tokens is not None and r.original_tokens - saved <= r.target_tokens and not r.marks:
            assert r.task == r.text.strip()
    parsed = dc.parse(out.where("size(marks) > 0").select("doc_id", F.col("document").alias("text")))
    assert parsed.where("error is not null").count() == 0
    kinds = {(r.doc_id, r.id) for r in parsed.where("kind not in ('TASK', 'CONTEXT')").collect()}
    assert kinds == {(r.doc_id, m.id) for r in out.collect() for m in (r.marks or [])}


def test_without_a_library_and_structured(spark, compressed):
    _, _, library, docs, _ = compressed
    plain = cp.compress_with_library(docs, None)
    old = {r.doc_id: r for r in ex.extractive_compress(docs).collect()}
    for r in plain.collect():
        assert (r.task, r.compressed_tokens, r.tokens_saved) == (
            old[r.doc_id].task, old[r.doc_id].compressed_tokens, old[r.doc_id].tokens_saved)
    got = cp.compress_with_library(docs, library, structured=True)
    assert got.count() == docs.count() and got.where("size(marks) > 0").count() > 0


def test_walk_equals_the_plain_one(spark):
    """Step-wise walk and copies against the direct algorithm."""
    rng = random.Random(2)
    rows = []
    for d in range(40):
        rows.append((d, [(i, rng.randint(0, 9), rng.choice("abcdefgh") * rng.randint(1, 40)) for i in range(rng.choice([0, 1, 5, 127, 128, 129, 700]))],
                     rng.randint(0, 900)))
    rows = [(d, [(i, len(s) // 3, s) for i, _, s in items], t) for d, items, t in rows]
    df = spark.createDataFrame(rows, "d long, items array<struct<idx:int,tokens:long,same:string>>, target long")
    got = {r.d: r.w for r in df.select("d", ex.select_within_budget(ex.first_of_equal("items"), F.col("target")).alias("w")).collect()}
    for d, items, target in rows:
        picks, seen, total, dups = [], set(), 0, 0
        for i, n, s in items:
            if s in seen:
                dups += 1
            elif total + n <= target or not picks:
                picks.append(i)
                seen.add(s)
                total += n
        assert (got[d].picks, got[d].total, got[d].dups) == (sorted(picks), total, dups)


def test_phrases_consolidate_and_expand(spark):
    from promptspark.operators import text_ops as tx
    rng = random.Random(5)
    phrases = ["ab", "b]", "REF", "Normalize:", "aba", ":P"]
    bits = phrases + ["[REF:", "[REF::", "[REF:PHRASE_0]", "]", ":", "x", "\n", "ü"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(300)] + [(999, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("c", tx.consolidate("text", phrases)) \
        .withColumn("back", tx.expand_phrases("c.text", "c.refs"))
    some = 0
    for r in df.collect():
        assert r.back == r.text
        if r.text is not None:
            t, keys = r.text.replace("[REF:", "[REF::"), []
            for k, p in enumerate(phrases):
                if t.count(p) >= 3:
                    keys.append((f"PHRASE_{k}", p, t.count(p)))
                    t = t.replace(p, f"[REF:PHRASE_{k}]")
            assert r.c.text == t and [tuple(x) for x in r.c.refs] == keys
            some += bool(keys)
    assert some > 50
    with pytest.raises(ValueError):
        tx.consolidate("text", ["[REF:x"])


def test_structured_mode_expands_its_phrases(spark):
    text = "# Head\n" + "\n".join(f"Normalize: field {k} of the form, always." for k in range(6)) + "\n# Tail\nlast words here"
    df = spark.createDataFrame([(1, text)], DOCS)
    c = df.select(ex.compress_structured("text", F.lit(10_000)).alias("c")).first().c
    assert c.n_phrases == 1 and c.text == text and "[REF:" not in c.text
