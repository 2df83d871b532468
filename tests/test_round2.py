"""Cases that earlier rows did not reach."""

import json

import pytest
from conftest import one
from pyspark.sql import functions as F

from promptspark.operators import benchmark, conversations, extract, judge, patterns, requests, text_ops, vectors
from promptspark.streaming import jobs

SCORES = '"output_equivalence": 80, "instruction_compliance": 81, "information_completeness": 82, ' \
         '"quality_preservation": 83, "overall_fidelity": 84'


@pytest.mark.parametrize("answer, differences", [
    ('```\n{%s, "justification": "j", "key_differences": ["a"]}\n```' % SCORES, ["a"]),
    ('```json\n{%s, "justification": "j", "key_differences": ["a", 3, null, "b"]}\n``` and ```json\n{}\n```' % SCORES,
     ["a", "b"]),
    ('{%s, "justification": "j", "key_differences": "none"}' % SCORES, []),
])
def test_judge_answers(spark, answer, differences):
    r = one(spark.createDataFrame([(answer,)], "r string").select(judge.parse_response("r").alias("p"))).p
    assert (r.source, r.overall_fidelity, r.justification, r.key_differences) == ("json", 84.0, "j", differences)


def test_first_usable_choice(spark):
    body = json.dumps({"choices": [{"text": None}, {"message": {"content": 5}}, {"message": {"content": "good"}}, {"text": "x"}]})
    r = one(spark.createDataFrame([(body,)], "b string").select(requests.normalize_response("b").alias("r"))).r
    assert r.content == "good"


def test_chat_with_other_keys(spark):
    rows = [(1, '[{"role": "user", "content": "hi", "max_content": 5}]'), (2, '{"role": "user", "content": "hi", "x_role": 1}'),
            (3, '[{"role": "user", "content": 5}]'), (4, '[{"role": "user"}]')]
    got = {r.i: [tuple(m) for m in r.m] for r in spark.createDataFrame(rows, "i int, t string").select(
        "i", text_ops.parse_messages("t").alias("m")).collect()}
    assert got[1] == got[2] == [("user", "hi")]
    assert got[3] == [("user", rows[2][1])] and got[4] == [("user", rows[3][1])]


def test_lines_may_begin_with_any_character(spark):
    text = "This is a whole line, long enough.\n\u0001 Another line that is long enough.\nshort bit"
    got = one(spark.createDataFrame([(text,)], "t string").select(extract.line_units("t").alias("u"))).u
    assert got == ["This is a whole line, long enough.", "\u0001 Another line that is long enough. short bit"]


def test_null_keys_are_not_totals(spark):
    rows = [("a", "light", "heuristic"), (None, "light", "heuristic")]
    df = spark.createDataFrame(rows, "category string, compression_level string, scoring_mode string").select(
        "*", F.lit(True).alias("success"), F.lit(10.0).alias("compression_percentage"), F.lit(5).alias("tokens_saved"),
        F.lit(0.5).alias("overall_score"))
    got = sorted((r.dimension, str(r.key), r["count"]) for r in benchmark.stats(df).collect())
    assert got == [("category", "None", 1), ("category", "a", 1), ("level", "light", 2), ("overall", "all", 2),
                   ("scoring", "heuristic", 2)]
    lib = spark.createDataFrame([("a", 4), (None, 6)], "category string, avg_tokens long")
    got = sorted((str(r.category), r.is_total, r.total_patterns) for r in patterns.library_statistics(lib).collect())
    assert got == [("None", False, 1), ("None", True, 2), ("a", False, 1)]


def test_embedding_reads_every_word(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b c d f",), ("",)], "t string")
    v = [r.v for r in df.select(vectors.hash_embed("t", 3).alias("v")).collect()]
    assert v[0] != v[1] and v[2] == [0.0, 0.0, 0.0] and abs(sum(x * x for x in v[0]) - 1) < 1e-9


def test_harvest_limits_are_off(spark):
    fence = "```text\n%s\n```"
    many = "\n".join(fence % (c * 60) for c in "abcdefgh") + "\n" + fence % ("z" * 9000)
    df = spark.createDataFrame([(1, many)], "id int, c string")
    assert text_ops.harvest_prompts(df, "id", "c").count() == 9
    assert text_ops.harvest_prompts(df, "id", "c", per_file=5, fence_max=5000).count() == 5
    assert text_ops.harvest_prompts(df, "id", "c", max_file_bytes=100).count() == 0


def conversation(spark):
    text = "You must analyze this. It is an important sentence of some length here. " * 60
    return spark.createDataFrame([(1, t, "user", text + str(t)) for t in range(6)] + [(2, 0, "user", "short")],
                                 "conv_id long, turn long, role string, text string").coalesce(1)


def test_stream_takes_late_turns_and_restarts(spark, tmp_path):
    turns = conversation(spark)
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    schema = "conv_id long, turn long, role string, text string"
    for part in ("conv_id = 1 AND turn IN (0, 2)", "turn = 1", "turn > 3 OR conv_id = 2", "turn = 3"):
        turns.where(part).write.mode("append").parquet(source)  # several files, turns out of order
        got = jobs.run_incremental(spark, source, "*.parquet", schema, run_dir=run)
    want = conversations.incremental_rollup(turns).drop("anchor_ratio")
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(got) == key(want) and got.count() == 7


def test_sliding_and_session_windows(spark, tmp_path):
    schema = "user string, ts timestamp, success boolean, latency_ms double"

    def add(rows):
        spark.createDataFrame(rows, "user string, t string, success boolean, latency_ms double").select(
            "user", F.to_timestamp("t").alias("ts"), "success", "latency_ms").coalesce(1).write.mode("append").parquet(src)

    def run(folder, **kw):
        return jobs.run_request_metrics(spark, jobs.file_stream(spark, src, "*.parquet", schema), str(tmp_path / folder), **kw)

    src = str(tmp_path / "in")
    add([("u", "2026-01-01 00:10:00", True, 5.0), ("u", "2026-01-01 00:40:00", False, 7.0), ("u", "2026-01-01 03:00:00", True, 9.0),
         ("v", "2026-01-01 00:50:00", True, 9.0)])
    assert sorted(r.completed for r in run("a", slide="30 minutes").collect()) == [1, 1, 1, 2, 3]
    add([("w", "2026-01-03 00:00:00", True, 1.0)])  # passes the watermark over the sessions so far
    gaps = run("b", session_gap="1 hour", keys=("user",))
    assert sorted((r.user, r.completed, r.failed) for r in gaps.collect()) == [("u", 1, 0), ("u", 2, 1), ("v", 1, 0)]


def test_empty_documents_fail_validation(spark):
    from promptspark.operators import documents
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "@HIERATIC v1.0\n\n@TASK\nDo it.")], "doc_id long, text string")
    parsed = documents.parse(docs)
    rules = {}
    for r in documents.violations(parsed).collect():
        rules.setdefault(r.doc_id, []).append(r.rule)
    assert set(rules) == {1, 2} and all(len(v) == 2 for v in rules.values())
    lib = spark.createDataFrame([], "id string, content string")
    got = {r.doc_id: (r.expanded, r.error) for r in documents.expand(parsed, lib).collect()}
    assert got[3] == ("Do it.", None) and got[1][0] is None and got[1][1] and got[2][1]


def test_scoring_modes_differ_and_fall_back(spark):
    cfg = extract.CompressionConfig
    text = "You must keep this. " + ". ".join(f"word{k} other{k} thing{k} plain{k}" for k in range(60)) + "."
    df = spark.createDataFrame([(text.replace(". ", ".\n"),)], "text string")
    tasks = {m: one(extract.extractive_compress(df, config=cfg(scoring=m, level="aggressive"))).task for m in extract.SCORINGS}
    assert len(set(tasks.values())) > 1
    null = cfg(scoring="semantic", level="aggressive", embed=lambda c: F.lit(None).cast("array<double>"))
    assert one(extract.extractive_compress(df, config=null)).task == tasks["heuristic"]
