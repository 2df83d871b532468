"""Documents, quality and judge parsing (reference unit values)."""

import pytest
from pyspark.sql import functions as F

from promptspark.operators import documents as dc
from promptspark.operators import judge as jg
from promptspark.operators import quality as q
from promptspark.operators import patterns as pt
from promptspark.operators import similarity as sm
from conftest import one

DOC = "@HIERATIC v1.0\n\n@ROLE[inline]\nYou are an expert.\n\n@FOCUS: performance, security\n\n@TASK\nDo something\n"


def _parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return dc.parse(df)


def test_parse(spark):
    rows = _parse(spark, [DOC]).orderBy("pos").collect()
    assert rows[0].version == "1.0"
    assert [(r.kind, r.id) for r in rows] == [("ROLE", "inline"), ("FOCUS", None), ("TASK", None)]
    assert rows[1]["items"] == ["performance", "security"] and rows[2].content == "Do something"


def test_validate(spark):
    parsed = _parse(spark, [DOC, "@HIERATIC v1.0\n\n@ROLE[inline]\nx\n"])
    rules = {(r.doc_id, r.rule) for r in dc.violations(parsed).collect()}
    assert rules == {(1, "Missing required @TASK section")}


def test_encode_parse_roundtrip(spark):
    secs = spark.createDataFrame([(0, 0, "ROLE", "role_001", None, None), (0, 1, "TASK", None, "Do it", None),
                                  (0, 2, "STYLE", None, None, ["a", "b"])], dc.section_schema())
    back = dc.parse(dc.encode(secs)).orderBy("pos").collect()
    assert [(r.kind, r.id, r.content, r["items"]) for r in back] == [
        ("ROLE", "role_001", None, None), ("TASK", None, "Do it", None), ("STYLE", None, None, ["a", "b"])]


def test_expand(spark):
    libdf = spark.createDataFrame([("role_001", "You are a careful reviewer.")], "id string, content string")
    parsed = _parse(spark, ["@HIERATIC v1.0\n\n@ROLE[role_001]\n\n@TASK\nReview\n",
                            "@HIERATIC v1.0\n\n@ROLE[nonexistent]\n\n@TASK\nReview\n"])
    got = {r.doc_id: (r.expanded, r.error) for r in dc.expand(parsed, libdf).collect()}
    assert got[0] == ("You are a careful reviewer.\n\nReview", None)
    assert got[1] == (None, "Context pattern not found: nonexistent")


def test_critical_and_structure(spark):
    o = "Extract it. Response format: JSON. Do not output XML. {\"a\": 1}"
    df = spark.createDataFrame([(o, o), (o, "Extract it.")], "o string, e string")
    found, kept = q.critical_counts("o", "e")
    rows = df.select(found.alias("f"), kept.alias("k"), q.structure_score("o", "e").alias("s")).collect()
    assert rows[0].f >= 2 and rows[0].k >= 2 and rows[0].s == 1.0 and rows[1].s == 0.5


def test_subsequence_shortcut_equals_levenshtein(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.length("text") < 2000)
    from promptspark.operators import extract as ex
    c = ex.extractive_compress(docs.select("doc_id", "text"))
    r = c.select(q.subsequence_similarity("text", "task").alias("a"),
                 sm.normalized_similarity("text", "task").alias("b")).collect()
    assert r and all(x.a == pytest.approx(x.b, abs=1e-12) for x in r)


def test_judge_json_and_text(spark):
    js = ('```json\n{"output_equivalence": 92.5, "instruction_compliance": 95, "information_completeness": 88,'
          ' "quality_preservation": 90, "overall_fidelity": 91, "justification": "ok",'
          ' "key_differences": ["minor"]}\n```')
    tx = "Output Equivalence: 85 / Instruction Compliance: 90 / Overall Fidelity: 87.5"
    df = spark.createDataFrame([(js,), (tx,), ("nothing here",)], "r string")
    rows = df.select(jg.parse_response("r").alias("p")).collect()
    a, b, c = (r.p for r in rows)
    assert (a.output_equivalence, a.instruction_compliance, a.overall_fidelity) == (92.5, 95.0, 91.0)
    assert a.key_differences == ["minor"] and a.source == "json"
    assert (b.output_equivalence, b.instruction_compliance, b.overall_fidelity) == (85.0, 90.0, 87.5)
    assert b.information_completeness == pytest.approx(52.5) and b.source == "text"
    assert c.error is not None


def test_model_names(spark):
    df = spark.createDataFrame([("gpt-4",), ("claude-3-sonnet",), ("openai/gpt-4",)], "m string")
    assert [r[0] for r in df.select(jg.normalize_model_name("m")).collect()] == [
        "openai/gpt-4", "anthropic/claude-3-sonnet", "openai/gpt-4"]


def test_library_statistics_and_prune(spark):
    lib = spark.createDataFrame([("a", "x", 5, 100, "role"), ("b", "y", 1, 200, "role")],
                                "id string, content string, frequency long, avg_tokens long, category string")
    overall = one(pt.library_statistics(lib).filter("category IS NULL"))
    assert (overall.total_patterns, overall.total_tokens, overall.avg_tokens_per_pattern) == (2, 300, 150)
    assert pt.prune(lib, 3).count() == 1


def test_incremental_blocks_equal_single_block(spark):
    """Two-level running sums give the same totals whatever the block size."""
    from promptspark.operators import conversations as cv
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    cols = ["conv_id", "turn", "n_anchors", "token_position_before", "total_tokens", "anchor_tokens_total",
            "compressed_tokens"]
    a = {tuple(r) for r in cv.incremental_rollup(conv, chunk=2).select(*cols).collect()}
    b = {tuple(r) for r in cv.incremental_rollup(conv).select(*cols).collect()}
    assert a and a == b
