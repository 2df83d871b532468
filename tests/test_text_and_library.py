"""Unit values from the reference's analyzer, similarity and compressor tests."""

import pytest
from pyspark.sql import functions as F

from promptspark.functions.text import normalize_content, normalize_text
from promptspark.functions.tokens import approx4
from promptspark.operators import extract as ex
from promptspark.operators import library as lib
from promptspark.operators import pricing
from promptspark.operators import text_ops as tx
from conftest import one


def test_normalize_content(spark):
    df = spark.createDataFrame([("  Hello  \n\n  World  \n",), ("   \n\n  \n",)], "t string")
    assert [r[0] for r in df.select(normalize_content("t")).collect()] == ["hello\nworld", ""]


def test_normalize_text(spark):
    df = spark.createDataFrame([("Test\n\nMultiple\tWhitespace",)], "t string")
    assert one(df.select(normalize_text("t")))[0] == "test multiple whitespace"


def test_approx_tokens(spark):
    df = spark.createDataFrame([("Hello, world!",), ("",)], "t string")
    assert [r[0] for r in df.select(approx4(F.col("t"))).collect()] == [4, 0]


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "other"),
                                (4, "  line a\n\nline b "), (5, "line a\nline b")], "doc_id long, text string")
    groups = {(r.doc_id, r.group_id, r.group_size) for r in lib.exact_duplicates(df).collect()}
    assert groups == {(1, 1, 2), (2, 1, 2), (4, 4, 2), (5, 4, 2)}


def test_histogram(spark):
    df = spark.createDataFrame([(t,) for t in (50, 150, 600, 2000, 60000)], "tokens long")
    got = {(r.bucket_max, r.bucket_label, r.prompts) for r in lib.token_histogram(df).collect()}
    assert got == {(100, "0-100", 1), (500, "101-500", 1), (1000, "501-1000", 1),
                   (5000, "1001-5000", 1), (None, "50K+", 1)}


def test_library_totals(spark):
    df = spark.createDataFrame([(100, 0.01), (200, 0.02), (300, 0.03)], "tokens long, total_cost double")
    r = one(lib.library_totals(df, 1000))
    assert (r.total_prompts, r.total_tokens) == (3, 600)
    assert r.total_cost == pytest.approx(0.06) and r.monthly_cost == pytest.approx(60.0)
    top = lib.top_expensive(df.withColumn("doc_id", F.col("tokens")), 2).collect()
    assert [t.tokens for t in top] == [300, 200]


def test_savings(spark):
    df = spark.createDataFrame([(1000, 200)], "o long, c long")
    cols = pricing.savings("o", "c", 0.01, 1000)
    r = one(df.select(*[v.alias(k) for k, v in cols.items()]))
    assert (r.original_cost, r.compressed_cost, r.savings) == pytest.approx((10.0, 2.0, 8.0))


def test_price_override_and_aliases(spark):
    models = pricing.models_table(spark, [("openai", "gpt-4", 0.02, 0.04)])
    reg = pricing.registry(models)
    df = spark.createDataFrame([("openai/gpt-4",), ("gpt-4",), ("gpt-4-turbo-preview",), ("nope",)], "m string")
    got = {r.m: (r.input_per_1k, r.output_per_1k) for r in
           pricing.with_prices(df, "m", reg, pricing.tokenizer_prices(spark)).collect()}
    assert got["openai/gpt-4"] == (0.02, 0.04) and got["gpt-4"] == (0.02, 0.04)
    assert got["gpt-4-turbo-preview"] == (0.01, 0.03) and got["nope"] == (None, None)


def test_price_lookup_is_broadcast(spark):
    df = spark.createDataFrame([(1, "x" * 40)], "doc_id long, text string")
    plan = pricing.prompt_costs(df, spark)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan or "Broadcast" in plan


def test_categorize(spark):
    df = spark.createDataFrame([("You are an expert developer",), ("Example: Fixed a bug",),
                                ("You must not use profanity",), ("Plain words",)], "t string")
    assert [r[0] for r in df.select(tx.categorize("t")).collect()] == ["role", "examples", "constraints", "general"]


def test_score_order(spark):
    df = spark.createDataFrame([("This is important to analyze",), ("Just a simple sentence",)], "t string")
    assert [r[0] for r in df.select(ex.heuristic_score("t")).collect()] == [5.0, 0.5]


def test_sentences_line_rules(spark):
    text = "First line ends here.\n- bullet\nshort\nA much longer line without punctuation\n..."
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(ex.sentences("t")))[0] == [
        "First line ends here.", "- bullet short", "A much longer line without punctuation"]


def test_strip_tags(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p> > c <br",)], "h string")
    assert one(df.select(tx.strip_tags("h")))[0] == "a & b  c "


def test_compression_is_ordered_subset(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = ex.extractive_compress(docs).select("text", "task", "n_sentences", "target_tokens",
                                              "compressed_tokens").collect()
    for r in out:
        if r.n_sentences:
            pos = 0
            for piece in r.task.split(" "):
                found = r.text.find(piece, pos)
                assert found >= 0
                pos = found + len(piece)
