"""Plans for the library profile and token/cost estimation (build step 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as lib
from ..operators import pricing
from ..sources.tables import table
from . import register
from .sqlsnip import norm_content, r6, tok

MONTHLY_INVOCATIONS = 1000
TOP_N = 10
CONTEXT_LIMIT = 2000

# Models used by the per-row and comparison plans: registry names, provider
# paths, aliases, tokenizer-only names, a wrong-case name and an unknown one.
MODEL_CYCLE = ["gpt-4", "openai/gpt-4", "gpt-4-turbo", "gpt-4-turbo-preview",
               "gpt-3.5-turbo-16k", "gemini-flash", "google/gemini-2.5-pro",
               "azure/gpt-4-32k", "GPT-4", "claude-3-opus"]

# Oracle side: the price each of those names must resolve to (worked out by
# hand from the lookup rules, not computed by the engine).
_EXPECTED_PRICES = """(SELECT model, inp::DOUBLE AS inp, outp::DOUBLE AS outp FROM (VALUES
  ('gpt-4', 0.03, 0.06), ('openai/gpt-4', 0.03, 0.06),
  ('gpt-4-turbo', 0.01, 0.03), ('gpt-4-turbo-preview', 0.01, 0.03),
  ('gpt-3.5-turbo-16k', 0.003, 0.004), ('gemini-flash', 0.000075, 0.0003),
  ('google/gemini-2.5-pro', 0.00125, 0.01), ('azure/gpt-4-32k', 0.03, 0.06),
  ('GPT-4', NULL, NULL), ('claude-3-opus', NULL, NULL)) AS v(model, inp, outp)) AS p"""


def _priced_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    return pricing.prompt_costs(docs, spark, model="gpt-4")


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@register("library_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS total_prompts,
       CAST(sum(tokens) AS BIGINT) AS total_tokens,
       {r6('sum(cost)')} AS total_cost,
       {r6(f'sum(cost) * {MONTHLY_INVOCATIONS}.0')} AS monthly_cost
FROM (SELECT {tok('text')} AS tokens,
             {tok('text')}::DOUBLE / 1000.0 * 0.03 + 100.0 / 1000.0 * 0.06 AS cost
      FROM documents)""")
def library_summary(spark, sf_dir):
    out = lib.library_totals(_priced_docs(spark, sf_dir).select("tokens", "total_cost"),
                             MONTHLY_INVOCATIONS)
    return _round(out, "total_cost", "monthly_cost")


@register("token_count", f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, {tok('text')} AS tokens FROM documents""")
def token_count(spark, sf_dir):
    from ..functions.tokens import approx4
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    return docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"),
                       approx4(F.col("text")).alias("tokens"))


@register("token_histogram", f"""
WITH t AS (SELECT {tok('text')} AS tokens FROM documents),
b AS (SELECT CASE WHEN tokens <= 100 THEN 100 WHEN tokens <= 500 THEN 500
                  WHEN tokens <= 1000 THEN 1000 WHEN tokens <= 5000 THEN 5000
                  WHEN tokens <= 10000 THEN 10000 WHEN tokens <= 50000 THEN 50000 END AS bucket_max
      FROM t)
SELECT bucket_max, CAST(count(*) AS BIGINT) AS prompts,
       CASE bucket_max WHEN 100 THEN '0-100' WHEN 500 THEN '101-500' WHEN 1000 THEN '501-1000'
            WHEN 5000 THEN '1001-5000' WHEN 10000 THEN '5001-10000'
            WHEN 50000 THEN '10001-50000' ELSE '50K+' END AS bucket_label
FROM b GROUP BY bucket_max""")
def token_histogram(spark, sf_dir):
    return lib.token_histogram(_priced_docs(spark, sf_dir).select("tokens"))


@register("top_expensive", f"""
SELECT doc_id, tokens, cost AS total_cost FROM (
  SELECT doc_id, {tok('text')} AS tokens,
         {tok('text')}::DOUBLE / 1000.0 * 0.03 + 100.0 / 1000.0 * 0.06 AS cost FROM documents)
ORDER BY cost DESC, doc_id LIMIT {TOP_N}""")
def top_expensive(spark, sf_dir):
    return lib.top_expensive(_priced_docs(spark, sf_dir).select("doc_id", "tokens", "total_cost"),
                             TOP_N)


@register("over_limit", f"""
SELECT doc_id, tokens, tokens - {CONTEXT_LIMIT} AS excess
FROM (SELECT doc_id, {tok('text')} AS tokens FROM documents) WHERE tokens > {CONTEXT_LIMIT}""")
def over_limit(spark, sf_dir):
    from ..functions.tokens import approx4
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    return lib.over_limit(docs.select("doc_id", approx4(F.col("text")).alias("tokens")),
                          CONTEXT_LIMIT)


@register("exact_duplicates", f"""
WITH k AS (SELECT doc_id, {norm_content('text')} AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, min(doc_id) AS group_id FROM k
      GROUP BY norm HAVING count(*) > 1)
SELECT k.doc_id, g.group_id, CAST(g.group_size AS BIGINT) AS group_size
FROM k JOIN g ON k.norm = g.norm""")
def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    return lib.exact_duplicates(docs)


def _model_of_source():
    """Assign each document a model name by its source number (a mapping,
    every row kept)."""
    arr = F.array(*[F.lit(m) for m in MODEL_CYCLE])
    idx = F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(len(MODEL_CYCLE)))
    return F.element_at(arr, idx + 1)


_SQL_MODEL_OF_SOURCE = (
    "[" + ", ".join(f"'{m}'" for m in MODEL_CYCLE) + "]"
    f"[(CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % {len(MODEL_CYCLE)}) + 1]")


@register("prompt_cost", f"""
WITH d AS (SELECT doc_id, {_SQL_MODEL_OF_SOURCE} AS model, {tok('text')} AS tokens FROM documents)
SELECT d.doc_id, d.model, d.tokens,
       d.tokens::DOUBLE / 1000.0 * p.inp AS input_cost,
       d.tokens::DOUBLE / 1000.0 * p.outp AS output_cost
FROM d LEFT JOIN {_EXPECTED_PRICES} ON d.model = p.model""")
def prompt_cost(spark, sf_dir):
    from ..functions.tokens import approx4
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", busy=True)
    rows = docs.select("doc_id", _model_of_source().alias("model"),
                       approx4(F.col("text")).alias("tokens"))
    return pricing.estimate_costs(rows, spark, "model", "tokens")


@register("model_compare", f"""
WITH d AS (SELECT doc_id, {tok('text')} AS tokens FROM documents)
SELECT d.doc_id, p.model, d.tokens,
       d.tokens::DOUBLE / 1000.0 * p.inp AS input_cost,
       d.tokens::DOUBLE / 1000.0 * p.outp AS output_cost
FROM d CROSS JOIN {_EXPECTED_PRICES}""")
def model_compare(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    return pricing.compare_models(docs, spark, MODEL_CYCLE).drop("text")


@register("role_breakdown", f"""
SELECT conv_id,
  CAST(sum(CASE WHEN role = 'system' THEN {tok('text')} ELSE 0 END) AS BIGINT) AS system,
  CAST(sum(CASE WHEN role = 'user' THEN {tok('text')} ELSE 0 END) AS BIGINT) AS "user",
  CAST(sum(CASE WHEN role = 'assistant' THEN {tok('text')} ELSE 0 END) AS BIGINT) AS assistant,
  CAST(sum({tok('text')}) AS BIGINT) AS total
FROM conversations GROUP BY conv_id""")
def role_breakdown(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations", "conv_id", "role", "text", busy=True)
    return lib.role_breakdown(conv)
