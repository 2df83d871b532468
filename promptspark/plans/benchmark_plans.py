"""Plans for the benchmark matrix and corpus reports (build step 8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import approx4
from ..operators import benchmark as bm
from ..operators import library as lib
from ..operators import pricing
from ..operators.extract import LEVEL_RATIO
from ..session import ensure_checkpoint_dir
from ..sources.tables import table
from . import register
from .compress_plans import compressed_documents, sql_compress, sql_quality
from .sqlsnip import tok

ROUND = 6


def matrix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", busy=True)
    return bm.run_matrix(docs.withColumnRenamed("lang", "category"))


def _sql_matrix() -> str:
    """Every cell of the matrix compressed on its own, with its mode's scores."""
    parts = []
    for i, lv in enumerate(bm.LEVELS):
        for j, mode in enumerate(bm.SCORINGS):
            parts.append(f"""c{i}{j} AS (WITH {sql_quality(LEVEL_RATIO[lv], mode)},
  fin AS (SELECT *, semantic_similarity * 0.4 + critical_instruction_preservation * 0.3
                    + information_retention * 0.2 + structural_integrity * 0.1 AS overall_score FROM qq)
  SELECT z.doc_id, '{lv}' AS compression_level, '{mode}' AS scoring_mode, CAST({i * 3 + j} AS INTEGER) AS config,
         z.original_tokens >= 50 AS success, z.original_tokens, z.compressed_tokens, z.tokens_saved,
         CASE WHEN z.original_tokens > 0 THEN z.tokens_saved::DOUBLE / z.original_tokens
              ELSE 0.0 END AS compression_ratio,
         fin.overall_score, fin.semantic_similarity, fin.information_retention, fin.structural_integrity,
         fin.critical_instruction_preservation
  FROM z JOIN fin ON z.doc_id = fin.doc_id)""")
    cells = " UNION ALL ".join(f"SELECT * FROM c{i}{j}" for i in range(len(bm.LEVELS)) for j in range(len(bm.SCORINGS)))
    return "WITH " + ",\n".join(parts) + f""",
rows AS (SELECT d.lang AS category, a.* FROM ({cells}) a JOIN documents d ON d.doc_id = a.doc_id),
m AS (SELECT * FROM rows WHERE success)"""


SQL_MATRIX = _sql_matrix()


@register("benchmark_matrix", SQL_MATRIX + """
SELECT doc_id, category, config, compression_level, scoring_mode, success,
       CASE WHEN NOT success THEN 'too short to compress' END AS reason, original_tokens,
       CASE WHEN success THEN compressed_tokens END AS compressed_tokens,
       CASE WHEN success THEN tokens_saved END AS tokens_saved,
       CASE WHEN success THEN compression_ratio END AS compression_ratio,
       CASE WHEN success THEN compression_ratio * 100.0 END AS compression_percentage,
       CASE WHEN success THEN overall_score END AS overall_score,
       CASE WHEN success THEN semantic_similarity END AS semantic_similarity,
       CASE WHEN success THEN information_retention END AS information_retention,
       CASE WHEN success THEN structural_integrity END AS structural_integrity,
       CASE WHEN success THEN critical_instruction_preservation END AS critical_instruction_preservation
FROM rows""")
def benchmark_matrix(spark, sf_dir):
    return matrix(spark, sf_dir)


@register("benchmark_summary", SQL_MATRIX + """
SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed,
       count(*) FILTER (WHERE success) / count(*) * 100.0 AS success_rate,
       count(*) FILTER (WHERE NOT success) AS too_short
FROM rows""")
def benchmark_summary(spark, sf_dir):
    """Run totals and success rate of the matrix."""
    return bm.run_summary(matrix(spark, sf_dir))


def _sql_stat(m: str) -> str:
    return (f"round(avg({m}), {ROUND}) AS {m}_mean, round(median({m}), {ROUND}) AS {m}_median, "
            f"round(min({m}), {ROUND}) AS {m}_min, round(max({m}), {ROUND}) AS {m}_max, "
            f"round(coalesce(stddev_samp({m}), 0.0), {ROUND}) AS {m}_std")


SQL_STATS = SQL_MATRIX + f""",
ok AS (SELECT category, compression_level, scoring_mode, compression_ratio * 100.0 AS compression_percentage,
              tokens_saved::DOUBLE AS tokens_saved, overall_score * 100.0 AS overall_score_pct FROM m),
st AS (SELECT CASE WHEN category IS NOT NULL THEN 'category' WHEN compression_level IS NOT NULL THEN 'level'
                   WHEN scoring_mode IS NOT NULL THEN 'scoring' ELSE 'overall' END AS dimension,
              coalesce(category, compression_level, scoring_mode, 'all') AS key, count(*) AS count,
              {", ".join(_sql_stat(m) for m in bm.METRICS)}
       FROM ok GROUP BY GROUPING SETS ((category), (compression_level), (scoring_mode), ()))"""


def _stats(rows):
    st = bm.stats(rows)
    for c in st.columns:
        if c.endswith(("_mean", "_median", "_min", "_max", "_std")):
            st = st.withColumn(c, F.round(c, ROUND))
    return st


@register("benchmark_stats", SQL_STATS + "\nSELECT * FROM st")
def benchmark_stats(spark, sf_dir):
    return _stats(matrix(spark, sf_dir))


@register("benchmark_recommend", SQL_STATS + """,
rk AS (SELECT *, compression_percentage_mean * 0.6 + overall_score_pct_mean * 0.4 AS s,
              CASE key WHEN 'light' THEN 0 WHEN 'medium' THEN 1 WHEN 'aggressive' THEN 2
                       WHEN 'heuristic' THEN 0 WHEN 'semantic' THEN 1 WHEN 'hybrid' THEN 2 END AS r
       FROM st WHERE dimension IN ('level', 'scoring')),
b AS (SELECT arg_max(key, (s, -r)) FILTER (WHERE dimension = 'level') AS best_level,
             arg_max(key, (s, -r)) FILTER (WHERE dimension = 'scoring') AS best_scoring FROM rk),
o AS (SELECT greatest(30.0, compression_percentage_mean * 0.7) AS min_compression,
             greatest(60.0, overall_score_pct_mean * 0.85) AS min_quality,
             compression_percentage_mean * 0.8 AS target_compression_low,
             compression_percentage_mean * 1.2 AS target_compression_high,
             overall_score_pct_mean * 0.9 AS target_quality_low FROM st WHERE dimension = 'overall'),
bw AS (SELECT arg_max(doc_id, (compression_ratio, -doc_id, -config)) AS best_doc,
              arg_max(config, (compression_ratio, -doc_id, -config)) AS best_config,
              arg_min(doc_id, (compression_ratio, -doc_id, -config)) AS worst_doc,
              arg_min(config, (compression_ratio, -doc_id, -config)) AS worst_config FROM m)
SELECT * FROM b, o, bw""")
def benchmark_recommend(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    rows = matrix(spark, sf_dir).checkpoint()  # narrow records, read by the statistics and the extremes
    rec = bm.recommend(_stats(rows), rows)
    return rec.select("best_level", "best_scoring", "min_compression", "min_quality", "target_compression_low",
                      "target_compression_high", "target_quality_low",
                      F.col("best_run.doc_id").alias("best_doc"), F.col("best_run.config").alias("best_config"),
                      F.col("worst_run.doc_id").alias("worst_doc"), F.col("worst_run.config").alias("worst_config"))


@register("prompt_diff", "WITH " + sql_compress() + f"""
SELECT d.doc_id, {tok('d.text')} AS tokens_a, z.compressed_tokens - 10 AS tokens_b,
       z.compressed_tokens - 10 - {tok('d.text')} AS token_delta,
       abs((z.compressed_tokens - 10)::DOUBLE / 1000.0 * 0.03 - {tok('d.text')}::DOUBLE / 1000.0 * 0.03)
         AS cost_delta
FROM documents d FULL OUTER JOIN (SELECT * FROM z WHERE n_sentences > 0) z ON d.doc_id = z.doc_id""")
def prompt_diff(spark, sf_dir):
    """Each document against its compressed task (present only for the
    documents that were actually compressed), priced with gpt-4 input."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    a = docs.select("doc_id", approx4(F.col("text")).alias("tokens"))
    c = compressed_documents(spark, sf_dir).filter(F.col("n_sentences") > 0)
    b = c.select("doc_id", approx4(F.col("task")).alias("tokens"))
    return bm.diff(a, b, "doc_id", pricing.DEFAULT_MODELS[0][2])


@register("corpus_metadata", """
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, array_to_string(list_sort(list_distinct(list(source))), ',')
         AS sources
FROM documents GROUP BY lang""")
def corpus_metadata(spark, sf_dir):
    """Documents per language and the distinct sources seen (bounded)."""
    docs = table(spark, sf_dir, "documents", "lang", "source")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"),
                                    F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@register("insights_json")
def insights_json(spark, sf_dir):
    """The library profile as one JSON document (totals, histogram,
    top 10, over-limit count, duplicate groups)."""
    from .library_plans import CONTEXT_LIMIT, MONTHLY_INVOCATIONS, TOP_N
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    priced = pricing.prompt_costs(docs, spark).select("doc_id", "tokens", "total_cost")
    totals = lib.library_totals(priced, MONTHLY_INVOCATIONS)
    hist = lib.token_histogram(priced).agg(F.array_sort(F.collect_list(
        F.struct(F.coalesce("bucket_max", F.lit(1 << 62)).alias("max"), "bucket_label", "prompts"))).alias("h"))
    top = lib.top_expensive(priced, TOP_N).agg(F.array_sort(F.collect_list(
        F.struct(F.negative("total_cost").alias("k"), "doc_id", "tokens", "total_cost"))).alias("top"))
    over = lib.over_limit(priced, CONTEXT_LIMIT).agg(F.count(F.lit(1)).alias("exceeded"))
    dups = lib.exact_duplicates(docs).agg(F.countDistinct("group_id").alias("duplicate_groups"))
    one = totals.crossJoin(hist).crossJoin(top).crossJoin(over).crossJoin(dups)  # one-row frames
    return one.select(F.to_json(F.struct(
        "total_prompts", "total_tokens", "total_cost", "monthly_cost",
        F.transform("h", lambda x: F.struct(x.bucket_label.alias("bucket"), x.prompts.alias("count")))
        .alias("token_distribution"),
        F.transform("top", lambda x: F.struct(x.doc_id.alias("id"), x.tokens.alias("tokens"),
                                              x.total_cost.alias("cost"))).alias("top_expensive"),
        "exceeded", "duplicate_groups")).alias("json"))


@register("pricing_override", f"""
WITH p AS (SELECT model, inp::DOUBLE AS inp, outp::DOUBLE AS outp FROM (VALUES
  ('gpt-4', 0.02, 0.04), ('openai/gpt-4', 0.02, 0.04), ('gpt-4o', 0.005, 0.015),
  ('openai/gpt-4o', 0.005, 0.015), ('gemini-flash', 0.000075, 0.0003)) AS v(model, inp, outp)),
d AS (SELECT doc_id, ['gpt-4', 'openai/gpt-4', 'gpt-4o', 'openai/gpt-4o', 'gemini-flash']
        [(CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 5) + 1] AS model, {tok('text')} AS tokens
      FROM documents)
SELECT d.doc_id, d.model, d.tokens, d.tokens::DOUBLE / 1000.0 * p.inp AS input_cost,
       d.tokens::DOUBLE / 1000.0 * p.outp AS output_cost
FROM d LEFT JOIN p ON d.model = p.model""")
def pricing_override(spark, sf_dir):
    """A pricing file overrides gpt-4 and adds gpt-4o; later upserts win
    on every key (model, provider/model, lower-case model)."""
    overrides = [("openai", "gpt-4", 0.02, 0.04), ("openai", "gpt-4o", 0.005, 0.015)]
    models = pricing.models_table(spark, overrides)
    names = ["gpt-4", "openai/gpt-4", "gpt-4o", "openai/gpt-4o", "gemini-flash"]
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", busy=True)
    idx = F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(len(names)))
    rows = docs.select("doc_id", F.element_at(F.array(*[F.lit(n) for n in names]), idx + 1).alias("model"),
                       approx4(F.col("text")).alias("tokens"))
    return pricing.estimate_costs(rows, spark, "model", "tokens", models)
