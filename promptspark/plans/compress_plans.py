"""Plans for extractive compression and its quality (build step 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as ex
from ..operators import pricing
from ..operators import quality as q
from ..operators import text_ops as tx
from ..operators import vectors as vc
from ..sources.tables import table
from . import register
from .sqlsnip import norm_text, tok
from .text_plans import SQL_SENTENCES, _WS, _sql_density, _sql_score

LEVEL = "medium"
RATIO = ex.LEVEL_RATIO[LEVEL]
INPUT_PRICE = 0.03        # gpt-4 input $/1K
MONTHLY_INVOCATIONS = 1000


def compressed_documents(spark, sf_dir, config: ex.CompressionConfig | None = None):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    return ex.extractive_compress(docs, "text", config or ex.CompressionConfig(level=LEVEL))


def sql_cosine(e: str, dim: int) -> str:
    """Highest cosine of a sentence to the critical phrases, words weighted by
    their MD5 and folded into ``dim`` places (0 for a sentence without words)."""
    refs = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in vc.hash_embed_values(p, dim)) + "]"
                           for p in q.CRITICAL_PATTERNS) + "]"
    weights = (f"list_transform(list_filter(string_split_regex(trim(lower({e}), {_WS}), '\\s+'), lambda w: w <> ''), "
               "lambda w: ((('0x' || substr(md5(w), 1, 8))::BIGINT % 10000)::DOUBLE / 10000.0::DOUBLE * 2.0 - 1.0) * 0.05::DOUBLE)")
    vec = (f"list_transform([{weights}], lambda ws: list_transform(range(0, {dim}), lambda p: "
           f"coalesce(list_sum(list_filter(ws, lambda x, k: (k - 1) % {dim} = p)), 0.0::DOUBLE)))[1]")
    return (f"list_transform([{vec}], lambda v: CASE WHEN list_dot_product(v, v) > 0 THEN "
            f"list_max(list_transform({refs}, lambda r: list_dot_product(v, r))) / sqrt(list_dot_product(v, v)) "
            "ELSE 0.0::DOUBLE END)[1]")


def _sql_semantic(e: str) -> str:
    """Semantic score of one sentence: cosine (at least 0), density, middle position."""
    cos = f"greatest(0.0::DOUBLE, {sql_cosine(e, ex.EMBED_DIM)})"
    return f"({cos} * 50.0 + {_sql_density(e)} * 20.0 + 0.5)"


def _sql_key(e: str, scoring: str) -> str:
    h = _sql_score(e, ex.REFERENCE_RULES)
    return {"heuristic": h, "semantic": f"round({_sql_semantic(e)}, {ex.SCORE_DECIMALS})",
            "hybrid": f"round({_sql_semantic(e)} * 0.7 + {h} * 0.3, {ex.SCORE_DECIMALS})"}[scoring]


# Oracle: the same pipeline written with DuckDB list functions; the greedy
# budget walk is a list_reduce over the score-sorted sentence structs of a CTE
# ``g`` holding (sents, tgt).
_FOLD = f"""w AS (SELECT *, list_reduce(list_sort(list_transform(sents, lambda e, i: {{
          'k': -(__SCORE__), 'idx': i - 1, 'tokens': {tok('e')},
          'norm': lower(trim(e, {_WS}))}})),
        lambda acc, x: CASE
          WHEN list_contains(acc.norms, x.norm)
            THEN {{'picks': acc.picks, 'norms': acc.norms, 'total': acc.total, 'dups': acc.dups + 1}}
          WHEN acc.total + x.tokens <= tgt OR len(acc.picks) = 0
            THEN {{'picks': list_append(acc.picks, x.idx), 'norms': list_append(acc.norms, x.norm),
                  'total': acc.total + x.tokens, 'dups': acc.dups}}
          ELSE acc END,
        {{'picks': []::INTEGER[], 'norms': []::VARCHAR[], 'total': 0::BIGINT, 'dups': 0}}) AS fo
      FROM g),
"""

SQL_FOLD = _FOLD.replace("__SCORE__", _sql_key("e", "heuristic"))


def sql_compress(ratio: float = RATIO, scoring: str = "heuristic") -> str:
    return _SQL_COMPRESS_TMPL.replace("__RATIO__", repr(float(ratio))).replace("__SCORE__", _sql_key("e", scoring))


_SQL_COMPRESS_TMPL = SQL_SENTENCES + f""",
d AS (SELECT doc_id, text, {tok('text')} AS orig FROM documents),
g AS (SELECT d.doc_id, d.text, d.orig,
             CAST(floor(d.orig::DOUBLE * (1.0::DOUBLE - __RATIO__::DOUBLE)) AS BIGINT) AS tgt, s.sents
      FROM d JOIN s ON d.doc_id = s.doc_id),
{_FOLD}r AS (SELECT *, orig < 50 AS gated, orig <= tgt AS already,
        CASE WHEN len(sents) = 0 THEN text ELSE array_to_string(
          list_transform(list_sort(fo.picks), lambda i: sents[i + 1]), ' ') END AS joined
      FROM w),
c AS (SELECT *, CASE WHEN gated THEN text WHEN already THEN trim(text, {_WS})
                     ELSE trim(joined, {_WS}) END AS task FROM r),
o AS (SELECT doc_id, text, task, orig AS original_tokens,
        CASE WHEN gated THEN NULL ELSE tgt END AS target_tokens,
        CAST(CASE WHEN gated OR already THEN 0 ELSE len(sents) END AS INTEGER) AS n_sentences,
        CAST(CASE WHEN gated OR already THEN 0 ELSE len(fo.picks) END AS INTEGER) AS n_selected,
        CAST(CASE WHEN gated OR already THEN 0 ELSE fo.dups END AS INTEGER) AS redundant_removed,
        CAST(CASE WHEN gated OR already THEN 0 ELSE greatest(strlen(text) - strlen(joined), 0) END
             AS INTEGER) AS low_relevance_removed,
        10 + {tok('task')} AS compressed_tokens
      FROM c),
z AS (SELECT *, CAST(greatest(original_tokens - compressed_tokens, 0) AS BIGINT) AS tokens_saved FROM o)"""
SQL_COMPRESS = sql_compress()


@register("extractive_compress", "WITH " + SQL_COMPRESS + """
SELECT doc_id, original_tokens, target_tokens, n_sentences, n_selected, redundant_removed,
       low_relevance_removed, compressed_tokens, tokens_saved,
       CASE WHEN original_tokens > 0 THEN tokens_saved::DOUBLE / original_tokens ELSE 0.0 END
         AS compression_ratio, task
FROM z""")
def extractive_compress(spark, sf_dir):
    return compressed_documents(spark, sf_dir).select(
        "doc_id", "original_tokens", "target_tokens", "n_sentences", "n_selected",
        "redundant_removed", "low_relevance_removed", "compressed_tokens", "tokens_saved",
        "compression_ratio", "task")


@register("savings", "WITH " + SQL_COMPRESS + f""",
s2 AS (SELECT doc_id,
         original_tokens::DOUBLE / 1000.0 * {INPUT_PRICE}::DOUBLE * {MONTHLY_INVOCATIONS}.0::DOUBLE AS oc,
         compressed_tokens::DOUBLE / 1000.0 * {INPUT_PRICE}::DOUBLE * {MONTHLY_INVOCATIONS}.0::DOUBLE AS cc
       FROM z)
SELECT doc_id, oc AS original_cost, cc AS compressed_cost, oc - cc AS savings,
       (oc - cc) / NULLIF(oc, 0.0) * 100.0 AS savings_percentage
FROM s2""")
def savings(spark, sf_dir):
    c = compressed_documents(spark, sf_dir)
    cols = pricing.savings("original_tokens", "compressed_tokens", INPUT_PRICE, MONTHLY_INVOCATIONS)
    return c.select("doc_id", *[v.alias(k) for k, v in cols.items()])


_STOP = "[" + ", ".join(f"'{w}'" for w in q.STOP_WORDS) + "]"


def _sql_keywords(e: str) -> str:
    return (f"list_distinct(list_filter(list_transform(string_split_regex(trim({e}, {_WS}), '\\s+'), "
            f"lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]', '', 'g')), "
            f"lambda w: strlen(w) > 2 AND NOT list_contains({_STOP}, w)))")


def sql_quality(ratio: float = RATIO, scoring: str = "heuristic") -> str:
    return sql_compress(ratio, scoring) + _SQL_QUALITY_TAIL


_SQL_QUALITY_TAIL = f""",
k AS (SELECT doc_id, text, task, {_sql_keywords('text')} AS ka, {_sql_keywords('task')} AS kb,
        {norm_text('text')} AS na, {norm_text('task')} AS nb FROM z),
m AS (SELECT doc_id, text, task,
        CAST(len(ka) AS INTEGER) AS keywords_original, CAST(len(kb) AS INTEGER) AS keywords_compressed,
        CASE WHEN len(ka) = 0 THEN 1.0
             WHEN len(ka) + len(kb) - len(list_intersect(ka, kb)) > 0
               THEN len(list_intersect(ka, kb))::DOUBLE / (len(ka) + len(kb) - len(list_intersect(ka, kb)))
             ELSE 0.0 END AS information_retention,
        CASE WHEN greatest(strlen(na), strlen(nb)) = 0 THEN 1.0
             ELSE 1.0 - (length(na) - length(nb))::DOUBLE / greatest(strlen(na), strlen(nb)) END
          AS sim
      FROM k),
cr AS (SELECT *, {" + ".join(f"(CASE WHEN contains(lower(text), '{p}') THEN 1 ELSE 0 END)"
                              for p in q.CRITICAL_PATTERNS)} AS found,
         {" + ".join(f"(CASE WHEN contains(lower(text), '{p}') AND contains(lower(task), '{p}') "
                      f"THEN 1 ELSE 0 END)" for p in q.CRITICAL_PATTERNS)} AS kept,
         (CASE WHEN contains(text, '{{') AND contains(text, '}}') AND NOT (contains(task, '{{') AND contains(task, '}}')) THEN 0.5 ELSE 1.0 END)
         * (CASE WHEN contains(text, '<') AND contains(text, '>') AND NOT (contains(task, '<') AND contains(task, '>')) THEN 0.5 ELSE 1.0 END)
         * (CASE WHEN (contains(text, '|') OR contains(text, chr(9))) AND NOT (contains(task, '|') OR contains(task, chr(9))) THEN 0.5 ELSE 1.0 END)
           ::DOUBLE AS structural_integrity
       FROM m),
qq AS (SELECT doc_id, keywords_original, keywords_compressed, information_retention,
         least(sim, 1.0) AS semantic_similarity, CAST(found AS INTEGER) AS critical_patterns_found,
         CAST(kept AS INTEGER) AS critical_patterns_preserved,
         CASE WHEN found > 0 THEN kept::DOUBLE / found ELSE 1.0 END AS critical_instruction_preservation,
         structural_integrity
       FROM cr)"""
SQL_QUALITY = sql_quality()


@register("keyword_retention", "WITH " + SQL_QUALITY + """
SELECT doc_id, keywords_original, keywords_compressed, information_retention FROM qq""")
def keyword_retention(spark, sf_dir):
    c = compressed_documents(spark, sf_dir)
    c = c.select("doc_id", q.keywords("text").alias("a"), q.keywords("task").alias("b"))
    return c.select("doc_id", F.size("a").alias("keywords_original"), F.size("b").alias("keywords_compressed"),
                    q.retention("a", "b").alias("information_retention"))


@register("quality", "WITH " + SQL_QUALITY + """,
fin AS (SELECT *, semantic_similarity * 0.4 + critical_instruction_preservation * 0.3
                  + information_retention * 0.2 + structural_integrity * 0.1 AS overall_score FROM qq)
SELECT doc_id, semantic_similarity, critical_patterns_found, critical_patterns_preserved,
       critical_instruction_preservation, information_retention, structural_integrity, overall_score,
       CASE WHEN overall_score >= 0.9 THEN 'Excellent' WHEN overall_score >= 0.75 THEN 'Good'
            WHEN overall_score >= 0.6 THEN 'Fair' WHEN overall_score >= 0.4 THEN 'Poor'
            ELSE 'Very Poor' END AS rating,
       overall_score >= 0.7 AS acceptable
FROM fin""")
def quality(spark, sf_dir):
    c = q.with_quality(compressed_documents(spark, sf_dir), "text", "task", subsequence=True)
    out = c.select("doc_id", "semantic_similarity", "critical_patterns_found", "critical_patterns_preserved",
                   "critical_instruction_preservation", "information_retention", "structural_integrity",
                   "overall_score")
    return out.withColumn("rating", q.rating("overall_score")) \
        .withColumn("acceptable", F.col("overall_score") >= q.ACCEPTABLE)


@register("structured_compress")
def structured_compress(spark, sf_dir):
    """C2 on page text (markup stripped, so the whole page is instructions)."""
    pages = table(spark, sf_dir, "pages", "page_id", "html", busy=True)
    t = pages.select("page_id", tx.strip_tags("html").alias("t"))
    orig = ex.approx4(F.col("t"))
    comp = ex.compress_structured("t", ex.target_tokens(orig, RATIO))
    return t.select("page_id", orig.alias("original_tokens"), comp.alias("c")).select(
        "page_id", "original_tokens", "c.n_segments", "c.n_selected", "c.selected_tokens",
        (F.lit(ex.FORMAT_OVERHEAD_TOKENS) + ex.approx4(F.col("c.text"))).alias("compressed_tokens"))
