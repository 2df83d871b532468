"""Plans for similarity, fuzzy matching and the pattern library (step 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import approx4
from ..operators import compress as cp
from ..operators import patterns as pt
from ..operators import similarity as sm
from ..operators.text_ops import categorize
from ..sources.tables import table
from . import register
from .sqlsnip import norm_text

TAU = pt.MIN_SIMILARITY

# Oracle-only device: DuckDB's levenshtein counts bytes, the reference counts
# code points.  The corpus' 21 two-byte letters are mapped one-to-one onto
# unused single-byte control codes (never whitespace) before levenshtein, so
# the byte distance equals the code-point distance.  Denominators use the
# untranslated byte lengths.
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_NARROW = " || ".join(f"chr({c})" for c in list(range(1, 9)) + list(range(14, 27)))


def _cp(e: str) -> str:
    return f"translate({e}, '{_WIDE}', {_NARROW})"


def _sql_sim(a: str, b: str) -> str:
    return (f"CASE WHEN greatest(strlen({a}), strlen({b})) = 0 THEN 1.0 ELSE "
            f"1.0 - levenshtein({_cp(a)}, {_cp(b)})::DOUBLE / greatest(strlen({a}), strlen({b})) END")


def _sql_wordset(e: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({norm_text(e)}, ' '), lambda w: w <> ''))"


def benchmark_library(spark, sf_dir):
    """The benchmark passages as a pattern library (ids by item order)."""
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    return b.select(F.format_string("%s_%03d", categorize("text"), F.col("item_id") + 1).alias("id"),
                    F.col("text").alias("content"), F.lit(1).cast("long").alias("frequency"),
                    approx4(F.col("text")).alias("avg_tokens"), categorize("text").alias("category"),
                    "item_id")


@register("pair_similarity", f"""
WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
p AS (SELECT a.doc_id, a.text AS ta, b.text AS tb FROM r a JOIN r b ON b.n = a.n + 1),
w AS (SELECT doc_id, ta, tb, p2.w, p2.side FROM p,
        LATERAL (SELECT unnest(string_split_regex({norm_text('ta')}, ' ')) AS w, 0 AS side
                 UNION ALL SELECT unnest(string_split_regex({norm_text('tb')}, ' ')), 1) p2),
tf AS (SELECT doc_id, w, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS ca,
              sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS cb FROM w WHERE w <> '' GROUP BY doc_id, w),
cs AS (SELECT doc_id, sum(ca * cb)::DOUBLE AS dot, sum(ca * ca)::DOUBLE AS na,
              sum(cb * cb)::DOUBLE AS nb FROM tf GROUP BY doc_id)
SELECT p.doc_id, {_sql_sim('ta', 'tb')} AS similarity,
       {_sql_sim(norm_text('ta'), norm_text('tb'))} AS normalized_similarity,
       CASE WHEN len({_sql_wordset('ta')}) = 0 AND len({_sql_wordset('tb')}) = 0 THEN 1.0
            ELSE len(list_intersect({_sql_wordset('ta')}, {_sql_wordset('tb')}))::DOUBLE
                 / len(list_distinct(list_concat({_sql_wordset('ta')}, {_sql_wordset('tb')}))) END
         AS word_jaccard,
       CASE WHEN coalesce(cs.na, 0) = 0 OR coalesce(cs.nb, 0) = 0 THEN 0.0
            ELSE cs.dot / (sqrt(cs.na) * sqrt(cs.nb)) END AS word_cosine
FROM p LEFT JOIN cs ON p.doc_id = cs.doc_id""")
def pair_similarity(spark, sf_dir):
    """V1, V2 and X2 of each document and the next one by id."""
    return sm.next_similarity(table(spark, sf_dir, "documents", "doc_id", "text"))


def _similar_patterns_sql() -> str:
    from .text_plans import sql_sentences
    cat = """CASE WHEN contains(lower(text), 'you are') OR contains(lower(text), 'your role')
                OR contains(lower(text), 'expert') THEN 'role'
              WHEN contains(lower(text), 'example') OR contains(lower(text), 'instance')
                OR contains(lower(text), 'e.g.') THEN 'examples'
              WHEN contains(lower(text), 'must') OR contains(lower(text), 'should not')
                OR contains(lower(text), 'constraint') THEN 'constraints'
              ELSE 'general' END"""
    return "WITH " + sql_sentences() + f""",
lib AS (SELECT {cat} || '_' || lpad(CAST(item_id + 1 AS VARCHAR), 3, '0') AS id, {norm_text('text')} AS p
        FROM benchmark),
sx AS (SELECT doc_id, idx, {norm_text('sentence')} AS t FROM x),
c AS (SELECT sx.doc_id, sx.idx, lib.id, {_sql_sim('sx.t', 'lib.p')} AS similarity
      FROM sx JOIN lib ON abs(length(sx.t) - length(lib.p)) <= {1 - TAU} * greatest(strlen(sx.t), strlen(lib.p)))
SELECT doc_id, CAST(idx AS INTEGER) AS idx, id, similarity FROM c WHERE similarity >= {TAU}"""


@register("similar_patterns", _similar_patterns_sql())
def similar_patterns(spark, sf_dir):
    """Every document sentence with the library patterns (benchmark
    passages) at normalised similarity >= 0.85, by the exact blocking join."""
    from ..operators import extract as ex
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    key = F.struct("doc_id", "idx")
    sents = ex.sentence_table(docs).select(key.alias("text_id"), F.col("sentence").alias("text"))
    lib = benchmark_library(spark, sf_dir)
    m = pt.similar_patterns(lib, sents, TAU)
    return m.select(F.col("text_id.doc_id").cast("long").alias("doc_id"),
                    F.col("text_id.idx").cast("int").alias("idx"), "id", "similarity")


@register("pattern_match")
def pattern_match(spark, sf_dir):
    """J5 + C4: benchmark passages found (fuzzily) inside documents, with the
    reference each kept match becomes after overlap resolution."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    lib = benchmark_library(spark, sf_dir).drop("item_id")
    matches = pt.pattern_matches(docs, lib, tau=TAU).checkpoint()
    refs = pt.substitute(matches, lib)
    return refs.join(matches.select("doc_id", "id", "similarity"), ["doc_id", "id"])


@register("mine_patterns")
def mine_patterns(spark, sf_dir):
    """E5: the pattern library mined from the whole document corpus."""
    return pt.mine_patterns(table(spark, sf_dir, "documents", "doc_id", "text", busy=True))


@register("compress_pipeline")
def compress_pipeline(spark, sf_dir):
    """C1 with C4 and C5: documents compressed with the benchmark passages as the
    library.  ``restored``: the instructions come back exactly from the text with
    markers and the marks."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    out = cp.compress_with_library(docs, benchmark_library(spark, sf_dir).drop("item_id"))
    return out.select(
        "doc_id", "original_tokens", "target_tokens", F.transform("marks", lambda m: F.struct(
            m["id"].alias("id"), m["at"].alias("at"), m["matched"].alias("matched"), m["tokens_saved"].alias("tokens_saved")))
        .alias("references"), F.startswith("text", cp.restore_windows("substituted", "marks")).alias("restored"),
        "document", "compressed_tokens", "tokens_saved", "compression_ratio")


@register("library_ops", """
WITH lib AS (
  SELECT CASE WHEN contains(lower(text), 'you are') OR contains(lower(text), 'your role')
                OR contains(lower(text), 'expert') THEN 'role'
              WHEN contains(lower(text), 'example') OR contains(lower(text), 'instance')
                OR contains(lower(text), 'e.g.') THEN 'examples'
              WHEN contains(lower(text), 'must') OR contains(lower(text), 'should not')
                OR contains(lower(text), 'constraint') THEN 'constraints'
              ELSE 'general' END AS category,
         CAST(ceil(length(text)::DOUBLE / 4.0) AS BIGINT) AS avg_tokens
  FROM benchmark)
SELECT category, GROUPING(category) = 1 AS is_total, CAST(count(*) AS BIGINT) AS total_patterns, CAST(sum(avg_tokens) AS BIGINT) AS total_tokens,
       CAST(floor(sum(avg_tokens) / count(*)) AS BIGINT) AS avg_tokens_per_pattern
FROM lib GROUP BY ROLLUP (category)""")
def library_ops(spark, sf_dir):
    """Split the benchmark library in two, merge it back
    (new ids only), prune nothing (frequency 1 >= 1), and report statistics
    per category and overall."""
    lib = benchmark_library(spark, sf_dir).drop("item_id")
    first = lib.filter(F.col("id") < "m")
    merged = pt.merge(pt.merge(first, lib), lib)
    kept = pt.prune(merged, 1)
    return pt.library_statistics(kept)
