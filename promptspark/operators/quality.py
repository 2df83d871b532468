"""Compression quality (C11, C12, X1, X3, P7, P10, V1 and the R1 shortcut).

Inputs are two text columns, the original and the expanded compression.
Everything is a Catalyst expression; the only super-linear piece, Levenshtein
on whole texts, is replaced by the exact O(n) subsequence identity when the
caller knows the expansion is an ordered subset of the original (R1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let, normalize_text, words

# Phrases whose presence must survive compression.
CRITICAL_PATTERNS = [
    "response format",
    "separator is always",
    "do not output",
    "extracted_value",
    "doc_page_number",
    "must include",
    "required field",
    "output format",
    "json schema",
    "xml structure",
]

# Stop words ignored by keyword extraction.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "from", "as", "is", "was", "are", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "can",
    "this", "that", "these", "those", "it", "its", "they", "them", "their",
]

# Overall score weights and rating thresholds.
WEIGHTS = {"similarity": 0.4, "critical": 0.3, "retention": 0.2, "structure": 0.1}
RATINGS = [(0.9, "Excellent"), (0.75, "Good"), (0.6, "Fair"), (0.4, "Poor")]
LOWEST_RATING = "Very Poor"
ACCEPTABLE = 0.7


def keywords(text) -> Column:
    """P10: distinct lower-cased words reduced to letters/digits, longer than
    2 bytes, minus stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    # one pass over the text: lower-case, drop every character that is neither
    # a letter/digit nor whitespace, then split (same words as cleaning each)
    cleaned = words(F.regexp_replace(F.lower(col(text)), r"(?U)[^\p{IsAlphabetic}\p{N}\s]", ""))
    return F.array_except(F.filter(cleaned, lambda w: F.octet_length(w) > 2), stop)  # distinct, too


def retention(a, b) -> Column:
    """X1 of two keyword sets (columns: read several times)."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return (F.when(F.size(a) == 0, F.lit(1.0))
            .when(union > 0, inter.cast("double") / union).otherwise(F.lit(0.0)))


def keyword_retention(original, expanded) -> Column:
    """Jaccard of keyword sets; 1.0 when the original has none."""
    return let(F.struct(keywords(original).alias("a"), keywords(expanded).alias("b")), lambda k: retention(k.a, k.b))


def critical_counts(original, expanded) -> tuple[Column, Column]:
    """(found in original, also present in expansion)."""
    o, e = F.lower(col(original)), F.lower(col(expanded))
    found = sum((F.when(o.contains(p), 1).otherwise(0) for p in CRITICAL_PATTERNS), F.lit(0))
    kept = sum((F.when(o.contains(p) & e.contains(p), 1).otherwise(0) for p in CRITICAL_PATTERNS),
               F.lit(0))
    return found, kept


def structure_score(original, expanded) -> Column:
    """Halve for each of JSON / HTML / table marks present before and
    lost after."""
    o, e = col(original), col(expanded)

    def has_json(t):
        return t.contains("{") & t.contains("}")

    def has_html(t):
        return t.contains("<") & t.contains(">")

    def has_table(t):
        return t.contains("|") | t.contains("\t")

    s = F.lit(1.0)
    for f in (has_json, has_html, has_table):
        s = s * F.when(f(o) & ~f(e), F.lit(0.5)).otherwise(F.lit(1.0))
    return s


def subsequence_similarity(original, subsequence) -> Column:
    """When ``subsequence`` (after normalisation) is an ordered subsequence
    of ``original``, edit distance equals the length difference, so V1 is
    exact in O(n)."""
    no, ns = normalize_text(original), normalize_text(subsequence)
    m = F.greatest(F.octet_length(no), F.octet_length(ns))
    d = F.char_length(no) - F.char_length(ns)
    return F.when(m == 0, F.lit(1.0)).otherwise(F.lit(1.0) - d.cast("double") / m)


def rating(score) -> Column:
    s = col(score)
    expr = None
    for th, name in RATINGS:
        expr = F.when(s >= th, F.lit(name)) if expr is None else expr.when(s >= th, F.lit(name))
    return expr.otherwise(F.lit(LOWEST_RATING))


def stage_original(df: DataFrame, original: str, prefix: str = "_q") -> DataFrame:
    """The original-text side of C11 (lower-cased text, keyword set, normal
    form); stage it before rows are multiplied (e.g. per compression level)."""
    return (df.withColumn(f"{prefix}_ol", F.lower(original)).withColumn(f"{prefix}_ok", keywords(original))
            .withColumn(f"{prefix}_on", normalize_text(original)))


def with_quality(df: DataFrame, original: str, expanded: str, subsequence: bool = False,
                 prefix: str = "_q", original_staged: bool = False) -> DataFrame:
    """C11 as staged columns: each whole-text intermediate (lower-cased text,
    keyword set, normal form) is computed once per row and then read by the
    metrics, which are in turn read by the overall score.  Adds the seven
    metrics and ``overall_score``.  ``original_staged``: the original side
    was already added by :func:`stage_original`."""
    ol, el, ok, ek = (f"{prefix}_ol", f"{prefix}_el", f"{prefix}_ok", f"{prefix}_ek")
    on, en = f"{prefix}_on", f"{prefix}_en"
    st = df if original_staged else stage_original(df, original, prefix)
    st = (st.withColumn(el, F.lower(expanded)).withColumn(ek, keywords(expanded))
          .withColumn(en, normalize_text(expanded)))
    m = F.greatest(F.octet_length(on), F.octet_length(en))
    if subsequence:
        sim = F.when(m == 0, F.lit(1.0)).otherwise(
            F.lit(1.0) - (F.char_length(on) - F.char_length(en)).cast("double") / m)
    else:
        sim = F.when(m == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(on, en).cast("double") / m)
    found = sum((F.when(F.col(ol).contains(p), 1).otherwise(0) for p in CRITICAL_PATTERNS), F.lit(0))
    kept = sum((F.when(F.col(ol).contains(p) & F.col(el).contains(p), 1).otherwise(0)
                for p in CRITICAL_PATTERNS), F.lit(0))
    st = (st.withColumn("semantic_similarity", F.least(sim, F.lit(1.0)))
          .withColumn("critical_patterns_found", found)
          .withColumn("critical_patterns_preserved", kept)
          .withColumn("information_retention", retention(ok, ek))
          .withColumn("structural_integrity", structure_score(original, expanded))
          .drop(ol, el, ok, ek, on, en))
    st = st.withColumn("critical_instruction_preservation", F.when(
        F.col("critical_patterns_found") > 0,
        F.col("critical_patterns_preserved").cast("double") / F.col("critical_patterns_found")).otherwise(F.lit(1.0)))
    return st.withColumn("overall_score", F.col("semantic_similarity") * WEIGHTS["similarity"]
                         + F.col("critical_instruction_preservation") * WEIGHTS["critical"]
                         + F.col("information_retention") * WEIGHTS["retention"]
                         + F.col("structural_integrity") * WEIGHTS["structure"])
