"""Compression benchmark (J3, B1-B3, A9-A14, O4) and prompt diff.

The reference runs a subprocess per (prompt, level, scoring) cell; here the
whole matrix is one DataFrame: prompts x a bounded configuration table,
compressed in one narrow stage (the level's ratio is a column), scored, then
summarised with grouping sets in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import approx4
from . import quality as q
from .extract import LEVEL_RATIO, MIN_TOKENS_FOR_COMPRESSION, CompressionConfig, extractive_compress

# The benchmark matrix.
LEVELS = ["light", "medium", "aggressive"]
SCORINGS = ["heuristic", "semantic", "hybrid"]
# Recommendation weights and threshold rules.
REC_WEIGHTS = (0.6, 0.4)
MIN_COMPRESSION = (30.0, 0.7)
MIN_QUALITY = (60.0, 0.85)
#: Reason of the rows under the token gate.
TOO_SHORT = "too short to compress"
COMPRESSION_RANGE = (0.8, 1.2)
QUALITY_RANGE_LOW = 0.9
METRICS = ["compression_percentage", "tokens_saved", "overall_score_pct"]


def run_matrix(prompts: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               category_col: str = "category") -> DataFrame:
    """B1: one record per (prompt, level, scoring).  Prompts under the 50-token
    gate are not compressed (F2): their rows have ``success`` false and null
    results.  Sentences are segmented once per prompt; scorings, then levels
    multiply rows by ``explode`` (narrow), each scored and walked on its own."""
    staged = q.stage_original(prompts, text_col)
    comp = q.with_quality(extractive_compress(staged, text_col, CompressionConfig(), levels=LEVELS, scorings=SCORINGS),
                          text_col, "task", subsequence=True, original_staged=True)
    lv_idx = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("compression_level")) - 1
    sc_idx = F.array_position(F.array(*[F.lit(x) for x in SCORINGS]), F.col("scoring_mode")) - 1
    ok = F.col("original_tokens") >= MIN_TOKENS_FOR_COMPRESSION
    results = ["compressed_tokens", "tokens_saved", "compression_ratio"]
    scores = ["overall_score", "semantic_similarity", "information_retention", "structural_integrity",
              "critical_instruction_preservation"]

    def result(c: str) -> Column:
        return F.when(ok, F.col(c)).alias(c)

    return comp.select(
        id_col, F.col(category_col).alias("category"),
        (lv_idx * len(SCORINGS) + sc_idx).cast("int").alias("config"), "compression_level", "scoring_mode",
        ok.alias("success"), F.when(~ok, F.lit(TOO_SHORT)).alias("reason"), "original_tokens",
        *[result(c) for c in results],
        F.when(ok, F.col("compression_ratio") * 100.0).alias("compression_percentage"), *[result(c) for c in scores])


def run_summary(results: DataFrame) -> DataFrame:
    """Total, successful and failed runs, success rate in percent, and the
    failures by reason (a fixed, small set)."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.count_if("success") / F.count(F.lit(1)) * 100.0, F.lit(0.0)).alias("success_rate"),
        F.count_if(F.col("reason") == TOO_SHORT).alias("too_short"))


def _stats(c: Column, name: str, exact_median: bool = True) -> list[Column]:
    """Mean, median, min, max, sample stdev (0 for one value), count.
    The exact median keeps a value -> count map per group (memory grows with
    the distinct values of a group); ``exact_median=False`` switches to the
    mergeable, bounded-memory ``percentile_approx``."""
    med = F.median(c) if exact_median else F.percentile_approx(c, 0.5, 100_000)
    return [F.avg(c).alias(f"{name}_mean"), med.alias(f"{name}_median"),
            F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{name}_std")]


def stats(results: DataFrame, exact_median: bool = True) -> DataFrame:
    """A10 + A11: statistics of successful runs, overall and per category /
    level / scoring, in one GROUPING SETS aggregation.  ``dimension`` names
    the grouping ('overall' for the grand total)."""
    ok = results.filter("success").withColumn("overall_score_pct", F.col("overall_score") * 100.0)
    aggs = [F.count(F.lit(1)).alias("count")]
    for m in METRICS:
        aggs += _stats(F.col(m).cast("double"), m, exact_median)
    g = ok.groupingSets([["category"], ["compression_level"], ["scoring_mode"], []],
                        "category", "compression_level", "scoring_mode").agg(F.grouping_id().alias("_gid"), *aggs)
    # Bits of the grouping id tell a null key from a column that is summed over.
    names = {0b011: ("category", F.col("category")), 0b101: ("level", F.col("compression_level")),
             0b110: ("scoring", F.col("scoring_mode")), 0b111: ("overall", F.lit("all"))}
    dim = F.coalesce(*[F.when(F.col("_gid") == k, F.lit(n)) for k, (n, _) in names.items()])
    key = F.coalesce(*[F.when(F.col("_gid") == k, c) for k, (_, c) in names.items()])
    return g.select(dim.alias("dimension"), key.alias("key"), *[c for c in g.columns
                                                               if c not in ("category", "compression_level",
                                                                            "scoring_mode", "_gid")])


def recommend(st: DataFrame, results: DataFrame, id_cols=("doc_id", "config")) -> DataFrame:
    """A13 + O4: best level and scoring by 0.6 x mean compression + 0.4 x
    mean quality (first in matrix order on ties), thresholds from the
    overall means, and the best / worst run by compression percentage."""
    w_c, w_q = REC_WEIGHTS
    score = F.col("compression_percentage_mean") * w_c + F.col("overall_score_pct_mean") * w_q
    order = {v: i for i, v in enumerate(LEVELS)} | {v: i for i, v in enumerate(SCORINGS)}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("key"))
    best = (st.filter(F.col("dimension").isin("level", "scoring"))
            .withColumn("s", score).withColumn("r", rank)
            .groupBy("dimension").agg(F.max_by("key", F.struct("s", -F.col("r"))).alias("best")))
    levels = best.filter("dimension = 'level'").select(F.col("best").alias("best_level"))
    scorings = best.filter("dimension = 'scoring'").select(F.col("best").alias("best_scoring"))
    overall = st.filter("dimension = 'overall'").select(
        F.greatest(F.lit(MIN_COMPRESSION[0]), F.col("compression_percentage_mean") * MIN_COMPRESSION[1])
        .alias("min_compression"),
        F.greatest(F.lit(MIN_QUALITY[0]), F.col("overall_score_pct_mean") * MIN_QUALITY[1]).alias("min_quality"),
        (F.col("compression_percentage_mean") * COMPRESSION_RANGE[0]).alias("target_compression_low"),
        (F.col("compression_percentage_mean") * COMPRESSION_RANGE[1]).alias("target_compression_high"),
        (F.col("overall_score_pct_mean") * QUALITY_RANGE_LOW).alias("target_quality_low"))
    ids = F.struct(*[F.col(c) for c in id_cols])
    ok = results.filter("success")
    bw = ok.agg(F.max_by(ids, F.struct("compression_percentage", -F.col(id_cols[0]), -F.col(id_cols[1])))
                .alias("best_run"),
                F.min_by(ids, F.struct("compression_percentage", -F.col(id_cols[0]), -F.col(id_cols[1])))
                .alias("worst_run"))
    return levels.crossJoin(scorings).crossJoin(overall).crossJoin(bw)  # four one-row frames


def diff(a: DataFrame, b: DataFrame, key: str, input_per_1k: float) -> DataFrame:
    """Two versions of each prompt (full outer on the key): tokens, token
    delta (b - a), absolute input-cost delta."""
    ta = a.select(key, F.col("tokens").alias("tokens_a"))
    tb = b.select(key, F.col("tokens").alias("tokens_b"))
    j = ta.join(tb, key, "full_outer")
    ca = F.col("tokens_a") / 1000.0 * F.lit(input_per_1k)
    cb = F.col("tokens_b") / 1000.0 * F.lit(input_per_1k)
    return j.select(key, "tokens_a", "tokens_b", (F.col("tokens_b") - F.col("tokens_a")).alias("token_delta"),
                    F.abs(cb - ca).alias("cost_delta"))
