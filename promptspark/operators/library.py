"""Prompt-library profile (E1): totals, histogram, top-n, over-limit,
exact duplicates, per-prompt and per-role token sums (A1-A5, F1, O1, P8).

Input is a ``prompts`` DataFrame with at least an id, a text and (after
:func:`..pricing.prompt_costs`) ``tokens`` and ``total_cost`` columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_content
from ..functions.tokens import TokenCounter, approx4

# Histogram upper bounds (inclusive); larger counts overflow.
HISTOGRAM_BOUNDS = (100, 500, 1000, 5000, 10000, 50000)
OVERFLOW_LABEL = "50K+"
# Roles that get their own column in the breakdown.
BREAKDOWN_ROLES = ("system", "user", "assistant")


def library_totals(prompts: DataFrame, monthly_invocations: int = 1000) -> DataFrame:
    """A1: one row - prompt count, token sum, cost sum, monthly cost."""
    return (prompts.agg(F.count(F.lit(1)).alias("total_prompts"),
                        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"),
                        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"))
            .withColumn("monthly_cost", F.col("total_cost") * F.lit(float(monthly_invocations))))


def bucket_of(tokens, bounds: Sequence[int] = HISTOGRAM_BOUNDS):
    """Smallest bound >= tokens; null for the overflow bucket."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    expr = None
    for b in bounds:
        expr = F.when(t <= b, F.lit(b)) if expr is None else expr.when(t <= b, F.lit(b))
    return expr


def bucket_label(bucket, bounds: Sequence[int] = HISTOGRAM_BOUNDS):
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    expr = F.when(b.isNull(), F.lit(OVERFLOW_LABEL))
    prev = 0
    for i, hi in enumerate(bounds):
        lo = 0 if i == 0 else prev + 1
        expr = expr.when(b == hi, F.lit(f"{lo}-{hi}"))
        prev = hi
    return expr


def token_histogram(prompts: DataFrame, bounds: Sequence[int] = HISTOGRAM_BOUNDS) -> DataFrame:
    """A2: (bucket_max, bucket_label, prompts); empty buckets are absent.
    ``bucket_max`` is null for the overflow bucket.  Map-side partial count,
    so at most len(bounds)+1 rows per partition reach the shuffle."""
    return (prompts.select(bucket_of("tokens", bounds).alias("bucket_max"))
            .groupBy("bucket_max").agg(F.count(F.lit(1)).alias("prompts"))
            .withColumn("bucket_label", bucket_label("bucket_max", bounds)))


def top_expensive(prompts: DataFrame, n: int = 10, id_col: str = "doc_id") -> DataFrame:
    """O1: the n most expensive prompts (ties broken by id).  Plans as
    TakeOrderedAndProject: each partition keeps n rows, the driver merges."""
    return prompts.orderBy(F.desc("total_cost"), F.asc(id_col)).limit(n)


def over_limit(prompts: DataFrame, limit: int) -> DataFrame:
    """prompts above the context limit, with the excess."""
    return (prompts.filter(F.col("tokens") > F.lit(limit))
            .withColumn("excess", F.col("tokens") - F.lit(limit)))


def exact_duplicates(prompts: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """A3: membership of duplicate groups on the P8 normal form.

    Output is one row per member: (id, group_id = smallest member id,
    group_size).  Nothing is collected per group, so a group holding a third of
    the corpus is still processed by many tasks: the group key is a SHA-256 of
    the normal form (shuffles 64 bytes, not the text), the count/min are
    partially aggregated map-side, and the membership join against the
    (duplicate-only) group table is left to AQE's skew-join splitting.
    """
    keyed = prompts.select(F.col(id_col), F.sha2(normalize_content(text_col), 256).alias("_h"))
    groups = (keyed.groupBy("_h")
              .agg(F.count(F.lit(1)).alias("group_size"), F.min(id_col).alias("group_id"))
              .filter(F.col("group_size") > 1))
    return keyed.join(groups, "_h").drop("_h")


def message_tokens(messages: DataFrame, text_col: str = "text",
                   counter: TokenCounter = approx4) -> DataFrame:
    return messages.withColumn("tokens", counter(F.col(text_col)))


def role_breakdown(messages: DataFrame, key: str = "conv_id", role_col: str = "role",
                   text_col: str = "text", counter: TokenCounter = approx4) -> DataFrame:
    """A4 + A5: tokens per prompt, split by role.  Roles outside the fixed list
    only count in ``total``.  Conditional sums (no pivot discovery pass)."""
    t = counter(F.col(text_col))
    aggs = [F.sum(F.when(F.col(role_col) == r, t).otherwise(F.lit(0))).cast("long").alias(r)
            for r in BREAKDOWN_ROLES]
    return messages.groupBy(key).agg(*aggs, F.sum(t).cast("long").alias("total"))
