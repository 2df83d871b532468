"""Request logs.

A request log is (ts, success, latency_ms, content, input_tokens,
output_tokens, total_tokens, error).  Raw provider responses are normalised
from JSON text with the variant type (shapes differ by provider).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col

SAMPLE_CHARS = 80


def _string_at(v: Column, path: str) -> Column:
    """The JSON string at ``path`` (null when absent or not a string)."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string"))


def _int_at(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x).isin("BIGINT", "INT", "SMALLINT", "TINYINT"),
                  F.try_variant_get(v, path, "bigint"))


def normalize_response(body) -> Column:
    """P25: struct<content, input_tokens, output_tokens, total_tokens, model>.
    Content: the first string among content / response / result / output /
    message, then the first usable choice's text or message content, then the first
    text block of a content array.  Usage: prompt/completion (OpenAI style)
    or input/output (Anthropic style) tokens."""
    v = F.try_parse_json(col(body))
    content = F.coalesce(
        _string_at(v, "$.content"), _string_at(v, "$.response"), _string_at(v, "$.result"),
        _string_at(v, "$.output"), _string_at(v, "$.message"),
        F.get(F.filter(F.transform(F.try_variant_get(v, "$.choices", "array<variant>"), lambda c: F.coalesce(
            _string_at(c, "$.text"), _string_at(c, "$.message.content"))), lambda s: s.isNotNull()), F.lit(0)),
        _string_at(v, "$.content[0].text"))
    return F.struct(
        content.alias("content"),
        F.coalesce(_int_at(v, "$.usage.prompt_tokens"), _int_at(v, "$.usage.input_tokens")).alias("input_tokens"),
        F.coalesce(_int_at(v, "$.usage.completion_tokens"), _int_at(v, "$.usage.output_tokens"))
        .alias("output_tokens"),
        _int_at(v, "$.usage.total_tokens").alias("total_tokens"),
        _string_at(v, "$.model").alias("model"),
        _string_at(v, "$.error.message").alias("error"))


def summary(requests: DataFrame, input_per_1k: float | None = None,
            output_per_1k: float | None = None) -> DataFrame:
    """A7 + A18: one row.  Rates in percent; mean latency over successes;
    token sums over all requests that report them; cost when prices are
    given; the earliest success's first 80 characters and earliest error."""
    ok = F.col("success")
    agg = requests.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(ok).alias("successful"),
        F.coalesce(F.avg(F.when(ok, F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens_reported"),
        F.min_by(F.when(ok, F.substring("content", 1, SAMPLE_CHARS)), F.when(ok, F.struct("ts", "seq")))
        .alias("sample_response"),
        F.min_by(F.when(~ok, F.col("error")), F.when(~ok, F.struct("ts", "seq"))).alias("sample_error"))
    out = agg.withColumn("failed", F.col("total_requests") - F.col("successful")) \
        .withColumn("success_rate", F.when(F.col("total_requests") > 0,
                                           F.col("successful") / F.col("total_requests") * 100.0)
                    .otherwise(F.lit(0.0))) \
        .withColumn("failure_rate", F.when(F.col("total_requests") > 0, 100.0 - F.col("success_rate"))
                    .otherwise(F.lit(0.0)))
    if input_per_1k is not None and output_per_1k is not None:
        out = out.withColumn("input_cost", F.col("input_tokens") / 1000.0 * F.lit(input_per_1k)) \
            .withColumn("output_cost", F.col("output_tokens") / 1000.0 * F.lit(output_per_1k)) \
            .withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))
    return out


LATENCY_RANGE = 64  # milliseconds per block of the running count


def latency_percentiles(requests: DataFrame, group_cols=()) -> DataFrame:
    """A8 exactly as the reference indexes the sorted successful latencies:
    p50 = sorted[n/2], p95 = sorted[min(ceil(0.95 n), n-1)] (0-based).

    Scalable form: latencies are first counted per distinct value (map-side
    partial aggregation); the running count is a two-level prefix sum over
    value ranges of ``LATENCY_RANGE``, so only the ranges' totals (their number
    depends on the spread of the latencies, not on the requests) meet in one task."""
    g = list(group_cols)
    counts = requests.filter("success").groupBy(*g, "latency_ms").agg(F.count(F.lit(1)).alias("c")) \
        .withColumn("_blk", F.floor(F.col("latency_ms") / LATENCY_RANGE))
    inside = Window.partitionBy(*g, "_blk").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.groupBy(*g, "_blk").agg(F.sum("c").alias("_c"))
    every = Window.partitionBy(*g) if g else Window.partitionBy()
    offsets = totals.select(*g, "_blk", F.sum("_c").over(every).alias("n"), F.coalesce(F.sum("_c").over(
        every.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = counts.withColumn("_in", F.sum("c").over(inside)).join(offsets, [*g, "_blk"]) \
        .withColumn("upto", F.col("_in") + F.col("_before"))
    i50 = F.floor(F.col("n") / 2)
    i95 = F.least(F.ceil(F.col("n") * 0.95), F.col("n") - 1)
    # value at 0-based index i = smallest latency whose running count exceeds i
    return ranked.groupBy(*g).agg(
        F.min(F.when(F.col("upto") > i50, F.col("latency_ms"))).alias("p50_ms"),
        F.min(F.when(F.col("upto") > i95, F.col("latency_ms"))).alias("p95_ms"),
        F.first("n").alias("n_successful"))


def approx_latency_percentiles(requests: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Bounded-memory alternative for very large logs (percentile_approx)."""
    return requests.filter("success").agg(
        F.percentile_approx("latency_ms", [0.5, 0.95], accuracy).alias("p"))
