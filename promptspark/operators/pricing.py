"""Model registry, price lookup and cost columns.

The registry is a *small* table (one row per lookup key).  Its size is bounded
by the number of models the caller registers, checked when it is built, so it
is safe to broadcast; the corpus side is never shuffled for a price lookup.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import TokenCounter, approx4

# Default registry (provider, model, input $/1K, output $/1K),
# in registration order.
DEFAULT_MODELS = [
    ("openai", "gpt-4", 0.03, 0.06),
    ("openai", "gpt-4-turbo", 0.01, 0.03),
    ("openai", "gpt-3.5-turbo", 0.0015, 0.002),
    ("google", "gemini-pro", 0.00125, 0.01),
    ("google", "gemini-2.5-pro", 0.00125, 0.01),
    ("google", "gemini-2.5-flash", 0.000075, 0.0003),
]

# A tokenizer's own price list, keyed by the resolved model name.
TOKENIZER_PRICES = [
    ("gpt-4", 0.03, 0.06),
    ("gpt-4-0314", 0.03, 0.06),
    ("gpt-4-32k", 0.03, 0.06),
    ("gpt-4-32k-0314", 0.03, 0.06),
    ("gpt-4-turbo-preview", 0.01, 0.03),
    ("gpt-4-turbo", 0.01, 0.03),
    ("gpt-4-0125-preview", 0.01, 0.03),
    ("gpt-3.5-turbo", 0.0015, 0.002),
    ("gpt-3.5-turbo-0301", 0.0015, 0.002),
    ("gpt-3.5-turbo-16k", 0.003, 0.004),
    ("gemini-2.5-pro", 0.00125, 0.01),
    ("gemini-pro", 0.00125, 0.01),
    ("gemini-2.5-flash", 0.000075, 0.0003),
    ("gemini-flash", 0.000075, 0.0003),
]

# Alias group that resolves to one name.
TURBO_ALIASES = ("gpt-4-turbo", "gpt-4-turbo-preview")
TURBO_TARGET = "gpt-4-turbo-preview"

# Upper bound on registry rows we are willing to broadcast.
MAX_REGISTRY_MODELS = 100_000

LIBRARY_OUTPUT_TOKENS = 100  # library profile prices a flat 100 output tokens


def resolve_alias(model) -> Column:
    """Last ``/`` path part; the turbo aliases collapse to one name."""
    m = F.col(model) if isinstance(model, str) else model
    base = F.element_at(F.split(m, "/"), -1)
    return F.when(base.isin(*TURBO_ALIASES), F.lit(TURBO_TARGET)).otherwise(base)


def tokenizer_family(model) -> Column:
    """Tokenizer routing by prefix of the resolved name; null = not found."""
    r = resolve_alias(model)
    return (F.when(r.startswith("gpt-") | r.startswith("text-"), F.lit("openai"))
            .when(r.startswith("gemini-"), F.lit("gemini")))


def models_table(spark: SparkSession,
                 overrides: Iterable[tuple[str, str, float, float]] = (),
                 include_defaults: bool = True) -> DataFrame:
    """(seq, provider, model, input_per_1k, output_per_1k) in upsert order."""
    rows = (list(DEFAULT_MODELS) if include_defaults else []) + list(overrides)
    if len(rows) > MAX_REGISTRY_MODELS:
        raise ValueError(f"registry of {len(rows)} models exceeds broadcast bound")
    return spark.createDataFrame(
        [(i, p, m, float(a), float(b)) for i, (p, m, a, b) in enumerate(rows)],
        "seq int, provider string, model string, input_per_1k double, output_per_1k double")


def registry(models: DataFrame) -> DataFrame:
    """Key table: every model is reachable by ``model``, ``provider/model`` and
    ``lower(model)``; when two upserts share a key the later one wins."""
    keyed = models.select(
        F.explode(F.array_distinct(F.array(
            "model", F.concat_ws("/", "provider", "model"), F.lower("model")))).alias("key"),
        "seq", "provider", "model", "input_per_1k", "output_per_1k")
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return (keyed.withColumn("_rn", F.row_number().over(w))
            .filter("_rn = 1").drop("_rn", "seq"))


def tokenizer_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOKENIZER_PRICES,
                                 "model string, input_per_1k double, output_per_1k double")


def with_prices(df: DataFrame, model_col: str, reg: DataFrame,
                tok_prices: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """Attach ``input_per_1k``/``output_per_1k`` for each row's model.

    Priority: registry by exact name, registry by resolved alias, then (when
    ``tok_prices`` is given) the tokenizer's own price for the resolved name.
    Three broadcast hash joins against bounded tables; no corpus shuffle.
    """
    r1 = reg.select(F.col("key").alias("_k1"), F.col("input_per_1k").alias("_i1"),
                    F.col("output_per_1k").alias("_o1"))
    r2 = reg.select(F.col("key").alias("_k2"), F.col("input_per_1k").alias("_i2"),
                    F.col("output_per_1k").alias("_o2"))
    out = (df.withColumn("_alias", resolve_alias(model_col))
           .join(F.broadcast(r1), F.col(model_col) == F.col("_k1"), "left")
           .join(F.broadcast(r2), F.col("_alias") == F.col("_k2"), "left"))
    ins = [F.col("_i1"), F.col("_i2")]
    outs = [F.col("_o1"), F.col("_o2")]
    drop = ["_alias", "_k1", "_i1", "_o1", "_k2", "_i2", "_o2"]
    if tok_prices is not None:
        r3 = tok_prices.select(F.col("model").alias("_k3"), F.col("input_per_1k").alias("_i3"),
                               F.col("output_per_1k").alias("_o3"))
        out = out.join(F.broadcast(r3),
                       (F.col("_alias") == F.col("_k3")) & tokenizer_family(model_col).isNotNull(),
                       "left")
        ins.append(F.col("_i3"))
        outs.append(F.col("_o3"))
        drop += ["_k3", "_i3", "_o3"]
    return (out.withColumn(prefix + "input_per_1k", F.coalesce(*ins))
            .withColumn(prefix + "output_per_1k", F.coalesce(*outs))
            .drop(*drop))


def cost(tokens, rate_per_1k) -> Column:
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    r = F.col(rate_per_1k) if isinstance(rate_per_1k, str) else rate_per_1k
    return t.cast("double") / F.lit(1000.0) * r


def prompt_costs(docs: DataFrame, spark: SparkSession, model: str = "gpt-4",
                 text_col: str = "text", counter: TokenCounter = approx4,
                 output_tokens: int = LIBRARY_OUTPUT_TOKENS,
                 models: DataFrame | None = None) -> DataFrame:
    """Library-path costing (E1): one model for the corpus, flat output tokens,
    unknown price -> 0.0.  Adds tokens, input_cost, output_cost, total_cost."""
    reg = registry(models if models is not None else models_table(spark))
    priced = with_prices(docs.withColumn("_model", F.lit(model)).withColumn(
        "tokens", counter(F.col(text_col))), "_model", reg)
    inp = F.coalesce(cost("tokens", "input_per_1k"), F.lit(0.0))
    outp = F.coalesce(cost(F.lit(output_tokens), "output_per_1k"), F.lit(0.0))
    return (priced.withColumn("input_cost", inp).withColumn("output_cost", outp)
            .withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))
            .drop("_model", "input_per_1k", "output_per_1k"))


def estimate_costs(df: DataFrame, spark: SparkSession, model_col: str = "model",
                   tokens_col: str = "tokens", models: DataFrame | None = None) -> DataFrame:
    """Estimate-path costing (E3): per-row model, output priced at the input
    token count, registry -> alias -> tokenizer price, unknown -> null."""
    reg = registry(models if models is not None else models_table(spark))
    priced = with_prices(df, model_col, reg, tokenizer_prices(spark))
    return (priced.withColumn("input_cost", cost(tokens_col, "input_per_1k"))
            .withColumn("output_cost", cost(tokens_col, "output_per_1k"))
            .drop("input_per_1k", "output_per_1k"))


def compare_models(docs: DataFrame, spark: SparkSession, model_names: Sequence[str],
                   text_col: str = "text", counter: TokenCounter = approx4,
                   models: DataFrame | None = None) -> DataFrame:
    """Every document against every listed model.  The model list is a
    caller-supplied literal (bounded), broadcast into a map-side cross join."""
    if len(model_names) > 1000:
        raise ValueError("model list too long to broadcast")
    mdf = spark.createDataFrame([(m,) for m in model_names], "model string")
    counted = docs.withColumn("tokens", counter(F.col(text_col)))
    crossed = counted.crossJoin(F.broadcast(mdf))
    return estimate_costs(crossed, spark, "model", "tokens", models)


def savings(original_tokens, compressed_tokens, input_per_1k: float,
            monthly_invocations: int) -> dict[str, Column]:
    """Cost before/after and saved per month, with percentage."""
    o = F.col(original_tokens) if isinstance(original_tokens, str) else original_tokens
    c = F.col(compressed_tokens) if isinstance(compressed_tokens, str) else compressed_tokens
    price, n = F.lit(float(input_per_1k)), F.lit(float(monthly_invocations))
    before = o.cast("double") / 1000.0 * price * n
    after = c.cast("double") / 1000.0 * price * n
    return {
        "original_cost": before,
        "compressed_cost": after,
        "savings": before - after,
        # undefined (null) when the original costs nothing
        "savings_percentage": F.try_divide(before - after, before) * 100.0,
    }
