"""Token counting as Column expressions.

A *token counter* is any ``Column -> Column`` function returning a LONG count.
The default, :func:`approx4`, is the reference's character fallback and runs
entirely inside Catalyst/codegen.  Callers with a real tokenizer pass their own
counter, typically an iterator pandas UDF (see :func:`pandas_counter`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TokenCounter = Callable[[Column], Column]

# Fixed value: characters per token of the fallback estimator.
CHARS_PER_TOKEN = 4.0


def approx4(text: Column) -> Column:
    """ceil(code points / 4) as LONG; null text counts as 0."""
    return F.coalesce(F.ceil(F.char_length(text) / F.lit(CHARS_PER_TOKEN)),
                      F.lit(0)).cast("long")


def tokens_to_chars(tokens: Column) -> Column:
    """Inverse of the fallback estimator: the character span of ``tokens``."""
    return (tokens * F.lit(int(CHARS_PER_TOKEN))).cast("int")


def pandas_counter(encode: Callable[[str], list]) -> TokenCounter:
    """Wrap a caller's ``str -> token list`` function as an Arrow-batched
    counter (the tokenizer hook).  ``encode`` is loaded once per worker."""
    import pandas as pd

    @F.pandas_udf("long")
    def _count(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: len(encode(t))).astype("int64")

    return lambda c: _count(c)
