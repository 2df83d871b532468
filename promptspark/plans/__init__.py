"""Named query plans over the driver tables.

Each plan is a function ``(spark, sf_dir) -> DataFrame`` registered with
:func:`register`, optionally with the DuckDB SQL that must produce the same
rows (the correctness oracle).  Modules are imported for their side effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def _load() -> None:
    from . import (library_plans, text_plans, compress_plans, similarity_plans,  # noqa: F401
                   document_plans, conversation_plans, request_plans, vector_plans,
                   benchmark_plans, stream_plans)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
