"""Operators for preparing large text collections as training data.

Each module holds one operator: a general interface (DataFrames in, DataFrames
out, real outputs such as cleaned texts, spans and groups) and the thin
``opN_<name>`` query that derives its digest columns from that operator.  The
rest of the library imports nothing from here.
"""

from __future__ import annotations


def _modules():
    from . import (bpe_codec, conditional_field_pii, credential_links, decision_lists, html_extraction, line_dedup,
                   maximal_repeats, minhash_links, ngram_scores, periodic_runs, rtree_negatives, sentence_spans,
                   suffix_automaton)

    return (suffix_automaton, maximal_repeats, sentence_spans, credential_links, decision_lists, bpe_codec,
            ngram_scores, line_dedup, conditional_field_pii, minhash_links, rtree_negatives, periodic_runs,
            html_extraction)


def queries() -> dict:
    """``opN_<name>`` -> callable(spark, sf_dir)."""
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict:
    """DuckDB SQL for the queries that SQL can express on whole tables."""
    return {m.NAME: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
