"""From raw documents to tokens: quality rules, line deduplication, near-duplicate
removal, benchmark decontamination, BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), where
``docs`` is what its predecessor kept, and returns a DataFrame.  All but the last
return the columns of their input; the last adds the token ids.  A stage's result
is written as Parquet and read again for the next one, which cuts the lineage: a
lost executor costs at most the tasks of the running stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from promptspark.llm import bpe_codec, common, decision_lists, line_dedup, minhash_links, suffix_automaton

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    labels = common.read(spark, sf_dir, "labels", "doc_id", "quality")
    return decision_lists.keep_good(docs, labels)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_links.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; mostly contaminated documents go."""
    return suffix_automaton.decontaminate(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding."""
    return bpe_codec.bpe(docs, bpe_codec.default_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages are kept in the
    shared checkpoint folder."""
    folder = f"{common.checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
