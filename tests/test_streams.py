"""Streams over tables that are one file or a folder of part files."""

import pytest

from promptspark.plans import stream_plans


def table(spark, folder, name, rows, schema, parts):
    """``parts``: one task per file in a folder; 0: a single file."""
    df = spark.createDataFrame(rows, schema).repartition(max(parts, 1))
    if parts:
        df.write.parquet(str(folder / f"{name}.parquet"))
    else:
        df.write.parquet(str(folder / "written"))
        next((folder / "written").glob("part-*.parquet")).rename(folder / f"{name}.parquet")


@pytest.mark.parametrize("parts", [0, 3])
def test_token_estimates_of_files_and_folders(spark, tmp_path, parts):
    rows = [(i, "x" * i, "en", "s", i) for i in range(9)]
    table(spark, tmp_path, "documents", rows, stream_plans.DOCS_SCHEMA, parts)
    got = {r.doc_id: r.tokens for r in stream_plans.stream_token_estimate(spark, str(tmp_path)).collect()}
    assert got == {i: -(-i // 4) for i in range(9)}


@pytest.mark.parametrize("parts", [0, 3])
def test_incremental_of_files_and_folders(spark, tmp_path, parts):
    rows = [(c, t, "user", f"turn {t} of conversation {c}, said at some length") for c in range(3) for t in range(4)]
    table(spark, tmp_path, "conversations", rows, stream_plans.CONV_SCHEMA, parts)
    got = sorted((r.conv_id, r.turn) for r in stream_plans.stream_incremental(spark, str(tmp_path)).collect())
    assert got == [(c, t) for c in range(3) for t in range(4)]
