"""Anchors kept between runs."""

import pytest
from pyspark.sql import functions as F

from promptspark.operators import conversations as cv
from promptspark.sources.tables import table

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select(sorted(c for c in df.columns if c != "run")).collect())


@pytest.fixture(scope="module")
def turns(spark):
    return table(spark, SF, "conversations", "conv_id", "turn", "text")


def test_runs_over_parts_equal_one_run(spark, turns, tmp_path):
    whole = cv.conversation_anchors(turns)
    assert rows_of(whole.drop("anchor_id", "summary", "token_position")) == rows_of(cv.incremental_rollup(turns))
    folder = str(tmp_path / "kept")
    assert cv.load_anchors(spark, folder) is None
    some = F.col("conv_id") % 3
    # a later run sees old turns again, new turns of known conversations, and new conversations
    for k, part in enumerate((turns.where((F.col("turn") < 2) & (some != 0)), turns.where("turn < 3"), turns)):
        assert cv.save_turns(part, folder) == k + 1
    assert rows_of(cv.load_anchors(spark, folder)) == rows_of(whole)
    run, state = cv.load_state(spark, folder)
    assert run == 3 and rows_of(state) == rows_of(cv.state_after(whole))
    assert cv.save_turns(turns, folder) == 4 and rows_of(cv.load_anchors(spark, folder)) == rows_of(whole)


def test_a_run_that_broke_off_is_done_again(spark, turns, tmp_path):
    folder = str(tmp_path / "kept")
    cv.save_turns(turns.where("turn < 2"), folder)
    turns.where("turn < 3").limit(1).write.parquet(f"{folder}/turns/run=2")  # rows without a state
    assert rows_of(cv.load_anchors(spark, folder).select("conv_id", "turn")) == rows_of(
        turns.where("turn < 2").select("conv_id", "turn"))
    assert cv.save_turns(turns, folder) == 2
    assert rows_of(cv.load_anchors(spark, folder)) == rows_of(cv.conversation_anchors(turns))


def test_anchors_hold_their_text(spark):
    rows = spark.createDataFrame([(1, 0, "word " * 400), (1, 1, "short"), (2, 5, ""), (3, 1, None)],
                                 "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r for r in cv.conversation_anchors(rows).collect()}
    a = got[1, 0]
    assert len(a.anchor_id) == 32 and a.summary and a.anchor_tokens == -(-len(a.summary) // 4)
    assert a.token_position == a.summary_tokens and got[1, 1].anchor_id is None and got[1, 1].summary is None
    assert got[1, 1].total_tokens == 502 and got[2, 5].total_tokens == 0
