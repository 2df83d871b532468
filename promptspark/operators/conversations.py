"""Conversations: summary/recent split and incremental anchors (P2, C10,
A19, W5).

With the reference's default that a turn's retained text is not carried into
the next turn (M19), each turn's anchor depends only on that turn's text, so
the incremental state is a *window sum* over turns: anchors are compressed per
turn in one narrow stage, then running totals come from ordered window
aggregates per conversation.  The streaming form (``streaming.incremental``)
keeps the same totals in state and must agree with this batch form.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col
from ..functions.tokens import CHARS_PER_TOKEN, TokenCounter, approx4
from .extract import LEVEL_RATIO, REFERENCE_RULES, RuleSet, with_compressed_sentences

RETENTION_TOKENS = 50  # this corpus: turns average ~130 tokens (default 500)


def split_summary_recent(text, retention_tokens: int, counter: TokenCounter = approx4) -> Column:
    """P2 with the character tokenizer: the last ``retention`` tokens are
    recent, the rest summary; token k spans characters [4k, 4k+4).
    struct<summary, recent, summary_tokens, recent_tokens>."""
    t = col(text)
    n = counter(t)
    retain = F.least(F.lit(retention_tokens).cast("long"), n)
    summary_len = n - retain
    cut = (summary_len * int(CHARS_PER_TOKEN)).cast("int")
    return F.struct(
        F.when(summary_len > 0, F.substring(t, 1, cut)).otherwise(F.lit("")).alias("summary"),
        F.when(summary_len > 0, F.substring(t, cut + 1, F.char_length(t))).otherwise(t).alias("recent"),
        summary_len.alias("summary_tokens"), retain.alias("recent_tokens"))


def turn_anchors(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 text_col: str = "text", level: str = "medium",
                 retention_tokens: int = RETENTION_TOKENS, rules: RuleSet = REFERENCE_RULES,
                 counter: TokenCounter = approx4, anchor_threshold: int = 0, with_text: bool = False) -> DataFrame:
    """Stateless half of C10 (usable in a stream): per turn, the summary /
    recent split and the turn's anchor - its summary span compressed to
    max(round(n * (1 - r)), 1) tokens - when the span is non-empty and at
    least ``anchor_threshold`` tokens.  ``with_text`` adds the anchor's own
    text (``summary``, null without an anchor)."""
    r = LEVEL_RATIO[level]
    s = turns.select(conv_col, turn_col, split_summary_recent(text_col, retention_tokens, counter).alias("p"))
    s = s.select(conv_col, turn_col, "p.summary", "p.summary_tokens", "p.recent_tokens") \
        .withColumn("has_anchor", (F.col("summary_tokens") > 0) & (F.col("summary_tokens") >= anchor_threshold)) \
        .withColumn("_tgt", F.greatest(F.round(F.col("summary_tokens").cast("double") * (1.0 - r)),
                                       F.lit(1.0)).cast("bigint"))
    s = with_compressed_sentences(s, "summary", "_tgt", "_c", rules, counter)
    text = [F.when(F.col("has_anchor"), F.col("_c.text")).alias("summary")] if with_text else []
    return s.select(conv_col, turn_col, "summary_tokens", "recent_tokens", "has_anchor", *text,
                    F.when(F.col("has_anchor"), counter(F.col("_c.text"))).otherwise(F.lit(0)).cast("long")
                    .alias("anchor_tokens")) \
        .withColumn("anchor_ratio", F.when(F.col("has_anchor"), F.col("anchor_tokens")
                                           / F.greatest(F.col("summary_tokens"), F.lit(1))))


def with_totals(df: DataFrame) -> DataFrame:
    """compressed = anchor summaries so far + this turn's retained tokens."""
    return (df.withColumn("compressed_tokens", F.col("anchor_tokens_total") + F.col("recent_tokens"))
            .withColumn("tokens_saved", F.greatest(F.col("total_tokens") - F.col("compressed_tokens"), F.lit(0)))
            .withColumn("compression_ratio", F.when(F.col("total_tokens") > 0,
                                                    F.col("tokens_saved") / F.col("total_tokens"))
                        .otherwise(F.lit(0.0))))


TURN_CHUNK = 4096  # turns per running-sum block


def incremental_rollup(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                       text_col: str = "text", chunk: int = TURN_CHUNK, **kw) -> DataFrame:
    """C10 + A19 in batch: per-turn anchors, then running totals."""
    return running_totals(turn_anchors(turns, conv_col, turn_col, text_col, **kw), conv_col, turn_col, chunk)


def running_totals(anchors: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   chunk: int = TURN_CHUNK) -> DataFrame:
    """Running totals per conversation in turn order (W5) as a two-level prefix
    sum, so even a conversation holding a large share of all turns is never
    sorted in one task: running sums inside blocks of ``chunk`` turns, plus each
    block's offset from a window over the (few) block totals."""
    s = anchors.withColumn("_seen", F.col("summary_tokens") + F.col("recent_tokens")) \
        .withColumn("_a", F.col("has_anchor").cast("long")) \
        .withColumn("_blk", F.floor(F.col(turn_col) / chunk))
    run = Window.partitionBy(conv_col, "_blk").orderBy(turn_col).rowsBetween(Window.unboundedPreceding, 0)
    local = s.select(conv_col, turn_col, "_blk", "summary_tokens", "recent_tokens", "anchor_tokens",
                     "anchor_ratio", "_seen",
                     F.sum("_a").over(run).alias("_la"), F.sum("_seen").over(run).alias("_ls"),
                     F.sum("anchor_tokens").over(run).alias("_lt"))
    blocks = s.groupBy(conv_col, "_blk").agg(F.sum("_a").alias("_ba"), F.sum("_seen").alias("_bs"),
                                             F.sum("anchor_tokens").alias("_bt"))
    before = Window.partitionBy(conv_col).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(conv_col, "_blk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c + "_off")
                                                for c in ("_ba", "_bs", "_bt")])
    out = local.join(offsets, [conv_col, "_blk"]).select(
        conv_col, turn_col, "summary_tokens", "recent_tokens", "anchor_tokens", "anchor_ratio",
        (F.col("_la") + F.col("_ba_off")).alias("n_anchors"),
        (F.col("_ls") + F.col("_bs_off") - F.col("_seen")).alias("token_position_before"),
        (F.col("_ls") + F.col("_bs_off")).alias("total_tokens"),
        (F.col("_lt") + F.col("_bt_off")).alias("anchor_tokens_total"))
    return with_totals(out)


# ------------------------------------------------ anchors kept between runs

#: What is known of a conversation after its last turn so far.
STATE = ("last_turn", "total_tokens", "n_anchors", "anchor_tokens_total")


def anchor_id(conv, turn) -> Column:
    """An anchor's name: the same on every run."""
    return F.substring(F.sha2(F.concat_ws(":", col(conv).cast("string"), col(turn).cast("string")), 256), 1, 32)


def conversation_anchors(turns: DataFrame, state: DataFrame | None = None, conv_col: str = "conv_id",
                         turn_col: str = "turn", text_col: str = "text", chunk: int = TURN_CHUNK, **kw) -> DataFrame:
    """C10 with the anchors themselves: the rows of :func:`incremental_rollup` with
    ``anchor_id``, ``summary`` (the anchor's text) and ``token_position`` (where its
    span ends in the conversation), null for a turn without an anchor.  ``state``
    (conversation and ``STATE``) goes before: its totals are carried on, and turns
    up to its last one, which it holds already, are left out."""
    if state is not None:
        last = state.select(conv_col, "last_turn")
        turns = turns.join(last, conv_col, "left").where(
            F.col("last_turn").isNull() | (F.col(turn_col) > F.col("last_turn"))).drop("last_turn")
    anchors = turn_anchors(turns, conv_col, turn_col, text_col, with_text=True, **kw)
    rows = running_totals(anchors.drop("summary"), conv_col, turn_col, chunk)
    if state is not None:
        known = state.select(conv_col, *[F.col(c).alias(f"_{c}") for c in STATE[1:]])
        rows = rows.join(known, conv_col, "left")
        for c, before in (("total_tokens", "_total_tokens"), ("token_position_before", "_total_tokens"),
                          ("n_anchors", "_n_anchors"), ("anchor_tokens_total", "_anchor_tokens_total")):
            rows = rows.withColumn(c, F.col(c) + F.coalesce(before, F.lit(0)))
        rows = with_totals(rows.drop(*[f"_{c}" for c in STATE[1:]]))
    rows = rows.join(anchors.select(conv_col, turn_col, "has_anchor", "summary"), [conv_col, turn_col])
    return rows.withColumn("anchor_id", F.when(F.col("has_anchor"), anchor_id(conv_col, turn_col))) \
        .withColumn("token_position", F.when(F.col("has_anchor"), F.col("token_position_before") + F.col("summary_tokens"))) \
        .drop("has_anchor")


def state_after(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conversation, ``STATE``) after the rows of :func:`conversation_anchors`."""
    return rows.groupBy(conv_col).agg(F.max(F.struct(
        F.col(turn_col).alias("last_turn"), *STATE[1:])).alias("s")).select(conv_col, "s.*")


def _kept(spark, folder: str, what: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder.rstrip('/')}/{what}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_state(spark, folder: str, conv_col: str = "conv_id") -> tuple[int, DataFrame | None]:
    """(last finished run, state of every conversation) of a folder."""
    kept = _kept(spark, folder, "state")
    if kept is None:
        return 0, None
    newest = kept.groupBy(conv_col).agg(F.max(F.struct("run", *STATE)).alias("s"))
    return int(kept.agg(F.max("run")).first()[0] or 0), newest.select(conv_col, *[F.col(f"s.{c}") for c in STATE])


def load_anchors(spark, folder: str) -> DataFrame | None:
    """The rows of all finished runs."""
    run, _ = load_state(spark, folder)
    rows = _kept(spark, folder, "turns")
    return None if rows is None else rows.where(F.col("run") <= run)


def save_turns(turns: DataFrame, folder: str, conv_col: str = "conv_id", turn_col: str = "turn", **kw) -> int:
    """Work on the turns that ``folder`` doesn't hold yet and add them to it.  A
    run writes its rows first and its state last; rows of a run that ended in between
    are written again by the next one.  Only new turns are compressed, and only
    conversations with new turns get a new state.  Returns the run's number."""
    spark = turns.sparkSession
    done, state = load_state(spark, folder, conv_col)
    run, at = done + 1, folder.rstrip("/")
    conversation_anchors(turns, state, conv_col, turn_col, **kw).write.mode("overwrite").parquet(f"{at}/turns/run={run}")
    rows = spark.read.parquet(f"{at}/turns/run={run}")
    state_after(rows, conv_col, turn_col).write.mode("overwrite").parquet(f"{at}/state/run={run}")
    return run
