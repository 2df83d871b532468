"""Plans for conversations and incremental compression (build step 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversations as cv
from ..operators import extract as ex
from ..sources.tables import table
from . import register
from .compress_plans import SQL_FOLD
from .sqlsnip import tok
from .text_plans import _WS, sql_sentences

R = cv.RETENTION_TOKENS
RATIO = ex.LEVEL_RATIO["medium"]

SQL_SPLIT = f"""
sp AS (SELECT conv_id, turn, text, {tok('text')} AS n, least({R}, {tok('text')}) AS retain
       FROM conversations),
sp2 AS (SELECT conv_id, turn, text, n - retain AS summary_tokens, retain AS recent_tokens,
          CASE WHEN n - retain > 0 THEN substr(text, 1, CAST((n - retain) * 4 AS INTEGER)) ELSE '' END
            AS summary,
          CASE WHEN n - retain > 0 THEN substr(text, CAST((n - retain) * 4 AS INTEGER) + 1) ELSE text END
            AS recent
        FROM sp)"""


@register("summary_recent_split", f"""
WITH {SQL_SPLIT}
SELECT conv_id, turn, summary, recent, summary_tokens, recent_tokens FROM sp2""")
def summary_recent_split(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "text", busy=True)
    return conv.select("conv_id", "turn", cv.split_summary_recent("text", R).alias("p")) \
        .select("conv_id", "turn", "p.summary", "p.recent", "p.summary_tokens", "p.recent_tokens")


SQL_INCREMENTAL = "WITH " + SQL_SPLIT + """,
src AS (SELECT conv_id * 1000 + turn AS doc_id, summary AS text FROM sp2),""" + sql_sentences("src") + f""",
g AS (SELECT sp2.conv_id, sp2.turn, sp2.summary, sp2.summary_tokens, sp2.recent_tokens, s.sents,
             CAST(greatest(round(sp2.summary_tokens::DOUBLE * (1.0::DOUBLE - {RATIO}::DOUBLE)), 1.0)
                  AS BIGINT) AS tgt
      FROM sp2 JOIN s ON s.doc_id = sp2.conv_id * 1000 + sp2.turn),
{SQL_FOLD}a AS (SELECT conv_id, turn, summary_tokens, recent_tokens, summary_tokens > 0 AS has_anchor,
        CAST(CASE WHEN summary_tokens > 0 THEN {tok('''CASE WHEN len(sents) = 0 THEN summary ELSE
          array_to_string(list_transform(list_sort(fo.picks), lambda i: sents[i + 1]), ' ') END''')}
          ELSE 0 END AS BIGINT) AS anchor_tokens
      FROM w),
t AS (SELECT conv_id, turn, summary_tokens, recent_tokens, anchor_tokens,
        CASE WHEN has_anchor THEN anchor_tokens::DOUBLE / greatest(summary_tokens, 1) END AS anchor_ratio,
        CAST(sum(CASE WHEN has_anchor THEN 1 ELSE 0 END) OVER win AS BIGINT) AS n_anchors,
        CAST(sum(summary_tokens + recent_tokens) OVER win - (summary_tokens + recent_tokens) AS BIGINT)
          AS token_position_before,
        CAST(sum(summary_tokens + recent_tokens) OVER win AS BIGINT) AS total_tokens,
        CAST(sum(anchor_tokens) OVER win AS BIGINT) AS anchor_tokens_total
      FROM a WINDOW win AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""


@register("incremental_rollup", SQL_INCREMENTAL + """
SELECT *, anchor_tokens_total + recent_tokens AS compressed_tokens,
       greatest(total_tokens - (anchor_tokens_total + recent_tokens), 0) AS tokens_saved,
       CASE WHEN total_tokens > 0
            THEN greatest(total_tokens - (anchor_tokens_total + recent_tokens), 0)::DOUBLE / total_tokens
            ELSE 0.0 END AS compression_ratio
FROM t""")
def incremental_rollup(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "text", busy=True)
    out = cv.incremental_rollup(conv)
    return out.withColumn("n_anchors", F.col("n_anchors").cast("long"))


@register("conversation_anchors", SQL_INCREMENTAL + """
SELECT t.conv_id, t.turn, substr(sha256(t.conv_id || ':' || t.turn), 1, 32) AS anchor_id,
       CASE WHEN len(sents) = 0 THEN summary ELSE array_to_string(
         list_transform(list_sort(fo.picks), lambda i: sents[i + 1]), ' ') END AS summary,
       t.anchor_tokens AS summary_tokens, t.token_position_before + t.summary_tokens AS token_position,
       t.token_position_before AS original_tokens_before, t.anchor_ratio AS compression_ratio
FROM t JOIN w ON w.conv_id = t.conv_id AND w.turn = t.turn WHERE t.summary_tokens > 0""")
def conversation_anchors(spark, sf_dir):
    """Every anchor of every conversation with its text."""
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "text", busy=True)
    rows = cv.conversation_anchors(conv).where(F.col("anchor_id").isNotNull())
    return rows.select("conv_id", "turn", "anchor_id", "summary", F.col("anchor_tokens").alias("summary_tokens"),
                       "token_position", F.col("token_position_before").alias("original_tokens_before"),
                       F.col("anchor_ratio").alias("compression_ratio"))
