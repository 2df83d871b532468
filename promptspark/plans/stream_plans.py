"""Streaming plans: each drains the table as a file stream (availableNow)
into a sink under spark.checkpoint.dir and returns the sink's contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from . import register
from .conversation_plans import SQL_INCREMENTAL
from .request_plans import _SQL_LOG, render_responses, requests_from
from .sqlsnip import tok

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EVENTS_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
CONV_SCHEMA = "conv_id long, turn long, role string, text string"


@register("stream_token_estimate", f"""
SELECT doc_id, 'gpt-4' AS model, {tok('text')} AS tokens,
       {tok('text')}::DOUBLE / 1000.0 * 0.03::DOUBLE AS input_cost,
       {tok('text')}::DOUBLE / 1000.0 * 0.06::DOUBLE AS output_cost
FROM documents""")
def stream_token_estimate(spark, sf_dir):
    return jobs.run_token_estimates(spark, sf_dir, "documents.parquet", DOCS_SCHEMA)


@register("stream_request_metrics", "WITH " + _SQL_LOG + """
SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start,
       time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end,
       count(*) AS completed, count(*) FILTER (WHERE success) AS ok,
       count(*) - count(*) FILTER (WHERE success) AS failed,
       avg(latency_ms) FILTER (WHERE success) AS avg_latency_ms,
       count(*) / 3600.0 AS requests_per_sec
FROM lg GROUP BY 1""")
def stream_request_metrics(spark, sf_dir):
    events = jobs.file_stream(spark, sf_dir, "events.parquet", EVENTS_SCHEMA)
    return jobs.run_request_metrics(spark, requests_from(render_responses(events)))


@register("stream_incremental", SQL_INCREMENTAL + """
SELECT conv_id, turn, summary_tokens, recent_tokens, anchor_tokens, n_anchors, token_position_before,
       total_tokens, anchor_tokens_total, anchor_tokens_total + recent_tokens AS compressed_tokens,
       greatest(total_tokens - (anchor_tokens_total + recent_tokens), 0) AS tokens_saved,
       CASE WHEN total_tokens > 0
            THEN greatest(total_tokens - (anchor_tokens_total + recent_tokens), 0)::DOUBLE / total_tokens
            ELSE 0.0 END AS compression_ratio
FROM t""")
def stream_incremental(spark, sf_dir):
    """T2 must equal the batch incremental_rollup (same oracle)."""
    return jobs.run_incremental(spark, sf_dir, "conversations.parquet", CONV_SCHEMA)
