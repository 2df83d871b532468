"""Structured Streaming forms.

A job's sink and checkpoint live in the folder that its caller names; a job
started again with the same folder resumes where it stopped.  Without one, a
fresh folder under the session's ``spark.checkpoint.dir`` is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import approx4
from ..operators import conversations as cv
from ..operators import pricing
from ..session import ensure_checkpoint_dir


def run_dirs(spark: SparkSession, name: str, run_dir: str | None = None) -> tuple[str, str]:
    """(checkpoint, output) under ``run_dir``; a caller that passes the same
    folder again resumes.  Without one the run is a single one."""
    if run_dir is not None:
        return f"{run_dir.rstrip('/')}/checkpoint", f"{run_dir.rstrip('/')}/output"
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/streams/{name}-{uuid.uuid4().hex}"
    return f"{run}/checkpoint", f"{run}/output"


def file_stream(spark: SparkSession, folder: str, file_glob: str, schema: str) -> DataFrame:
    """A file-source stream over what in ``folder`` matches ``file_glob``: files, or
    folders with a table's part files (fixed schema: no inference on a stream).  The
    braces make any name a glob, as a stream takes a plain path for a folder."""
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{{{file_glob}}}")


def drain(writer, checkpoint: str):
    """Process everything available now, then stop (batch-like runs/tests)."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


# ------------------------------------------------------------------- T1

def token_estimates(stream: DataFrame, spark: SparkSession, model: str = "gpt-4",
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Re-estimate tokens and cost for every prompt that arrives (the
    price registry is a static broadcast side of a stream-static join)."""
    rows = stream.select(id_col, F.lit(model).alias("model"), approx4(F.col(text_col)).alias("tokens"))
    return pricing.estimate_costs(rows, spark, "model", "tokens")


def run_token_estimates(spark: SparkSession, folder: str, file_glob: str, schema: str,
                        run_dir: str | None = None) -> DataFrame:
    ckpt, out = run_dirs(spark, "token-estimate", run_dir)
    stream = file_stream(spark, folder, file_glob, schema)
    drain(token_estimates(stream, spark).writeStream.format("parquet").option("path", out)
          .outputMode("append"), ckpt)
    return spark.read.parquet(out)


# ------------------------------------------------------------------- T3

def request_metrics(requests: DataFrame, window: str = "1 hour", watermark: str = "1 hour",
                    slide: str | None = None, session_gap: str | None = None, keys: tuple = ()) -> DataFrame:
    """Live progress per event-time window (tumbling, sliding with ``slide``,
    or the sessions of each ``keys`` value with ``session_gap``): completed, ok, failed, mean latency of
    successes, requests per second.  Rows later than the watermark are dropped by
    the engine, which also ends the windows' state."""
    w = F.session_window("ts", session_gap) if session_gap else F.window("ts", window, slide)
    return (requests.withWatermark("ts", watermark).groupBy(*keys, w.alias("w"))
            .agg(F.count(F.lit(1)).alias("completed"), F.count_if("success").alias("ok"),
                 F.avg(F.when(F.col("success"), F.col("latency_ms"))).alias("avg_latency_ms"))
            .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "completed",
                    "ok", (F.col("completed") - F.col("ok")).alias("failed"), "avg_latency_ms",
                    (F.col("completed") / (F.col("w.end").cast("long") - F.col("w.start").cast("long")))
                    .alias("requests_per_sec")))


def run_request_metrics(spark: SparkSession, requests: DataFrame, run_dir: str | None = None,
                        **kw) -> DataFrame:
    """Update-mode stream; each micro-batch's changed windows are written to
    their own batch folder (overwrite = idempotent on replay) and the latest
    version of every window wins on read.  Sessions have no update mode: they are
    written once, when the watermark has passed them."""
    ckpt, out = run_dirs(spark, "request-metrics", run_dir)

    def write(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(request_metrics(requests, **kw).writeStream.outputMode("append" if kw.get("session_gap") else "update")
          .foreachBatch(write), ckpt)
    latest = spark.read.parquet(out)
    of = [*kw.get("keys", ()), "window_start"]
    top = latest.groupBy(*of).agg(F.max("batch_id").alias("batch_id"))
    return latest.join(top, [*of, "batch_id"]).drop("batch_id", "batch")


# ------------------------------------------------------------------- T2

def incremental_stream(turns: DataFrame, **kw) -> DataFrame:
    """Every turn's anchor as it arrives.  The stream keeps no totals: a turn
    that comes late would make kept totals wrong, and a conversation that never
    ends would keep its state for ever.  Totals are derived from the anchors on
    read, in turn order whatever the order of arrival."""
    return cv.turn_anchors(turns, **kw)


def run_incremental(spark: SparkSession, folder: str, file_glob: str, schema: str,
                    run_dir: str | None = None) -> DataFrame:
    ckpt, out = run_dirs(spark, "incremental", run_dir)
    stream = file_stream(spark, folder, file_glob, schema)
    drain(incremental_stream(stream).writeStream.format("parquet").option("path", out).outputMode("append"), ckpt)
    return cv.running_totals(spark.read.parquet(out)).drop("anchor_ratio")
