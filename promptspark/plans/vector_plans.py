"""Plans for vectors (build step 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as ex
from ..operators import vectors as vc
from ..sources.tables import table
from . import register
from .compress_plans import sql_cosine
from .text_plans import SQL_SENTENCES, _sql_density, _sql_score

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"


def _sql_cos(a: str, b: str) -> str:
    na, nb = _NORM.format(a=a), _NORM.format(a=b)
    return (f"CASE WHEN len({a}) <> len({b}) OR {na} = 0 OR {nb} = 0 THEN 0.0 "
            f"ELSE {_DOT.format(a=a, b=b)} / ({na} * {nb}) END")


@register("vector_cosine", f"""
WITH p AS (SELECT a.vec_id, a.embedding AS va, b.embedding AS vb FROM embeddings a
           JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round({_sql_cos('va', 'vb')}, 9) AS cosine, round({_NORM.format(a='va')}, 9) AS norm,
       round(sqrt(list_sum(list_transform(va, lambda x: (x::DOUBLE / {_NORM.format(a='va')})
             * (x::DOUBLE / {_NORM.format(a='va')})))), 9) AS unit_norm
FROM p""")
def vector_cosine(spark, sf_dir):
    """V3 + V4 on consecutive embeddings."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vb"))
    p = e.select("vec_id", F.col("embedding").alias("va")).join(nxt, "vec_id")
    return p.select("vec_id", F.round(vc.cosine("va", "vb"), 9).alias("cosine"),
                    F.round(vc.norm("va"), 9).alias("norm"),
                    F.round(vc.norm(vc.normalize("va")), 9).alias("unit_norm"))


@register("mean_pool", """
SELECT label, CAST(d - 1 AS INTEGER) AS dim, round(avg(embedding[d]::DOUBLE), 9) AS mean
FROM embeddings, range(1, 65) AS r(d) WHERE d <= len(embedding)
GROUP BY label, d""")
def mean_pool(spark, sf_dir):
    """V6: per-label mean vector (long form)."""
    e = table(spark, sf_dir, "embeddings", "label", "embedding")
    return vc.mean_pool(e, "label", "embedding").withColumn("dim", F.col("dim").cast("int")) \
        .withColumn("mean", F.round("mean", 9))


@register("semantic_scores", f"""
WITH c AS (SELECT label, d, avg(embedding[d]::DOUBLE) AS m FROM embeddings, range(1, 65) AS r(d)
           WHERE d <= len(embedding) GROUP BY label, d),
cv AS (SELECT label, list(m ORDER BY d) AS v FROM c GROUP BY label),
s AS (SELECT e.vec_id, cv.label AS ref, {_sql_cos('e.embedding', 'cv.v')} AS cos
      FROM embeddings e CROSS JOIN cv),
b AS (SELECT vec_id, max(cos) AS max_cosine, arg_max(ref, (cos, ref)) AS best_ref FROM s GROUP BY vec_id),
t AS (WITH {SQL_SENTENCES} SELECT doc_id, {_sql_density('sentence')} AS density, least(n - 1, 2) + 1 AS n_context
      FROM x WHERE idx = 0)
SELECT vec_id, round(max_cosine, 9) AS max_cosine, best_ref,
       round(max_cosine * 50.0 + coalesce(density, 0.0) * 20.0
             + CASE WHEN coalesce(n_context, 0) = 0 THEN 1.0 ELSE 0.5 END, 9) AS semantic_score
FROM b LEFT JOIN t ON t.doc_id = b.vec_id""")
def semantic_scores(spark, sf_dir):
    """J11 + V7 on embeddings: the label centroids (V6) play the critical
    patterns; a vector's text is the first sentence of the document with its id,
    which gives the density and the position (no such text: no density, and the
    position of a sentence without context)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    cents = vc.pooled_vectors(vc.mean_pool(e, "label", "embedding"), "label")
    m = vc.best_match(e.select("vec_id", "embedding"), "embedding", cents, "label", "vector")
    first = ex.sentence_table(table(spark, sf_dir, "documents", "doc_id", "text", busy=True)).where("idx = 0").select(
        F.col("doc_id").alias("vec_id"), "density", "n_context")
    m = m.join(first, "vec_id", "left")
    score = vc.semantic_score("max_cosine", F.coalesce("density", F.lit(0.0)),
                              ex.position_score(F.coalesce("n_context", F.lit(0))))
    return m.select("vec_id", F.round("max_cosine", 9).alias("max_cosine"),
                    F.col("best_ref").alias("best_ref"), F.round(score, 9).alias("semantic_score"))


_HASH_DIM = 64


@register("hash_embed", f"""
WITH {SQL_SENTENCES},
c AS (SELECT doc_id, idx, {sql_cosine('sentence', _HASH_DIM)} AS cos, {_sql_density('sentence')} AS density,
             {_sql_score('sentence', ex.REFERENCE_RULES)} AS h FROM x)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(cos, 9) AS max_cosine,
       round(cos * 50.0 + density * 20.0 + 0.5, 9) AS semantic_score,
       round((cos * 50.0 + density * 20.0 + 0.5) * 0.7 + h * 0.3, 9) AS hybrid_score FROM c""")
def hash_embed(spark, sf_dir):
    """V5 + V7 hybrid on document sentences: hash embeddings scored against
    the hash embeddings of the critical phrases."""
    from ..operators.quality import CRITICAL_PATTERNS
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    sents = ex.sentence_table(docs).withColumn("vec", vc.hash_embed("sentence", _HASH_DIM))
    refs = spark.createDataFrame([(p,) for p in CRITICAL_PATTERNS], "phrase string") \
        .withColumn("vec", vc.hash_embed("phrase", _HASH_DIM))
    m = vc.best_match(sents, "vec", refs, "phrase", "vec")
    sem = vc.semantic_score("max_cosine", "density", ex.position_score("n_context"))
    return m.select("doc_id", "idx", F.round("max_cosine", 9).alias("max_cosine"),
                    F.round(sem, 9).alias("semantic_score"),
                    F.round(vc.hybrid_score(sem, F.col("score_0")), 9).alias("hybrid_score"))
