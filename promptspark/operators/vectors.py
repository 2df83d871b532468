"""Vectors (V3-V7, J11).  Arrays of floats are folded in DOUBLE (the
reference accumulates in f32; doubles are the more precise choice here)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let, normalize_text, words

# Hash-embedding contribution per word, and the semantic score
# weights (max cosine, information density) with the position score added.
WORD_WEIGHT = 0.05
SEMANTIC_WEIGHTS = (50.0, 20.0)
HYBRID_WEIGHTS = (0.7, 0.3)
MAX_CENTROIDS = 100_000


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """V3: 0 on length mismatch or a zero vector."""
    na, nb = norm(a), norm(b)
    return F.when((F.size(col(a)) != F.size(col(b))) | (na == 0) | (nb == 0), F.lit(0.0)) \
        .otherwise(dot(a, b) / (na * nb))


def normalize(a) -> Column:
    """V4: unit length (zero vectors unchanged)."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))
                                .otherwise(F.transform(v, lambda x: x.cast("double")))))


def hash_embed(text, dim: int = 384) -> Column:
    """V5: the placeholder embedding's word part: every lower-cased word adds
    0.05 * (hash mod 10000 / 10000 * 2 - 1) at its position modulo ``dim``, then
    L2-normalised.  The hash is the first eight hex digits of the word's MD5
    (differs from the reference's hasher by design; any engine can repeat it)."""
    def weight(x):
        h = F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")
        return ((h % 10000) / 10000.0 * 2.0 - 1.0) * WORD_WEIGHT

    def fold(vals):
        # without words beyond ``dim`` nothing is added up
        n, places = F.size(vals), F.sequence(F.lit(0), F.lit(dim - 1))
        return F.when(n <= dim, F.concat(vals, F.array_repeat(F.lit(0.0), F.lit(dim) - n))).otherwise(
            let(F.sequence(F.lit(0), F.floor((n - 1) / dim).cast("int")), lambda rows: F.transform(
                places, lambda i: F.aggregate(rows, F.lit(0.0), lambda s, k: s + F.coalesce(
                    F.get(vals, k * dim + i), F.lit(0.0))))))

    return normalize(let(F.transform(words(F.lower(col(text))), weight), fold))


def hash_embed_values(text: str, dim: int) -> list[float]:
    """:func:`hash_embed` of one fixed text (a critical phrase), on the driver."""
    vals = [0.0] * dim
    for k, w in enumerate(text.lower().split()):
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        vals[k % dim] += ((h % 10000) / 10000.0 * 2.0 - 1.0) * WORD_WEIGHT
    n = math.sqrt(sum(v * v for v in vals))
    return [v / n for v in vals] if n else vals


def max_cosine(vec, refs: Sequence[Sequence[float]]) -> Column:
    """J11 against a fixed, caller-sized set of vectors: the highest cosine, at
    least 0."""
    unit = []
    for r in refs:
        n = math.sqrt(sum(x * x for x in r))
        unit.append([x / n for x in r] if n else list(r))
    # a place where the reference is 0 adds nothing: only the others are read
    lit = F.array(*[F.struct(F.lit(len(r)).alias("n"), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("x"))
                                                                 for i, x in enumerate(r) if x or not any(r)]).alias("at"))
                    for r in unit])

    def best(v, n):
        def dot_at(r):
            return F.aggregate(r["at"], F.lit(0.0), lambda s, p: s + F.get(v, p.i).cast("double") * p.x)
        return F.when(n > 0, F.aggregate(lit, F.lit(0.0), lambda m, r: F.greatest(
            m, F.when(F.size(v) == r.n, dot_at(r) / n)))).otherwise(F.lit(0.0))

    return let(vec, lambda v: let(norm(v), lambda n: best(v, n)))


def mean_pool(df: DataFrame, key: str, vec: str) -> DataFrame:
    """V6: element-wise mean of vectors per key, long form (key, dim, mean).
    Partial aggregation per (key, dim): a hot key spreads over its dims."""
    ex = df.select(key, F.posexplode(vec).alias("dim", "x"))
    return ex.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def pooled_vectors(long: DataFrame, key: str) -> DataFrame:
    """(key, vector) from the long form; one vector per key is bounded by
    the dimension."""
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))),
                                             lambda s: s.mean).alias("vector"))


def best_match(items: DataFrame, item_vec: str, refs: DataFrame, ref_key: str, ref_vec: str,
               max_refs: int = MAX_CENTROIDS) -> DataFrame:
    """For each item the highest cosine to any reference vector and that
    reference's key (ties: the larger key).  References are a bounded set
    (critical patterns, label centroids) - checked against ``max_refs`` -
    gathered into ONE array row that is broadcast and scanned per item, so no
    item x reference rows are materialised."""
    if refs.limit(max_refs + 1).count() > max_refs:
        raise ValueError(f"more than {max_refs} reference vectors; use a similarity join instead")
    # lengths once per vector, not once per pair
    bundle = refs.agg(F.collect_list(F.struct(F.col(ref_key).alias("k"), F.col(ref_vec).alias("v"),
                                              norm(ref_vec).alias("n"))).alias("_refs"))
    attached = items.withColumn("_n", norm(item_vec)).crossJoin(F.broadcast(bundle))  # one broadcast row per item: a map-side attach

    def of(r):
        cos = F.when((F.size(item_vec) != F.size(r.v)) | (F.col("_n") == 0) | (r.n == 0), F.lit(0.0)) \
            .otherwise(dot(item_vec, r.v) / (F.col("_n") * r.n))
        return F.struct(cos.alias("cos"), r.k.alias("k"))

    return attached.withColumn("_best", F.array_max(F.transform("_refs", of))) \
        .withColumn("max_cosine", F.col("_best.cos")).withColumn("best_ref", F.col("_best.k")) \
        .drop("_refs", "_best", "_n")


def semantic_score(max_cos, density, position) -> Column:
    """V7: 50 * max cosine + 20 * density + position score."""
    return col(max_cos) * SEMANTIC_WEIGHTS[0] + col(density) * SEMANTIC_WEIGHTS[1] + col(position)


def hybrid_score(semantic, heuristic) -> Column:
    return col(semantic) * HYBRID_WEIGHTS[0] + col(heuristic) * HYBRID_WEIGHTS[1]
