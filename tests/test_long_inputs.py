"""Steps that are computed once where they are read several times."""

from conftest import one
from pyspark.sql import functions as F

from promptspark.operators import extract, quality, vectors


def _times(df, function):
    return df._jdf.queryExecution().optimizedPlan().toString().count(function)


def test_keywords_once(spark):
    df = spark.range(1).select(F.lit("a b").alias("a"), F.col("id").cast("string").alias("b"))
    k = df.repartition(1).select(quality.keyword_retention("a", "b").alias("r"))
    assert _times(k, "array_except") == 2


def test_hash_embedding_once(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("t")).repartition(1)
    assert _times(df.select(vectors.hash_embed("t", 8).alias("v")), "md5(") <= 1
    scored = df.select(extract.semantic_part(F.col("t"), extract.CompressionConfig()).alias("s"))
    assert _times(scored, "md5(") <= 1


def test_hash_embedding_of_few_and_many_words(spark):
    for n in (0, 1, 4, 5, 9):
        text = " ".join(f"w{i}" for i in range(n))
        got = one(spark.createDataFrame([(text,)], "t string").select(vectors.hash_embed("t", 4).alias("v"))).v
        assert [round(x, 12) for x in got] == [round(x, 12) for x in vectors.hash_embed_values(text, 4)]
