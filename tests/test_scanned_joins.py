"""A join with a small side in one scan: ids of any type, repeated ids, strict bounds."""

from pyspark.sql import functions as F

from promptspark.operators import similarity as sm


def test_ids_may_be_structs_with_nulls_on_either_side(spark):
    texts = spark.createDataFrame([(1, 0, "some words in a row"), (None, 1, "some words in a rov"), (1, 0, "nothing"), (2, 5, None)],
                                  "d long, i int, text string").select(F.struct("d", "i").alias("lid"), "text")
    lib = spark.createDataFrame([("p", "some words in a row"), ("p", "some words in a row"), (None, "nothing")], "rid string, text string")
    want = sorted([(1, 0, "p", 1.0), (1, 0, "p", 1.0), (None, 1, "p", 1 - 1 / 19), (None, 1, "p", 1 - 1 / 19)], key=repr)
    for left, right, ids in ((texts, lib, ("lid", "rid")), (lib, texts, ("rid", "lid"))):
        got = sm.similarity_join(left, right, 0.85, *ids)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange hashpartitioning" not in plan
        assert sorted(((r.lid.d, r.lid.i, r.rid, r.similarity) for r in got.collect()), key=repr) == want
    assert {r.similarity for r in sm.similarity_join(texts, lib, 1 - 1 / 19, "lid", "rid", strict=True).collect()} == {1.0}
