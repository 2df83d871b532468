import collections
import importlib

import pytest
from llm_cases import awkward, awkward_rows, empty, sf_dir_with

pipeline = importlib.import_module("corpus_pipeline")

LABELS = "doc_id long, quality int, toxic int"


def test_stages_are_the_five_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "bpe"]


@pytest.mark.parametrize("make", [awkward, empty])
def test_runs_on_awkward_and_empty_tables(spark, tmp_path, make):
    docs = make(spark).withColumnRenamed("lang", "kept")
    d = sf_dir_with(spark, tmp_path, documents=docs, labels=spark.createDataFrame([(0, 1, 0), (1, 0, 0)], LABELS),
                    benchmark=spark.createDataFrame([(1, " ".join(awkward_rows()[3][1].split()[:12])), (None, None)],
                                                    "item_id long, text string"))
    out = pipeline.run(spark, d)
    assert out.columns == [*docs.columns, "n_tokens", "ids", "decoded"]
    got = out.collect()
    if make is empty:
        assert got == []
    else:
        ids = collections.Counter(r.doc_id for r in got)
        assert {0, 1, 2, 4} <= set(ids) and 26 not in ids and 20 not in {r.doc_id for r in got if r.text == awkward_rows()[0][1]}


def test_stage_by_stage_against_the_small_tests_rules(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    fewer = pipeline.near_duplicates(spark, kept, sf)
    assert fewer.columns == docs.columns
    from test_minhash_links import brute
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in fewer.collect()) == sorted(int(i) for i, _, _, k in brute(rows) if k)
