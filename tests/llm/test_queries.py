"""Every query with SQL beside it gives the same rows; the pipeline's stages keep their contracts."""

import pytest

import corpus_pipeline
from compare import compare, connect
from llm_cases import prose
from sensorcal.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_sql(spark, key):
    assert compare(QUERIES[key](spark, SF), connect(SF), ORACLES[key]) == ""


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and 0 < out.count() <= 2 * rows, name
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.filter("start = 0").count() == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def test_pipeline_on_odd_rows(spark, odd, docs):
    for start in (odd, docs([(i, prose(i, 30), "en", "a", 1) for i in range(5)] + [(9, prose(1, 30), "en", "a", 1)]), docs([])):
        out = start
        for _, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.materialize(stage(spark, out, SF))
        out.collect()
