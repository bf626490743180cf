"""Queries of tree models train at full size, and a forest of several batches is one forest."""

from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sensorcal.operators import model as m
from sensorcal.queries import QUERIES
from sensorcal.runtime import checkpointed, scratch_path
from sensorcal.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines"))
    rows = [(i, i % 7, i % 11, i % 5, date(2024, 1, 1) + timedelta(days=i % 300), "ANR"[i % 3], 900.0 + 37 * i, i % 10 / 100, float(i % 50), i % 9 / 100) for i in range(420)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_returnflag string, l_extendedprice double, l_discount double, l_quantity double, l_tax double"
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def trained(monkeypatch, kind, **small):
    """Models of this kind as they are asked for; trained is a small one in place of each."""
    seen, fit = [], kind.fit

    def record(self, df, label):
        seen.append(self)
        return fit(replace(self, **small), df, label)

    monkeypatch.setattr(kind, "fit", record)
    return seen


def test_boosting_runs_all_iterations(spark, lines, monkeypatch):
    seen = trained(monkeypatch, m.Boosted, iterations=1)
    assert QUERIES["gbt_fit"](spark, lines).count() == 3
    assert [(x.iterations, x.depth) for x in seen] == [(800, 4)]


def test_selection_runs_all_folds_and_iterations(spark, lines, monkeypatch):
    seen = trained(monkeypatch, m.Boosted, iterations=1)
    rows = QUERIES["model_select"](spark, lines).collect()
    assert {r.model for r in rows} == {"ridge_spline", "boosted"} and sum(r.selected for r in rows) == 1
    assert [(x.iterations, x.depth) for x in seen] == [(800, 4)] * 5


def test_forest_grows_all_trees(spark, lines, monkeypatch):
    seen = trained(monkeypatch, m.Forest, trees=2, depth=2)
    assert QUERIES["rf_fit"](spark, lines).count() == 3
    assert [(x.trees, x.depth) for x in seen] == [(600, 30)]


def test_batches_make_one_forest(spark, monkeypatch):
    i = F.col("id")
    rows = spark.range(300).select(i, (i % 17).cast("double").alias("a"), (i % 5).cast("double").alias("b"), (i % 17 + F.sin("id")).alias("y"))
    monkeypatch.setattr(m, "BATCH_TREES", 2)
    fitted = m.Forest(("a", "b"), trees=5, depth=30).fit(rows, "y")
    parts = [s for s in fitted.pipeline.stages if hasattr(s, "trees")]
    assert [p.getNumTrees for p in parts] == [2, 2, 1]
    trees = [t for p in parts for t in p.trees]
    assert len({t.toDebugString.split("\n", 1)[1] for t in trees}) == 5
    out = fitted.transform(rows)
    assert out.columns == [*rows.columns, "prediction"]
    got = [r.prediction for r in out.where("id < 20").orderBy("id").collect()]
    vectors = [r[0] for r in fitted.pipeline.stages[1].transform(fitted.pipeline.stages[0].transform(rows)).where("id < 20").orderBy("id").select("_features").collect()]
    assert got == pytest.approx([sum(t.predict(v) for t in trees) / 5 for v in vectors])
    path = scratch_path(spark, "model")
    save_model(spark, fitted, path)
    again = load_model(spark, path)[0].transform(rows).where("id < 20").orderBy("id").collect()
    assert [r.prediction for r in again] == got


def test_iterations_are_checkpointed(spark):
    checkpointed(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    rows = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    assert m.Boosted(("a",), iterations=12).fit(rows, "y").transform(rows).count() == 60
