import pytest
from pyspark.sql import functions as F

from sensorcal.operators import lookup


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("small", [True, False])
def test_parameters_reach_their_rows(spark, monkeypatch, small, how):
    """One key holds a third of the rows; some keys have no parameters, one is NULL."""
    if not small:
        monkeypatch.setattr(lookup, "SMALL_ROWS", 0)
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    rows = spark.range(3000).select("id", key.alias("k"), F.lit(-1).alias("m"))
    params = spark.createDataFrame([("hot", 1), (None, 2), *[(f"k{i}", 10 + i) for i in range(30)], ("unused", 5)], "k string, m int")
    got = {r.id: (r.k, r.m) for r in lookup.beside(rows, params, ["k"], how).collect()}
    want = {"hot": 1, None: 2, **{f"k{i}": 10 + i for i in range(30)}}
    every = {r.id: (r.k, want.get(r.k)) for r in rows.collect()}
    assert got == {i: v for i, v in every.items() if how == "left" or v[0] in want}


def test_large_parameters_move_no_heavy_row_by_key(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SMALL_ROWS", 0)
    rows = spark.range(8000).select("id", (F.col("id") % 2 * F.col("id")).alias("k"))
    out = lookup.beside(rows, spark.range(8000).select(F.col("id").alias("k"), F.col("id").alias("m")), ["k"])
    assert out.where("m <> k").count() == 0 and out.count() == 8000
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
