"""Line dedup and near duplicates move and keep no more than they need."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from sensorcal import runtime
from sensorcal.llm import jaccard, lines
from sensorcal.llm.common import may_meet


def kept_tables(folder: str) -> set[str]:
    return {os.path.basename(p).rsplit("-", 1)[0] for p in glob.glob(f"{folder}/sensorcal/*") if os.path.exists(f"{p}/_SUCCESS")}


def _docs(spark):
    line = "one two three four five six seven eight nine ten eleven "
    texts = [line + str(i % 30) + "\n" + " ".join(f"w{i}x{k}" for k in range(15)) for i in range(80)]
    return spark.createDataFrame([*enumerate(texts), (None, None), (None, "")], "doc_id long, text string")


def test_texts_that_lose_nothing_stay_where_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    out = lines.line_dedup(_docs(spark))
    assert kept_tables(str(tmp_path)) == {"removed"}
    assert "Union" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r["_removed"] for r in out.collect() if r["doc_id"] is not None}
    assert got == {i: [0] if i >= 30 else None for i in range(80)}
    assert out.where("doc_id is null and _removed is null").count() == 2


def test_near_duplicates_leave_only_what_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    docs = _docs(spark)
    assert jaccard.one_of_each(docs.union(docs)).count() == 84
    assert not kept_tables(str(tmp_path)) & {"prefixes", "units", "grouppairs", "lists", "links", "labels", "named"}


def test_rows_that_may_meet_a_table(spark):
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("t").alias("_word"))
    table = spark.range(0, 4000, 7).select(F.when(F.col("id") > 0, F.col("id")).alias("o"))
    found, others = may_meet(rows, "k", table, "o")
    assert found.columns == others.columns == rows.columns
    assert found.count() + others.count() == 3000 and found.count() < 500
    assert {r[0] for r in others.select("k").collect()}.isdisjoint({r[0] for r in table.collect()})
    assert may_meet(rows, "k", table.limit(0), "o")[1].count() == 3000
