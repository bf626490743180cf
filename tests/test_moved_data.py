"""What plans send where: tables that grow with the input are shuffled, whatever Spark takes their size for."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorcal.operators import halo, lookup, model as m, network as net, quantiles


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def written_plans(monkeypatch, module) -> dict[str, list[str]]:
    """The plans of the tables that ``module`` writes, by name."""
    plans, write = {}, module.materialize

    def record(df, name="stage"):
        plans.setdefault(name, []).append(plan_of(df))
        return write(df, name)

    monkeypatch.setattr(module, "materialize", record)
    return plans


def _rows(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(i, (i % 17).cast("double").alias("a"), (i % 5).cast("double").alias("b"), (i % 17 + F.sin("id")).alias("y"))


def test_repeated_rows_of_the_importance_are_not_broadcast(spark):
    rows = _rows(spark)
    for est in (m.RidgeSpline(("a",), ("b",)), m.Forest(("a", "b"), trees=2, depth=2)):
        out = m.permutation_importance(est.fit(rows, "y"), rows, "y", ["id"], repeats=3)
        plan = plan_of(out)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert {r["feature"] for r in out.collect()} == {"a", "b"}


def _sites(spark, n=60):
    return spark.createDataFrame([(i, 30 + (i * i * 0.618) % 1 / 10, 114 + (i * i * 0.754) % 1 / 10) for i in range(n)], "site_id long, lat double, lon double")


def test_places_and_their_cubes_are_not_broadcast(spark, monkeypatch):
    plans = written_plans(monkeypatch, net)
    near = net.knn_sites(_sites(spark), 3)
    # The one table sent is that of the lookup, which knows its size.
    assert plans["cubes"][0].count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plans["cubes"][0]
    assert "BroadcastHashJoin" not in plan_of(near)
    assert near.count() == 180
    assert "BroadcastHashJoin" not in plan_of(net.site_distances(near.select("site_i", "site_j"), _sites(spark)))
    cells = plan_of(halo._destinations(_sites(spark), near, 8))
    assert cells.count("SortMergeJoin") >= 3


def test_large_parameters_are_dealt_by_key(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SMALL_ROWS", 0)
    plans = written_plans(monkeypatch, lookup)
    # Key 0 and the null key hold most rows; key 1 is heavy and has no parameters.
    key = F.when(F.col("id") < 40, 0).when(F.col("id") < 80, 1).when(F.col("id") < 120, None).otherwise(F.col("id")).cast("long")
    rows = spark.range(200).select("id", key.alias("k"))
    params = rows.select("k").distinct().where("k is null or k <> 1").withColumn("v", F.coalesce(F.col("k"), F.lit(-1)) * 10)
    out = lookup.beside(rows, params, ["k"])
    assert "BuildLeft" not in plans["heavy-params"][0] and "SortMergeJoin" not in plans["heavy-params"][0]
    assert "SortMergeJoin" in plan_of(out) and plan_of(out).count("BroadcastHashJoin") == 1
    want = {(i, k, None if k == 1 else (-1 if k is None else k) * 10) for i in range(200) for k in [0 if i < 40 else 1 if i < 80 else None if i < 120 else i]}
    assert {tuple(r) for r in out.collect()} == want
    assert lookup.beside(rows, params, ["k"], "inner").count() == 160


def test_trees_are_trained_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(m, "TASK_ROWS", 100, raising=False)
    rows = _rows(spark, 1000).coalesce(1)
    for kind, est in (("GBTRegressor", m.Boosted(("a", "b"), iterations=1)), ("RandomForestRegressor", m.Forest(("a", "b"), trees=2, depth=2))):
        seen, fit = [], getattr(m, kind).fit

        def record(self, df, fit=fit, seen=seen):
            seen.append(df.rdd.glom().map(len).collect())
            return fit(self, df)

        monkeypatch.setattr(getattr(m, kind), "fit", record)
        assert est.fit(rows, "y").transform(rows).count() == 1000
        assert sum(seen[0]) == 1000 and max(seen[0]) <= 200


def test_quantiles_of_many_groups_are_not_broadcast(spark, monkeypatch):
    rows = spark.range(6000).select((F.col("id") % 60).alias("k"), (F.col("id") * 7 % 5999).cast("double").alias("v"))
    before = {tuple(r) for r in quantiles.exact_medians(rows, ["v"], ["k"]).collect()}
    for module in (lookup, quantiles):
        monkeypatch.setattr(module, "SMALL_ROWS", 0, raising=False)
    for bucket in (quantiles.BUCKET, 0):
        monkeypatch.setattr(quantiles, "BUCKET", bucket)
        with monkeypatch.context() as inner:
            plans = written_plans(inner, quantiles)
            assert {tuple(r) for r in quantiles.exact_medians(rows, ["v"], ["k"]).collect()} == before
        # What is sent are the few heavy keys of the lookup, the only ones that are told by a mark.
        sent = [line for p in (*plans["quantiles"], *plans["ranks"]) for line in p.splitlines() if "BroadcastHashJoin" in line]
        assert all("_beside" in line or "_h_" in line for line in sent), sent
