import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorcal.operators import calibrate as cal, features as feat, model as m, ordering
from sensorcal.plans.calibration import calibrate_channel
from sensorcal.runtime import scratch_path
from sensorcal.sources import files
from sensorcal.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    a, b, c = rng.uniform(0, 10, (3, 400))
    y = np.sin(a) * 5 + 0.5 * b + rng.normal(0, 0.1, 400)
    data = [(i, float(a[i]), None if i % 50 == 0 else float(b[i]), float(c[i]), float(y[i])) for i in range(400)]
    return spark.createDataFrame(data, "id int, a double, b double, c double, y double").cache()


def design(a, b, c, train):
    """Spline columns of a and standardized columns, in NumPy."""
    lo, hi = a[train].min(), a[train].max()
    pos = (np.clip(a, lo, hi) - lo) * 5 / (hi - lo)
    cols = []
    for j in range(7):
        d = np.abs(pos + 1 - j)
        cols.append(np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0)))
    med = np.nanmedian(b[train])
    cols += [np.where(np.isnan(b), med, b), c]
    x = np.stack(cols, 1)
    return (x - x[train].mean(0)) / x[train].std(0)


def test_ridge_equals_closed_form(rows):
    pdf = rows.toPandas().sort_values("id")
    train = (pdf["id"] < 300).to_numpy()
    x = design(*(pdf[k].to_numpy(float) for k in "abc"), train)
    y = pdf["y"].to_numpy()
    xt, yt = x[train], y[train]
    w = np.linalg.solve(xt.T @ xt + 2.0 * np.eye(x.shape[1]), xt.T @ (yt - yt.mean()))
    want = x @ w + yt.mean()
    fitted = m.RidgeSpline(("a",), ("b", "c")).fit(rows.where("id < 300"), "y")
    got = [r.prediction for r in fitted.transform(rows).orderBy("id").collect()]
    np.testing.assert_allclose(got, want, atol=1e-7)


def test_spline_columns_sum_below_one(rows):
    out = feat.bspline_basis(rows, "a").select(*[f"a_s{j}" for j in range(7)]).toPandas().to_numpy()
    assert (out >= -1e-12).all() and (out.sum(1) <= 1 + 1e-9).all()


def test_trees_beat_the_mean(rows):
    y = np.array([r.y for r in rows.collect()])
    for est in (m.Boosted(("a", "b", "c"), iterations=8, rate=0.3), m.Forest(("a", "b", "c"), trees=8, depth=8)):
        err = est.fit(rows, "y").transform(rows).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
        assert err < 0.7 * y.std()


def test_importance_finds_the_drivers_and_repeats(rows):
    fitted = m.RidgeSpline(("a",), ("b", "c")).fit(rows, "y")
    imp = m.permutation_importance(fitted, rows, "y", ["id"], repeats=4, seed=1)
    first = {r.feature: r.importance_mean for r in imp.collect()}
    again = {r.feature: r.importance_mean for r in m.permutation_importance(fitted, rows, "y", ["id"], repeats=4, seed=1).collect()}
    assert first["a"] > 1 and first["b"] > 0.5 and abs(first["c"]) < 0.2
    assert first == pytest.approx(again)


def test_keyed_numbers_are_permutations(spark):
    from sensorcal.operators.bijection import permuted

    for n in (1, 2, 3, 5, 16, 97, 400, 4099):
        df = spark.range(n).crossJoin(spark.range(3).select((F.col("id") * 977).alias("k")))
        places = {}
        for r in permuted(df, "id", "k", n, "to").collect():
            places.setdefault(r.k, {})[r.id] = r.to
        assert all(sorted(p.values()) == list(range(n)) for p in places.values())
        if n == 4099:
            moves = np.array([[p[i] for i in range(n)] for p in places.values()])
            assert (np.abs(np.corrcoef(np.vstack([np.arange(n), moves]))[np.triu_indices(4, 1)]) < 0.06).all()
            assert len(set(np.diff(moves[0]).tolist())) > n / 4  # no regular stride


def test_importance_of_both_kinds_of_models_agrees(rows):
    """The short way of a sum and the general way score the same permutations."""
    fitted = m.RidgeSpline(("a",), ("b", "c")).fit(rows, "y")
    plain = m.Fitted(fitted.pipeline, fitted.features, fitted.name)
    one, two = ({r.feature: (r.importance_mean, r.importance_std) for r in m.permutation_importance(x, rows, "y", ["id"], repeats=3).collect()} for x in (fitted, plain))
    assert one.keys() == two.keys() == {"a", "b", "c"}
    for c in one:
        assert one[c] == pytest.approx(two[c], abs=1e-9)


def test_importance_equals_brute_force(rows):
    from sensorcal.operators.bijection import permuted

    fitted = m.RidgeSpline(("a",), ("b",)).fit(rows, "y")
    data = rows.orderBy("id").toPandas()
    n = len(data)
    spark = rows.sparkSession
    errors = []
    for r in range(3):
        to = [x.to for x in permuted(spark.range(n).withColumn("k", F.lit(r).cast("long")), "id", "k", n, "to").orderBy("id").collect()]
        moved = spark.createDataFrame(list(zip(to, data["a"].tolist())), "id int, a double")
        out = fitted.transform(rows.drop("a").join(moved, "id")).toPandas()
        errors.append(np.sqrt(((out.y - out.prediction) ** 2).mean()))
    base = fitted.transform(rows).toPandas()
    got = {r.feature: r for r in m.permutation_importance(fitted, rows, "y", ["id"], repeats=3).collect()}["a"]
    assert got.importance_mean == pytest.approx(np.mean(errors) - np.sqrt(((base.y - base.prediction) ** 2).mean()), abs=1e-9)
    assert got.importance_std == pytest.approx(np.std(errors), abs=1e-9)


def test_dependence_of_both_kinds_of_models_agrees(rows):
    fitted = m.RidgeSpline(("a",), ("b", "c")).fit(rows, "y")
    plain = m.Fitted(fitted.pipeline, fitted.features, fitted.name)
    one, two = ({(r.feature, r.value): r.mean_prediction for r in m.partial_dependence(x, rows, ["a", "b"], points=7).collect()} for x in (fitted, plain))
    assert len(one) == 14 and one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


def test_partial_dependence_follows_a_line(rows):
    fitted = m.RidgeSpline((), ("a", "b", "c"), alpha=0.0).fit(rows.withColumn("line", F.col("a") * 3), "line")
    pd = m.partial_dependence(fitted, rows, ["a"], points=10).orderBy("value").collect()
    slope = (pd[-1].mean_prediction - pd[0].mean_prediction) / (pd[-1].value - pd[0].value)
    assert len(pd) == 10 and slope == pytest.approx(3, abs=1e-6)


def test_selection_prefers_the_earlier_on_ties(rows):
    df = ordering.time_series_folds(rows, ["id"], 2)
    one, two = m.RidgeSpline((), ("a",), name="one"), m.RidgeSpline((), ("a",), name="two")
    best, scores = m.model_select([one, two], df, "y", 2)
    assert best.name == "one" and scores["one"]["cv_rmse"] == pytest.approx(scores["two"]["cv_rmse"])


def test_saved_model_scores_alike(spark, rows):
    fitted = m.RidgeSpline(("a",), ("b",)).fit(rows, "y")
    path = scratch_path(spark, "model")
    save_model(spark, fitted, path, target="y")
    loaded, flags = load_model(spark, path)
    assert flags == {"target": "y"} and loaded.features == ("a", "b")
    gap = fitted.transform(rows).withColumnRenamed("prediction", "p").join(loaded.transform(rows).select("id", "prediction"), "id")
    assert gap.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] == 0


def test_posthoc_identity_below_min_points(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0)], "k string, t double, p double")
    out = {r.k: r for r in cal.fit_posthoc(df, "t", "p", ["k"], 2).collect()}
    assert (out["a"].a, out["a"].fitted) == (0.5, True) and (out["b"].a, out["b"].b, out["b"].fitted) == (1.0, 0.0, False)


def test_gate_needs_gain_and_rows(spark):
    df = spark.range(400).select(
        F.col("id").cast("double").alias("t"),
        (F.col("id") * 2.0).alias("p"),
        F.when(F.col("id") < 200, "fit").when(F.col("id") < 300, "cal").otherwise("test").alias("part"),
    )
    row = cal.gated_posthoc(df, "t", "p").first()
    assert row.posthoc_used and row.a == pytest.approx(0.5) and row.gain > 0
    assert not cal.gated_posthoc(df.withColumn("p", F.col("t")), "t", "p").first().posthoc_used
    assert not cal.gated_posthoc(df, "t", "p", min_train=301).first().posthoc_used


def test_fallback_is_never_worse_than_raw(spark):
    df = spark.createDataFrame([("a", 1.0, 1.1, 5.0), ("b", 1.0, 3.0, 1.2)], "k string, t double, raw double, c double")
    out = {r.k: (r.c, r.used_fallback) for r in cal.with_fallback(df, "t", "raw", "c", ["k"]).collect()}
    assert out == {"a": (1.1, True), "b": (1.2, False)}


@pytest.mark.parametrize("correction", ["none", "linear", "gated"])
def test_calibrated_channel(spark, correction):
    rng = np.random.default_rng(2)
    truth = rng.uniform(0, 50, 300)
    data = [
        (i, True, 10, 5, float(truth[i]) if i % 40 else None, float(truth[i] * 1.5 + 4 + rng.normal()), 1.0, 0.5, float(rng.uniform(0, 100)))
        for i in range(300)
    ]
    df = spark.createDataFrame(data, "t int, matched boolean, n_points int, min_delta_sec int, x double, mc_x_mean double, mc_x_std double, mc_x_iqr double, mc_hum_mean double")
    series, model = calibrate_channel(df, "x", ["x"], ["hum"], "t", k=2, forest={"trees": 2, "depth": 4}, correction=correction, clip=True)
    out = series.toPandas()
    assert len(out) == 300 and out["calibrated"].notna().all() and (out["calibrated"] >= 0).all()
    test = out[out["part"] == "test"]
    assert ((test.calibrated - test.truth) ** 2).mean() <= ((test.raw - test.truth) ** 2).mean()


def test_key_from_file_name_or_folder(spark, tmp_path):
    (tmp_path / "NO2").mkdir()
    (tmp_path / "permutation_importance_CO.csv").write_text("feature,importance_mean\na,1.0\n")
    (tmp_path / "NO2" / "permutation_importance.csv").write_text("feature,importance_mean\nb,2.0\n")
    df = files.read_keyed_csv(spark, str(tmp_path), "permutation_importance*.csv", r"permutation_importance_(.+)\.csv$", "feature string, importance_mean double", "target")
    assert {(r.target, r.feature) for r in df.collect()} == {("CO", "a"), ("NO2", "b")}


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿Time , v\n2024-01-01 00:00:00,1\n", encoding="utf-8")
    assert files.read_csv(spark, str(tmp_path / "x.csv")).columns == ["Time", "v"]
