"""Cases that once gave a wrong answer or none."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorcal.operators.align import align_window
from sensorcal.operators.clean import winsorize
from sensorcal.operators.model import RidgeSpline, model_select, permutation_importance
from sensorcal.operators.network import kmeans_anomaly

DAY = datetime(2024, 1, 1)


def test_two_means_per_channel(spark):
    """Each channel has its own two clusters: values that are low in one channel are high in the other."""
    rows = [(c, i, x, x, x, x) for c, base in (("a", 0.0), ("b", 0.5)) for i in range(20) for x in [base + (0.3 if i < 5 else 0.45) + i / 1e4]]
    got = kmeans_anomaly(spark.createDataFrame(rows, "channel string, site_id long, sci_n double, tci_n double, mci_n double, ri double")).collect()
    assert {(r.channel, r.site_id) for r in got if r.anomalous} == {(c, i) for c in "ab" for i in range(5)} and len(got) == 40
    for r in got:
        assert abs(r.cluster_mean_ri - r.ri) < 0.01


def test_tolerance_zero_matches_equal_times(spark):
    station = spark.createDataFrame([(DAY,), (DAY + timedelta(hours=1),)], "hour timestamp")
    micro = spark.createDataFrame([(DAY, 4.0), (DAY + timedelta(microseconds=1), 9.0)], "ts timestamp, v double")
    got = {r.hour: (r.n_points, r.mc_v_mean) for r in align_window(station, micro, "hour", "ts", ["v"], 0).collect()}
    assert got == {DAY: (1, 4.0), DAY + timedelta(hours=1): (0, None)}


def test_winsorize_per_key(spark):
    rows = [(k, float(v + (100 if k == "b" else 0))) for k in ("a", "b", None) for v in range(101)]
    got = winsorize(spark.createDataFrame(rows, "k string, v double"), ["v"], 0.1, 0.9, keys=["k"])
    limits = {r.k: (r.lo, r.hi) for r in got.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    assert limits == {"a": (10.0, 90.0), "b": (110.0, 190.0), None: (10.0, 90.0)} and got.columns == ["k", "v"]


def test_no_rows_and_too_few_folds(spark):
    rows = [(i, i % 3, float(i), 2.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, fold int, x double, y double")
    est = RidgeSpline((), ("x",))
    model = est.fit(df, "y")
    assert permutation_importance(model, df.where("id < 0"), "y", ["id"], repeats=2).count() == 0
    with pytest.raises(ValueError, match="none in"):
        model_select([est], df, "y", 5)
