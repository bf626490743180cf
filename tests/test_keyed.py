"""Operators per key equal the same operator on each key's rows; p-values, clusters and blocks against plain code."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorcal.functions import stats
from sensorcal.operators import bins, metrics, network as net


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 600, p=[0.7, 0.2, 0.1]), "x": rng.normal(size=600), "s": rng.integers(0, 9, 600).astype(float)})
    pdf["y"] = pdf.x * 0.1 + rng.normal(size=600)
    return spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "c", F.col("k"))).cache()


def plain(df, *order):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.drop("k").collect())


@pytest.mark.parametrize(
    "run",
    [
        lambda d, k: bins.quantile_bin_trend(d, "x", "y", 5, k),
        lambda d, k: bins.interaction_trend(d, "x", "y", "s", 4, k),
        lambda d, k: bins.median_split_2x2(d, "x", "s", "y", k),
        lambda d, k: metrics.corr_metrics(d, "x", "y", k),
        lambda d, k: metrics.corr_pvalue(d, "x", "y", k),
        lambda d, k: metrics.residual_band(d, "y", keys=k),
        lambda d, k: metrics.residual_trend(d, "x", "y", k),
    ],
)
def test_keyed_equals_each_key_alone(rows, run):
    together = run(rows, ["k"])
    for k in ("a", None):
        mine = F.col("k").eqNullSafe(F.lit(k))
        assert plain(together.where(mine)) == plain(run(rows.where(mine).drop("k"), []))


def tail(r, n):
    """Two-sided p-value by summing the density of the angle."""
    nu = n - 2
    theta = np.arctan(abs(r) / np.sqrt(1 - r * r))
    area = lambda a, b: np.trapezoid(np.cos(np.linspace(a, b, 400_001)) ** (nu - 1), dx=(b - a) / 400_000)
    return area(theta, np.pi / 2) / area(0, np.pi / 2)


def test_p_value_equals_the_integral(spark):
    cases = [(r, n) for n in (4, 5, 7, 30, 1000, 60_000) for r in (0.003, -0.05, 0.2, 0.6, -0.95)]
    df = spark.createDataFrame([(float(r), n) for r, n in cases], "r double, n long")
    for row in df.withColumn("p", stats.correlation_p_value(F.col("r"), F.col("n"))).collect():
        want = tail(row.r, row.n)
        assert row.p == pytest.approx(want, rel=1e-5, abs=1e-9), row
        if want > 1e-8:
            assert row.p > 0


def test_p_value_at_the_ends(spark):
    df = spark.createDataFrame([(0.0, 10), (1.0, 10), (-1.0, 3), (0.5, 2), (None, 9)], "r double, n long")
    assert [x.p for x in df.select(stats.correlation_p_value(F.col("r"), F.col("n")).alias("p")).collect()] == [1.0, 0.0, 0.0, None, None]


def test_two_clusters_per_channel(spark):
    rng = np.random.default_rng(6)
    data = [(c, i, *(float(v) for v in rng.normal(0.2 if i % 4 else 0.8, 0.05, 3)), 1.0 if i % 4 else 0.2) for c in ("u", "v") for i in range(40)]
    data += [("alone", 1, 0.1, None, 0.3, 0.5)]
    df = spark.createDataFrame(data, "channel string, site_id int, sci_n double, tci_n double, mci_n double, ri double")
    out = net.kmeans_anomaly(df).collect()
    assert len(out) == 81 and {r.site_id for r in out if r.channel == "u" and r.anomalous} == set(range(0, 40, 4))
    one = next(r for r in out if r.channel == "alone")
    assert one.anomalous and one.tci_n == 0.0
    assert net.kmeans_anomaly(df.where("false")).count() == 0


def test_blocks_hold_every_site_once(spark):
    df = spark.range(70).select(F.lit("c").alias("channel"), (F.col("id") % 7 * 3).alias("site_id"), (F.col("id") / 7).cast("int").alias("dt"), F.col("id").alias("e"))
    out = net.pivot_blocks(df, "e", width=3).collect()
    got = {(r.dt, r.block * 3 + j): r[f"s{j}"] for r in out for j in range(3) if r[f"s{j}"] is not None}
    assert len(out) == 30 and got == {(i // 7, i % 7): i for i in range(70)}
