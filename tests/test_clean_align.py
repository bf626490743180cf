from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorcal.operators import align, clean, metrics
from sensorcal.schema import PRESSURE_TO_PA, column_contract, resolve_time, strip_headers

T0 = datetime(2024, 3, 1, 10)


def micro(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, v double")


def test_contract_and_headers(spark):
    df = spark.createDataFrame([(1, 2.0)], "`﻿Time ` int, ` v` double")
    df = strip_headers(df)
    assert df.columns == ["Time", "v"]
    assert column_contract(df, ["v"], {"p": "double"}).columns == ["Time", "v", "p"]
    assert resolve_time(df).columns == ["dt", "v"]
    with pytest.raises(ValueError):
        column_contract(df, ["nothing"])
    with pytest.raises(ValueError):
        resolve_time(df.drop("Time"))


def test_coercion(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "1.5"), ("x", "2"), ("2024-01-02 00:00:00", "NaN")], "t string, v string")
    out = clean.coerce_numeric(clean.coerce_time(df, "t"), ["v", "absent"]).orderBy("t").collect()
    assert [r.v for r in out] == [1.5, None]


@pytest.mark.parametrize("values,expected", [([1000.0, 1010.0], [100000.0, 101000.0]), ([99.0, 101.0], [99000.0, 101000.0]), ([5.0], [5.0]), ([None], [None])])
def test_unit_by_median(spark, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    assert [r.p for r in clean.normalize_unit(df, "p", PRESSURE_TO_PA).orderBy("i").collect()] == expected


def test_unit_per_key(spark):
    df = spark.createDataFrame([("a", 1000.0), ("b", 100.0)], "k string, p double")
    out = {r.k: r.p for r in clean.normalize_unit(df, "p", PRESSURE_TO_PA, ["k"]).collect()}
    assert out == {"a": 100000.0, "b": 100000.0}


def test_dedupe_takes_mean_and_first_present(spark):
    df = spark.createDataFrame([(1, 3, 1.0, None), (1, 5, 3.0, "y"), (1, 9, None, "z")], "t int, o int, v double, tag string")
    row = clean.dedupe_time(df, ["t"], ["v"], {"tag": "o"}).first()
    assert (row.v, row.tag) == (2.0, "y")


def test_winsorized_values_stay_ordered_and_inside(spark):
    rng = np.random.default_rng(0)
    vals = [float(v) for v in rng.normal(size=500)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    out = [r.v for r in clean.winsorize(df, ["v"], 0.05, 0.95).orderBy("i").collect()]
    assert out[-1] is None
    lo, hi = np.quantile(vals[:-1], [0.05, 0.95])
    np.testing.assert_allclose(out[:-1], np.clip(vals[:-1], lo, hi))


def test_half_way_reading_goes_to_the_earlier_hour(spark):
    row = clean.hour_anchors(micro(spark, [(T0 + timedelta(minutes=30), 1.0)]), "ts").first()
    assert row.hour_nearest == T0 and row.delta_nearest_min == 30
    row = clean.hour_anchors(micro(spark, [(T0, 1.0)]), "ts").first()
    assert row.hour_ceil == T0 and row.delta_ceil_min == 0


def test_nearest_hour_rules(spark):
    offsets = [-5, 0, 4, 5.001]
    rows = [(T0 + timedelta(minutes=m), float(i)) for i, m in enumerate(offsets)]
    rows += [(T0 + timedelta(hours=1, minutes=m), v) for m, v in ((1, 10.0), (2, 20.0))]
    rows += [(T0 + timedelta(hours=2), None)]
    station = spark.createDataFrame([(T0 + timedelta(hours=h), 1.0) for h in range(4)], "hour timestamp_ntz, y double")
    out = {r.hour: r for r in align.align_nearest_hour(station, micro(spark, rows), "ts", "v").collect()}
    assert (out[T0].company, out[T0].n_points) == (1.0, 3)
    assert out[T0 + timedelta(hours=1)].company == 15.0
    assert not out[T0 + timedelta(hours=2)].matched and out[T0 + timedelta(hours=2)].min_delta == 0
    assert out[T0 + timedelta(hours=3)].n_points == 0


def test_window_is_closed_and_keeps_unmatched(spark):
    rows = [(T0 + timedelta(seconds=s), v) for s, v in ((-300, 1.0), (300, 3.0), (300.5, 9.0), (-4.5, None))]
    station = spark.createDataFrame([(T0, 7.0), (T0 + timedelta(days=1), 8.0)], "hour timestamp_ntz, y double")
    out = {r.y: r for r in align.align_window(station, micro(spark, rows), "hour", "ts", ["v"]).collect()}
    hit, miss = out[7.0], out[8.0]
    assert (hit.n_points, hit.mc_v_mean, hit.mc_v_std, hit.mc_v_iqr) == (3, 2.0, 1.0, 1.0)
    assert hit.min_delta_sec == 5  # -4.5 s is floored before the absolute value
    assert (miss.matched, miss.n_points, miss.mc_v_mean) == (False, 0, None)


@pytest.mark.parametrize("tol", [0.5, 7, 45, 200])
def test_window_equals_brute_force(spark, tol):
    rng = np.random.default_rng(int(tol * 10))
    times = [T0 + timedelta(seconds=float(s)) for s in rng.uniform(0, 40_000, 300)]
    station_t = [T0 + timedelta(seconds=int(s)) for s in rng.integers(0, 40_000, 40)]
    mc = micro(spark, [(t, float(i)) for i, t in enumerate(times)])
    mc_rows = [(r.ts, r.v) for r in mc.collect()]
    station = spark.createDataFrame([(t, i) for i, t in enumerate(station_t)], "hour timestamp_ntz, i int")
    got = {r.i: r for r in align.align_window(station, mc, "hour", "ts", ["v"], tol).collect()}
    for i, t in enumerate(station_t):
        inside = [v for m, v in mc_rows if abs(m - t) <= timedelta(minutes=tol)]
        assert got[i].n_points == len(inside)
        if inside:
            assert got[i].mc_v_mean == pytest.approx(np.mean(inside))


def test_metric_bounds(spark):
    df = spark.range(200).select(F.rand(1).alias("t"), F.rand(2).alias("p"))
    m = metrics.metrics_pack(df, "t", "p").first()
    assert m.rmse >= m.mae and -1 <= m.r <= 1 and m.ccc <= abs(m.r) + 1e-12


def test_degenerate_groups_give_null(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0)], "k string, t double, p double")
    out = {r.k: r for r in metrics.metrics_pack(df, "t", "p", ["k"]).collect()}
    assert out["one"].r is None and out["one"].ccc is None and out["flat"].r is None and out["flat"].r2 is None


def test_histogram_counts_everything(spark):
    df = spark.range(1000).select((F.col("id") % 17).cast("double").alias("x"))
    h = metrics.histogram_equal_width(df, "x", 40).orderBy("bin").collect()
    assert len(h) == 40 and sum(r.n for r in h) == 1000 and h[39].n > 0
    flat = metrics.histogram_equal_width(df.select(F.lit(2.0).alias("x")), "x", 4).collect()
    assert sum(r.n for r in flat) == 1000
