from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorcal.functions.time import HOUR_US
from sensorcal.operators import network as net, ordering, rank, timeseries as ts
from sensorcal.schema import ScoreParams

T0 = datetime(2024, 3, 1)


def test_row_numbers_and_parts(spark):
    n = 503
    df = spark.range(n).select(F.xxhash64("id").alias("o"), "id")
    numbered = ordering.global_row_number(df, ["o"]).orderBy("o").collect()
    assert [r.rn for r in numbered] == list(range(1, n + 1)) and numbered[0].rn_total == n
    parts = {r.part: r["count"] for r in ordering.time_split(df, ["o"]).groupBy("part").count().collect()}
    assert parts == {"test": 101, "cal": 80, "fit": 322}


def test_folds_expand(spark):
    rows = ordering.time_split(spark.range(100), ["id"], folds=5).orderBy("id").collect()
    folds = [r.fold for r in rows]
    assert folds[80:] == [None] * 20
    assert folds[:80] == sorted(folds[:80]) and [folds[:80].count(i) for i in range(6)] == [15, 13, 13, 13, 13, 13]
    alone = ordering.time_series_folds(spark.range(80), ["id"], 5).orderBy("id").collect()
    assert [r.fold for r in alone] == folds[:80]


def test_resample_keeps_empty_bins(spark):
    df = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + timedelta(hours=3), 3.0), ("b", T0 + timedelta(hours=1), 2.0)], "k string, t timestamp_ntz, v double")
    out = ts.resample_mean(df, "t", HOUR_US, ["v"], ["k"]).orderBy("k", "dt").collect()
    assert [(r.k, r.v) for r in out] == [("a", 1.0), ("a", None), ("a", None), ("a", 3.0), ("b", None), ("b", 2.0), ("b", None), ("b", None)]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_gaps_are_filled_block_by_block(spark, monkeypatch, block):
    """Every key has every bin once: gaps at both ends and inside, a NULL key, a key without any time."""
    monkeypatch.setattr(ts, "GAP_BLOCK", block)
    at = {"a": [0, 1, 9], "b": [4], None: [2, 3], "none": []}
    rows = [(k, T0 + timedelta(hours=h, minutes=7), float(h)) for k, hours in at.items() for h in hours] + [("none", None, 1.0)]
    out = ts.resample_mean(spark.createDataFrame(rows, "k string, t timestamp_ntz, v double"), "t", HOUR_US, ["v"], ["k"]).collect()
    got = {(r.k, r.dt): r.v for r in out}
    want = {(k, T0 + timedelta(hours=h)): float(h) if h in hours else None for k, hours in at.items() for h in range(10)}
    assert len(out) == 40 and got == want


def test_runs_end_at_missing(spark):
    flags = [True, True, None, True, False, True, True, True]
    df = spark.createDataFrame([("k", i, f) for i, f in enumerate(flags)], "k string, i int, f boolean")
    out = ts.contiguous_segments(df, F.col("f"), "i", ["k"], 2).orderBy("start_index").collect()
    assert [(r.start_index, r.end_index, r.len) for r in out] == [(0, 1, 2), (5, 7, 3)]


def test_minmax_of_flat_column_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0), ("b", None)], "k string, x double")
    out = {(r.k, r.x): r.x_n for r in ts.minmax01(df, ["x"], ["k"]).collect()}
    assert out[("a", None)] == 0.0 and out[("b", None)] is None and out[("b", 3.0)] == pytest.approx(1.0)
    assert ts.minmax01(df.select("x"), ["x"]).where("x = 3").first().x_n == pytest.approx(1.0)


def test_robust_z_whole_table(spark):
    x = [1.0, 2.0, 4.0, 9.0]
    out = ts.robust_z(spark.createDataFrame([(v,) for v in x], "x double"), "x").orderBy("x").collect()
    med = np.median(x)
    np.testing.assert_allclose([r.z for r in out], 0.6745 * (np.array(x) - med) / (np.median(np.abs(x - med)) + 1e-9))


def test_ar1_defaults(spark):
    df = spark.createDataFrame([("short", i, float(i)) for i in range(4)] + [("up", i, float(i)) for i in range(30)] + [("flip", i, float(i % 2)) for i in range(30)], "k string, t int, x double")
    out = {r.k: r for r in ts.series_stats_ar1(df, "x", "t", ["k"]).collect()}
    assert (out["short"].rho, out["up"].rho, out["flip"].rho) == (0.7, 0.98, 0.2)


def brute_knn(pts, k):
    out = {}
    for i, la, lo in pts:
        d = []
        for j, lb, lp in pts:
            if i != j:
                p, r = np.radians([la, lb]), np.radians([lo, lp])
                a = np.sin((p[1] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(p[1]) * np.sin((r[1] - r[0]) / 2) ** 2
                d.append((round(2 * 6371 * np.arcsin(min(1, np.sqrt(a))), 7), j))
        out[i] = [x[0] for x in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("kind", ["uniform", "clustered", "coincident", "poles", "few"])
def test_knn_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "uniform":
        pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-60, 60, 120), rng.uniform(-180, 180, 120), strict=True))]
    elif kind == "clustered":
        city = [(i, 30 + float(a), 114 + float(b)) for i, (a, b) in enumerate(rng.normal(0, 1e-4, (60, 2)))]
        pts = city + [(60 + i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(25, 35, (20, 2)))]
    elif kind == "coincident":
        pts = [(i, 10.0, 20.0) for i in range(40)] + [(40 + i, 10.0 + i / 50, 20.0) for i in range(1, 8)]
    elif kind == "poles":
        pts = [(i, 89.9, float(b)) for i, b in enumerate(rng.uniform(-180, 180, 25))] + [(30 + i, float(a), 180.0 - 1e-3 * (i % 2) * 359999) for i, a in enumerate(rng.uniform(-1, 1, 12))]
    else:
        pts = [(1, 0.0, 0.0), (2, 1.0, 1.0), (3, -5.0, 170.0)]
    df = spark.createDataFrame(pts, "site_id int, lat double, lon double")
    got = {}
    for r in net.knn_sites(df, 4).orderBy("site_i", "rank").collect():
        got.setdefault(r.site_i, []).append(round(r.dist_km, 7))
    want = brute_knn(pts, 4)
    assert set(got) == set(want)
    for i in want:
        np.testing.assert_allclose(got[i], want[i], atol=2e-5)


@pytest.mark.parametrize("most", [1, 64])
def test_city_and_outskirts_are_compared_with_few(spark, monkeypatch, most):
    """A thousand sites in a city and sixty far outside: nobody is compared with the whole city."""
    monkeypatch.setattr(net, "PER_NEIGHBOUR", most)
    rng = np.random.default_rng(8)
    city = [(i, 30 + float(a), 114 + float(b)) for i, (a, b) in enumerate(rng.uniform(-0.005, 0.005, (1000, 2)))]
    far = [(1000 + i, 30 + 3 * np.cos(t), 114 + 3 * np.sin(t)) for i, t in enumerate(np.linspace(0, 6, 60))]
    pts = [(i, float(a), float(b)) for i, a, b in city + far]
    df = spark.createDataFrame(pts, "site_id int, lat double, lon double")
    from sensorcal.functions.geo import unit_sphere

    x, y, z = unit_sphere(F.col("lat"), F.col("lon"))
    cubes = net.candidate_cubes(df.select("site_id", "lat", "lon", x.alias("x"), y.alias("y"), z.alias("z")), 4)
    compared = cubes.groupBy("lat", "lon").agg(F.sum("_n").alias("n"))
    assert compared.count() == len(pts) and compared.agg(F.max("n")).first()[0] <= 64 * 5
    got = {}
    for r in net.knn_sites(df, 4).orderBy("site_i", "rank").collect():
        got.setdefault(r.site_i, []).append(round(r.dist_km, 7))
    some = {i: d for i, d in brute_knn(pts[::25] + far, 0).items()}
    want = {}
    la, lo = np.radians([p[1] for p in pts]), np.radians([p[2] for p in pts])
    for i in some:
        a = np.sin((la - la[i]) / 2) ** 2 + np.cos(la[i]) * np.cos(la) * np.sin((lo - lo[i]) / 2) ** 2
        want[i] = np.sort(np.delete(2 * 6371 * np.arcsin(np.sqrt(a)), i))[:4]
    for i in want:
        np.testing.assert_allclose(got[i], want[i], atol=2e-5)


@pytest.mark.parametrize("size, block", [(64, 256), (3, 4), (1, 1)])
def test_one_exchange_equals_the_joins(spark, size, block):
    """Any cells and blocks: same deviations as by joining neighbours; gaps, a missing row, a site without a place."""
    from sensorcal.functions.time import DAY_US
    from sensorcal.operators.halo import neighbour_deviations, site_cells

    rng = np.random.default_rng(9)
    rows = [(s, T0 + timedelta(days=d), *(None if rng.random() < 0.15 else float(v) for v in rng.normal(10, 2, 4))) for s in range(14) for d in range(11) if (s, d) != (3, 5)]
    grid = spark.createDataFrame(rows, "site_id int, dt timestamp_ntz, a double, b double, w double, v double")
    places = [(s, 30 + float(x), 114 + float(y)) for s, (x, y) in enumerate(rng.uniform(0, 1, (13, 2)))]
    sites = spark.createDataFrame(places, "site_id int, lat double, lon double")
    edges = net.knn_sites(sites, 4).cache()
    assert site_cells(sites, size).groupBy("cell").count().agg(F.max("count")).first()[0] <= size
    got = neighbour_deviations(grid, sites, edges, ["a", "b"], ["w", "v"], 2, block_us=block * DAY_US, size=size)
    series = grid.select("site_id", "dt", F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in "ab"])))
    want = net.spatial_deviation(series, edges)
    similar = net.weather_neighbours(grid, edges, ["w", "v"], 2)
    key = lambda r: (r.channel, r.site_id, r.dt)
    plain = lambda r: tuple(None if v is None else round(v, 9) for v in (r.x, r.ref, r.e))
    got_rows = got.collect()
    assert {key(r): plain(r) for r in got_rows} == {key(r): plain(r) for r in want.collect()} and len(got_rows) == 2 * len(rows)
    mci = {(r.channel, r.site_id): r.mci for r in net.mci(series, similar).collect()}
    mine = {(r.channel, r.site_id): r.mci for r in net.mean_per_site(spark.createDataFrame(got_rows, got.schema), "e_meteo", "mci").collect()}
    assert mine.keys() == mci.keys() and all(mine[k] == pytest.approx(mci[k]) or mine[k] == mci[k] for k in mci)


def test_scores_within_bounds(spark):
    rng = np.random.default_rng(5)
    rows = [("c", s, T0 + timedelta(days=d), float(v)) for s in range(8) for d, v in enumerate(rng.normal(10, 2, 20))]
    series = spark.createDataFrame(rows, "channel string, site_id int, dt timestamp_ntz, x double")
    sites = spark.createDataFrame([(s, 30 + s / 100 + s * s / 1e4, 114.0) for s in range(8)], "site_id int, lat double, lon double")
    weather = series.select("site_id", "dt", F.col("x").alias("w"))
    edges = net.knn_sites(sites, 3)
    scores = net.reliability_index(
        net.sci(net.spatial_deviation(series, edges)),
        net.jump_rate_tci(series),
        net.mci(series, net.weather_neighbours(weather, edges, ["w"], 2)),
    ).collect()
    assert len(scores) == 8 and all(0 <= r.ri <= 1 for r in scores)
    assert ScoreParams().alpha + ScoreParams().beta + ScoreParams().gamma == pytest.approx(1)


def test_fixed_threshold_and_missing_scores(spark):
    scores = spark.createDataFrame([("c", 1, 0.2), ("c", 2, 0.5), ("c", 3, None)], "channel string, site_id int, ri double")
    out = net.anomaly_sites(scores, ScoreParams(ri_quantile=None)).collect()
    assert [r.site_id for r in out] == [1]
    assert net.worst_site(scores).first().worst_site == 1


def test_positive_only_ranks_are_dense(spark):
    imp = spark.createDataFrame([("t", "a", -1.0, 0.0), ("t", "b", 2.0, 0.0), ("t", "c", 2.0, 0.0), ("t", "d", 0.0, 0.0)], "target string, feature string, importance_mean double, importance_std double")
    assert [(r.feature, r["rank"]) for r in rank.topk_features(imp, 5).orderBy("rank").collect()] == [("b", 1), ("c", 2)]
    assert rank.topk_features(imp, 5, positive_only=False).count() == 4
