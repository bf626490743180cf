"""Consistency of a network of sites: spatial, temporal and weather-conditioned deviation, scores, anomalies.

Series are regular grids (see ``resample_mean``): one row per (channel, site_id, dt).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import haversine_km, unit_sphere
from ..runtime import materialize, release
from ..schema import ScoreParams
from .clean import q
from .lookup import beside
from .ordering import global_row_number
from .quantiles import exact_quantiles, one_row
from .timeseries import contiguous_segments, first_difference, minmax01, robust_z

SITE = "site_id"
# Finest cell edge is 2 / 2^26 of the earth's radius, about 19 cm.
LEVELS = 26


def relative_deviation(x: Column, ref: Column, eps: float) -> Column:
    return F.abs(x - ref) / (F.abs(ref) + F.lit(eps))


def _cell_index(axis: str, level: Column) -> Column:
    """Integer coordinate of a point in the cube grid of a level (edge 2 / 2^level)."""
    return F.floor((F.col(axis) + 1) * F.pow(F.lit(2.0), level - 1)).cast("long")


# Places that one place is compared with at most, per wanted neighbour; beyond that its cubes are cut smaller.
PER_NEIGHBOUR = 512
# A cube with at most so many places is compared as a whole.
LEAF = 8
AT = ["level", "cx", "cy", "cz"]


def _cubes(points: DataFrame) -> DataFrame:
    """Every point with its cube at every level."""
    cell = [_cell_index(a, F.col("level")).alias(f"c{a}") for a in "xyz"]
    return points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).select("*", *cell)


def _edge() -> Column:
    return F.pow(F.lit(2.0), 1 - F.col("level"))


def _cube_distance(farthest: bool) -> Column:
    """Straight-line distance from the place (x, y, z) to the nearest or the farthest point of a cube."""
    total = F.lit(0.0)
    for a in "xyz":
        lo = F.col(f"c{a}") * _edge() - 1
        hi = lo + _edge()
        gap = F.greatest(F.abs(F.col(a) - lo), F.abs(F.col(a) - hi)) if farthest else F.greatest(lo - F.col(a), F.col(a) - hi, F.lit(0.0))
        total = total + gap * gap
    return F.sqrt(total)


def candidate_cubes(points: DataFrame, k: int) -> DataFrame:
    """For every place the cubes ``(lat, lon, level, cx, cy, cz, _n)`` that hold its k nearest others, a written table.

    The smallest cube around a place that still holds k others bounds how far they can be, so the cubes of the next
    larger size around it hold them all. Where these hold too many places, as for a site outside a city, all cubes with
    more than ``LEAF`` places are cut into their eight parts, and a part goes whose nearest point is farther than the
    farthest points of parts that hold k others already. This goes on for those places until few are left.
    """
    cubes = _cubes(points)
    counts = materialize(cubes.groupBy(*AT).agg(F.count("*").alias("_n")), "counts")
    crowded = counts.where((F.col("_n") > k) | (F.col("level") == 0)).select(*AT)
    place = ["lat", "lon", "x", "y", "z"]
    # Cube diagonal is sqrt(3) edges < one edge of the next larger level.
    # Merge joins by hint: Spark takes exploded or compressed tables for far smaller than they are and would broadcast them.
    search = cubes.hint("merge").join(crowded, AT).groupBy(*place).agg(F.greatest(F.max("level") - 1, F.lit(0)).alias("level"))
    step = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    cell = [_cell_index(a, F.col("level")).alias(f"c{a}") for a in "xyz"]
    around = search.select("*", *cell)
    for a in "xyz":
        around = around.withColumn("_d", F.explode(step)).withColumn(f"c{a}", F.col(f"c{a}") + F.col("_d")).drop("_d")
    whole = Window.partitionBy(*place)

    def written(found: DataFrame) -> DataFrame:
        """With ``_heavy``: is the place compared with too many, and can its cubes be cut?"""
        top = F.max(F.when(F.col("level") < LEVELS, F.col("_n"))).over(whole)
        heavy = (F.sum("_n").over(whole) > PER_NEIGHBOUR * (k + 1)) & (F.coalesce(top, F.lit(0)) > LEAF)
        return materialize(found.select(*place, *AT, "_n").withColumn("_heavy", heavy), "cubes")

    found = written(beside(around, counts, AT, "inner"))
    done, scratch, parts = [], [counts], None
    while True:
        done.append(found.where("not _heavy").select("lat", "lon", *AT, "_n"))
        scratch.append(found)
        if not found.where("_heavy").limit(1).count():
            break
        if parts is None:
            # The eight parts of a cube as one row.
            parts = counts.where(F.col("level") > 0).select(
                (F.col("level") - 1).alias("level"),
                *[F.floor(F.col(f"c{a}") / 2).alias(f"c{a}") for a in "xyz"],
                F.struct(*[F.col(f"c{a}") for a in "xyz"], "_n").alias("_part"),
            )
            parts = materialize(parts.groupBy(*AT).agg(F.collect_list("_part").alias("_parts")), "parts")
            scratch.append(parts)
        cut = (F.col("_n") > LEAF) & (F.col("level") < LEVELS)
        large = beside(found.where(F.col("_heavy") & cut).drop("_n"), parts, AT, "inner")
        smaller = large.select(*place, (F.col("level") + 1).alias("level"), F.inline("_parts")).select(*place, *AT, "_n")
        kept = smaller.unionByName(found.where(F.col("_heavy") & ~cut).select(*place, *AT, "_n"))
        bounds = kept.withColumns({"_near": _cube_distance(False), "_far": _cube_distance(True)})
        # A place itself is among the first k + 1.
        held = F.sum("_n").over(whole.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0))
        reach = F.min(F.when(F.col("_held") > k, F.col("_far"))).over(whole)
        near = bounds.withColumn("_held", held).withColumn("_reach", reach)
        # A little slack for rounding; without k others in all there is no bound.
        found = written(near.where(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach") * (1 + 1e-9) + 1e-12)))
    out = materialize(reduce(DataFrame.unionByName, done), "candidates")
    release(*scratch)
    return out


def knn_sites(sites: DataFrame, k: int = 6) -> DataFrame:
    """The k nearest other sites ``(site_i, rank, site_j, dist_km)``; ties go to the smaller id.

    Exact, without comparing all pairs. Points live in cubes on the unit sphere at every scale; see
    :func:`candidate_cubes` for how few of them a place is compared with. Sites at one place are represented by
    their k + 1 smallest ids, so a crowd of co-located sites adds no work.
    """
    x, y, z = unit_sphere(F.col("lat"), F.col("lon"))
    here = Window.partitionBy("lat", "lon").orderBy(SITE)
    points = materialize(
        sites.select(SITE, "lat", "lon", F.row_number().over(here).alias("_m"))
        .where(F.col("_m") <= k + 1)
        .select(SITE, "lat", "lon", x.alias("x"), y.alias("y"), z.alias("z")),
        "points",
    )
    wanted = candidate_cubes(points, k).select(F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i"), *AT)
    other = _cubes(points).select(*AT, F.col(SITE).alias("site_j"), "lat", "lon")
    dist = haversine_km(F.col("lat_i"), F.col("lon_i"), F.col("lat"), F.col("lon"))
    best = Window.partitionBy("lat_i", "lon_i").orderBy("dist_km", "site_j")
    # One more than k, because a site finds itself among the members of its own place.
    near = (
        wanted.hint("merge").join(other, AT)
        .select("lat_i", "lon_i", "site_j", dist.alias("dist_km"))
        .withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= k + 1)
        .drop("_r")
    )
    per_site = Window.partitionBy("site_i").orderBy("dist_km", "site_j")
    return (
        sites.select(F.col(SITE).alias("site_i"), F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i"))
        .join(near.hint("merge"), ["lat_i", "lon_i"])
        .where(F.col("site_i") != F.col("site_j"))
        .withColumn("rank", F.row_number().over(per_site))
        .where(F.col("rank") <= k)
        .select("site_i", "rank", "site_j", "dist_km")
    )


def site_distances(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """Great-circle distance of given site pairs ``(site_i, site_j)``."""
    a, b = (
        sites.select(F.col(SITE).alias(f"site_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
        for s in "ij"
    )
    dist = haversine_km(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j"))
    return pairs.join(a.hint("merge"), "site_i").join(b.hint("merge"), "site_j").select("site_i", "site_j", dist.alias("dist_km"))


def spatial_deviation(
    series: DataFrame, edges: DataFrame, x: str = "x", keys: Sequence[str] = ("channel",), eps: float = 1e-6
) -> DataFrame:
    """Adds ``e``: relative deviation from the mean of the neighbours' present values at the same time."""
    keys = list(keys)
    ref = (
        edges.select("site_i", F.col("site_j").alias(SITE))
        .join(series.select(*keys, SITE, "dt", x).hint("merge"), SITE)
        .groupBy(*keys, "site_i", "dt")
        .agg(F.avg(x).alias("ref"))
        .withColumnRenamed("site_i", SITE)
    )
    return series.join(ref.hint("merge"), [*keys, SITE, "dt"], "left").withColumn(
        "e", relative_deviation(F.col(x), F.col("ref"), eps)
    )


def mean_per_site(dev: DataFrame, value: str, name: str, keys: Sequence[str] = ("channel",)) -> DataFrame:
    return dev.groupBy(*keys, SITE).agg(F.avg(value).alias(name))


def sci(dev: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Spatial consistency per site: mean deviation over time."""
    return mean_per_site(dev, "e", "sci", keys)


def jump_rate_tci(series: DataFrame, x: str = "x", keys: Sequence[str] = ("channel",), jump_z: float = 3.5) -> DataFrame:
    """Temporal consistency per site: share of steps whose robust z exceeds ``jump_z`` (missing steps are no jumps)."""
    group = [*keys, SITE]
    diffs = first_difference(series.select(*group, "dt", x), x, "dt", group)
    steps = robust_z(materialize(diffs, "steps"), "diff", group)
    jump = F.coalesce(F.abs("z") > jump_z, F.lit(False))
    return steps.groupBy(*group).agg(F.avg(jump.cast("double")).alias("tci"))


def weather_neighbours(
    weather: DataFrame, edges: DataFrame, cols: Sequence[str], k_meteo: int = 4, eps: float = 1e-6
) -> DataFrame:
    """For every site and time the ``k_meteo`` neighbours with the most similar weather: ``(site_i, dt, site_j)``.

    Weather is scaled by one population deviation per column; a pair with a missing value adds nothing.
    """
    spread = one_row(weather.agg(*[F.stddev_pop(c).alias(c) for c in cols]))
    scale = {c: F.when(spread[c] > 1e-9, spread[c]).otherwise(F.lit(1.0)) + F.lit(eps) for c in cols}
    at_i = weather.select(F.col(SITE).alias("site_i"), "dt", *[F.col(c).alias(f"{c}_i") for c in cols])
    at_j = weather.select(F.col(SITE).alias("site_j"), "dt", *[F.col(c).alias(f"{c}_j") for c in cols])
    gap = sum(
        (F.coalesce(F.pow((F.col(f"{c}_i") - F.col(f"{c}_j")) / scale[c], F.lit(2.0)), F.lit(0.0)) for c in cols),
        F.lit(0.0),
    )
    nearest = Window.partitionBy("site_i", "dt").orderBy("gap", "rank")
    return (
        edges.select("site_i", "site_j", "rank")
        .join(at_i.hint("merge"), "site_i")
        .join(at_j.hint("merge"), ["site_j", "dt"])
        .select("site_i", "dt", "site_j", "rank", gap.alias("gap"))
        .withColumn("_pick", F.row_number().over(nearest))
        .where(F.col("_pick") <= k_meteo)
        .select("site_i", "dt", "site_j")
    )


def mci(
    series: DataFrame, similar: DataFrame, x: str = "x", keys: Sequence[str] = ("channel",), eps: float = 1e-6
) -> DataFrame:
    """Weather-conditioned consistency per site: mean deviation from the weather-similar neighbours."""
    keys = list(keys)
    ref = (
        similar.withColumnRenamed("site_j", SITE)
        .join(series.select(*keys, SITE, "dt", x).hint("merge"), [SITE, "dt"])
        .groupBy(*keys, "site_i", "dt")
        .agg(F.avg(x).alias("ref"))
        .withColumnRenamed("site_i", SITE)
    )
    e = relative_deviation(F.col(x), F.col("ref"), eps)
    return series.join(ref.hint("merge"), [*keys, SITE, "dt"], "left").groupBy(*keys, SITE).agg(F.avg(e).alias("mci"))


def reliability_index(
    sci_t: DataFrame, tci_t: DataFrame, mci_t: DataFrame, params: ScoreParams = ScoreParams(), keys: Sequence[str] = ("channel",)
) -> DataFrame:
    """Scores per site: the three indicators, their [0, 1] forms per key, and ``ri`` = 1 − weighted sum."""
    on = [*keys, SITE]
    # One row per site, read twice.
    raw = materialize(sci_t.join(tci_t.hint("merge"), on, "left").join(mci_t.hint("merge"), on, "left"), "indicators")
    scores = minmax01(raw, ["sci", "tci", "mci"], keys)
    ri = 1 - (
        F.lit(params.alpha) * F.col("sci_n") + F.lit(params.beta) * F.col("tci_n") + F.lit(params.gamma) * F.col("mci_n")
    )
    return scores.withColumn("ri", ri)


def ri_threshold(scores: DataFrame, params: ScoreParams = ScoreParams(), keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Threshold per key: a quantile of the scores, or the fixed value when no quantile is set."""
    keys = list(keys)
    if params.ri_quantile is None:
        return scores.select(*keys).distinct().withColumn("threshold", F.lit(params.ri_fixed))
    p = min(1.0, max(0.0, params.ri_quantile))
    return exact_quantiles(scores, ["ri"], [p], keys).select(*keys, F.col("ri")[0].alias("threshold"))


def anomaly_sites(scores: DataFrame, params: ScoreParams = ScoreParams(), keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Sites strictly below their threshold."""
    limits = ri_threshold(scores, params, keys)
    return scores.join(limits, list(keys)).where(F.col("ri") < F.col("threshold"))


def worst_site(scores: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.min_by(SITE, F.when(F.col("ri").isNotNull(), F.struct("ri", SITE))).alias("worst_site"),
        F.min("ri").alias("min_ri"),
    )


def anomaly_windows(dev: DataFrame, params: ScoreParams = ScoreParams(), keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Runs of at least ``window_min_len`` grid steps with |robust z of e| above ``window_z``, for every site."""
    group = [*keys, SITE]
    scored = robust_z(dev.select(*group, "dt", "e"), "e", group)
    return contiguous_segments(scored, F.abs("z") > params.window_z, "dt", group, params.window_min_len)


def site_score_avg(scores: DataFrame) -> DataFrame:
    cols = ["sci", "tci", "mci", "sci_n", "tci_n", "mci_n", "ri"]
    return scores.groupBy(SITE).agg(*[F.avg(c).alias(c) for c in cols])


SCALED = ("sci_n", "tci_n", "mci_n")


def two_means(scores: DataFrame, cols: Sequence[str] = SCALED, keys: Sequence[str] = ("channel",), rounds: int = 50) -> DataFrame:
    """Centres ``_c0`` and ``_c1`` (arrays) of two clusters per key, a written table.

    They start at the sites with the lowest and the highest ``ri`` and move to the means of their nearest rows (the first
    on ties) until none moves, all keys in the same rounds.
    """
    keys = list(keys)
    point, place = F.array(*[F.coalesce(q(c).cast("double"), F.lit(0.0)) for c in cols]), F.struct("ri", SITE)
    rows = materialize(scores.select(*map(q, keys), "ri", SITE, point.alias("_x")), "points")
    present = F.when(F.col("ri").isNotNull(), place)
    first = rows.groupBy(*keys).agg(F.coalesce(F.min_by("_x", present), F.first("_x")).alias("_c0"), F.coalesce(F.max_by("_x", present), F.first("_x")).alias("_c1"))
    centres, old = materialize(first, "centres"), []
    count = centres.count()
    for _ in range(rounds):
        near = beside(rows, centres, keys, rows_bound=count).withColumn("_in1", _gap("_c1") < _gap("_c0"))
        means = [
            F.coalesce(*[F.when(F.count_if(inside) > 0, F.array(*[F.avg(F.when(inside, F.get("_x", F.lit(i)))) for i in range(len(cols))])), F.first(c)]).alias(c)
            for c, inside in (("_c0", ~F.col("_in1")), ("_c1", F.col("_in1")))
        ]
        moved = materialize(near.groupBy(*keys).agg(F.first("_c0").alias("_o0"), F.first("_c1").alias("_o1"), *means), "centres")
        far = F.aggregate(F.zip_with(F.concat("_c0", "_c1"), F.concat("_o0", "_o1"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: F.greatest(s, d))
        old.append(centres)
        centres = moved
        if not moved.where(far > 1e-12).limit(1).count():
            break
    release(rows, *old)
    out = centres.select(*keys, "_c0", "_c1")
    out._scratch = centres._scratch
    return out


def _gap(centre: str) -> Column:
    """Squared distance of the point to a centre."""
    return F.aggregate(F.zip_with("_x", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def kmeans_anomaly(scores: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Adds ``cluster`` of the scaled indicators (0 starts at the lowest ``ri``) per key, its mean ``ri`` and ``anomalous``.

    The cluster with the lower mean ``ri`` is anomalous. Missing indicators count as 0.
    """
    keys = list(keys)
    filled = scores.fillna(0.0, list(SCALED))
    placed = beside(filled, two_means(filled, SCALED, keys), keys).withColumn("_x", F.array(*[q(c).cast("double") for c in SCALED]))
    clustered = placed.withColumn("cluster", (_gap("_c1") < _gap("_c0")).cast("int")).drop("_x", "_c0", "_c1")
    means = clustered.groupBy(*keys, "cluster").agg(F.avg("ri").alias("cluster_mean_ri"))
    worst = means.groupBy(*keys).agg(F.min_by("cluster", F.struct("cluster_mean_ri", "cluster")).alias("_worst"))
    return (
        beside(beside(clustered, means, [*keys, "cluster"]), worst, keys)
        .withColumn("anomalous", F.col("cluster") == F.col("_worst"))
        .drop("_worst")
    )


def pivot_blocks(dev: DataFrame, value: str, keys: Sequence[str] = ("channel",), width: int = 100) -> DataFrame:
    """Wide ``dt × site`` table as blocks of at most ``width`` sites, for any number of sites.

    A row holds the values of one key, time and block: column ``s<j>`` is the site at place ``block · width + j`` in the
    order of site ids. The numbering of sites comes from a distributed sort, so no list of sites passes the driver.
    """
    keys = list(keys)
    numbered = global_row_number(dev.select(SITE).distinct(), [SITE], "_at")
    at = numbered.select(SITE, F.floor((F.col("_at") - 1) / width).alias("block"), F.pmod(F.col("_at") - 1, F.lit(width)).alias("_j"))
    placed = beside(dev.select(*map(q, keys), "dt", SITE, q(value).alias("_v")), at, [SITE])
    cells = [F.max(F.when(F.col("_j") == j, F.col("_v"))).alias(f"s{j}") for j in range(width)]
    return placed.groupBy(*map(q, keys), "dt", "block").agg(*cells)


def pivot_by_site(dev: DataFrame, value: str, site_values: Sequence) -> DataFrame:
    """Wide ``dt × site`` table for the given sites."""
    wide = dev.groupBy("dt").pivot(SITE, list(site_values)).agg(F.first(value))
    return wide.select("dt", *[F.col(f"`{s}`").alias(f"site_{s}") for s in site_values])
