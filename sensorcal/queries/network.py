"""Network consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.time import DAY_US
from ..operators import network as net, timeseries
from ..operators.halo import neighbour_deviations
from ..plans.network import score_network
from ..runtime import materialize, scratch_path
from ..schema import ScoreParams
from ..sources.files import write_json
from .base import big, query, r6, with_views
from .series import grid_sql

K = 6
HAV = (
    "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + "
    "cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"
)
EDGES = {
    "dist": f"SELECT a.site_id AS site_i, b.site_id AS site_j, {HAV} AS dist_km FROM sites a, sites b WHERE a.site_id <> b.site_id",
    "edges": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_i ORDER BY dist_km, site_j) AS rank FROM dist) "
    f"WHERE rank <= {K}",
}
CHANNELS = ("v", "wind")
GRID = grid_sql("day", ("v", "hum", "wind"))
SERIES = EDGES | GRID | {
    "series": "SELECT 'v' AS channel, site_id, dt, v AS x FROM grid UNION ALL SELECT 'wind', site_id, dt, wind FROM grid",
}
DEV = SERIES | {
    "refs": "SELECT channel, e.site_i AS site_id, dt, avg(x) AS ref FROM edges e JOIN series s ON s.site_id = e.site_j GROUP BY 1, 2, 3",
    "dev": "SELECT s.*, ref, abs(x - ref) / (abs(ref) + 1e-6) AS e FROM series s LEFT JOIN refs USING (channel, site_id, dt)",
}
SCI = DEV | {"sci_t": "SELECT channel, site_id, avg(e) AS sci FROM dev GROUP BY 1, 2"}
JUMP = 2.5
TCI_STEPS = {
    "steps": "SELECT * FROM (SELECT channel, site_id, dt, x - lag(x) OVER w AS d, row_number() OVER w AS rn FROM series "
    "WINDOW w AS (PARTITION BY channel, site_id ORDER BY dt)) WHERE rn > 1",
    "jmed": "SELECT channel, site_id, median(d) AS med FROM steps GROUP BY 1, 2",
    "jmad": "SELECT channel, site_id, med, median(abs(d - med)) + 1e-9 AS mad FROM steps JOIN jmed USING (channel, site_id) GROUP BY 1, 2, 3",
    "tci_t": f"SELECT channel, site_id, avg(CASE WHEN abs(0.6745 * (d - med) / mad) > {JUMP} THEN 1.0 ELSE 0.0 END) AS tci "
    "FROM steps LEFT JOIN jmad USING (channel, site_id) GROUP BY 1, 2",
}
MCI_STEPS = {
    "sc": "SELECT CASE WHEN stddev_pop(hum) > 1e-9 THEN stddev_pop(hum) ELSE 1.0 END + 1e-6 AS sh, "
    "CASE WHEN stddev_pop(wind) > 1e-9 THEN stddev_pop(wind) ELSE 1.0 END + 1e-6 AS sw FROM grid",
    "gaps": "SELECT e.site_i, e.site_j, e.rank, i.dt, coalesce(pow((i.hum - j.hum) / sh, 2), 0) + coalesce(pow((i.wind - j.wind) / sw, 2), 0) AS gap "
    "FROM edges e JOIN grid i ON i.site_id = e.site_i JOIN grid j ON j.site_id = e.site_j AND j.dt = i.dt, sc",
    "likely": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_i, dt ORDER BY gap, rank) AS pick FROM gaps) WHERE pick <= 4",
    "mref": "SELECT channel, m.site_i AS site_id, m.dt, avg(x) AS mr FROM likely m JOIN series s ON s.site_id = m.site_j AND s.dt = m.dt GROUP BY 1, 2, 3",
    "mci_t": "SELECT channel, site_id, avg(abs(x - mr) / (abs(mr) + 1e-6)) AS mci FROM series LEFT JOIN mref USING (channel, site_id, dt) GROUP BY 1, 2",
}


def _norm(c):
    return (
        f"CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-12 THEN 0 "
        f"ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-12) END AS {c}_n"
    )


SCORES = SCI | TCI_STEPS | MCI_STEPS | {
    "normed": f"SELECT *, {_norm('sci')}, {_norm('tci')}, {_norm('mci')} FROM sci_t LEFT JOIN tci_t USING (channel, site_id) "
    "LEFT JOIN mci_t USING (channel, site_id) WINDOW w AS (PARTITION BY channel)",
    "scores": "SELECT *, 1 - (0.45 * sci_n + 0.2 * tci_n + 0.35 * mci_n) AS ri FROM normed",
    "thr": "SELECT channel, quantile_cont(ri, 0.15) AS threshold FROM scores GROUP BY 1",
}
VIEWS = ["site_readings", "sites"]
SCORE_COLS = ("sci", "tci", "mci", "sci_n", "tci_n", "mci_n", "ri")
SCORE_SQL = "channel, site_id, " + ", ".join(r6(c, c) for c in SCORE_COLS)
PARAMS = ScoreParams(jump_z=JUMP)


def edges(spark, sf_dir):
    return net.knn_sites(fx.sites(spark, sf_dir), K)


def weather(spark, sf_dir):
    return timeseries.resample_mean(fx.site_readings(spark, sf_dir), "ts", DAY_US, ["v", "hum", "wind"], ["site_id"])


def series_of(grid):
    entries = [F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in CHANNELS]
    return grid.select("site_id", "dt", F.inline(F.array(*entries)))


def deviation(spark, sf_dir):
    return net.spatial_deviation(series_of(weather(spark, sf_dir)), edges(spark, sf_dir))


def all_scores(spark, sf_dir):
    """All channels' scores from one exchange of the grid; the grid, the neighbour edges and the deviations are written once."""
    grid = materialize(weather(spark, sf_dir), "grid")
    near = materialize(edges(spark, sf_dir), "edges")
    dev = neighbour_deviations(grid, fx.sites(spark, sf_dir), near, CHANNELS, ["hum", "wind"], PARAMS.k_meteo)
    dev = materialize(dev, "deviation")
    return net.reliability_index(
        net.sci(dev), net.jump_rate_tci(dev, jump_z=JUMP), net.mean_per_site(dev, "e_meteo", "mci"), PARAMS
    )


@query(
    "knn_sites",
    with_views(["sites"], EDGES, f"SELECT site_i, {big('rank', 'rank')}, site_j, {r6('dist_km', 'dist_km')} FROM edges"),
)
def knn_sites(spark, sf_dir):
    return edges(spark, sf_dir)


@query(
    "site_distances",
    with_views(
        ["sites"],
        EDGES,
        f"SELECT site_i, site_j, {r6(HAV, 'dist_km')} FROM edges p JOIN sites a ON a.site_id = p.site_j JOIN sites b ON b.site_id = p.site_i",
    ),
)
def site_distances(spark, sf_dir):
    """Distances along the neighbour edges: the part of the distance matrix that scoring uses."""
    near = materialize(edges(spark, sf_dir), "edges")
    return net.site_distances(near.select("site_i", "site_j"), fx.sites(spark, sf_dir))


@query(
    "spatial_deviation",
    with_views(VIEWS, DEV, f"SELECT channel, site_id, dt, {r6('x', 'x')}, {r6('ref', 'ref')}, {r6('e', 'e')} FROM dev"),
)
def spatial_deviation(spark, sf_dir):
    return deviation(spark, sf_dir)


@query("sci", with_views(VIEWS, SCI, f"SELECT channel, site_id, {r6('sci', 'sci')} FROM sci_t"))
def sci(spark, sf_dir):
    return net.sci(deviation(spark, sf_dir))


@query(
    "jump_rate_tci",
    with_views(VIEWS, SERIES | TCI_STEPS, f"SELECT channel, site_id, {r6('tci', 'tci')} FROM tci_t"),
)
def jump_rate_tci(spark, sf_dir):
    return net.jump_rate_tci(series_of(weather(spark, sf_dir)), jump_z=JUMP)


@query("mci", with_views(VIEWS, SERIES | MCI_STEPS, f"SELECT channel, site_id, {r6('mci', 'mci')} FROM mci_t"))
def mci(spark, sf_dir):
    grid = weather(spark, sf_dir)
    return net.mci(series_of(grid), net.weather_neighbours(grid, edges(spark, sf_dir), ["hum", "wind"], PARAMS.k_meteo))


@query(
    "reliability_index",
    with_views(VIEWS, SCORES, f"SELECT channel, site_id, {r6('ri', 'ri')} FROM scores"),
)
def reliability_index(spark, sf_dir):
    return all_scores(spark, sf_dir).select("channel", "site_id", "ri")


@query("site_scores_all", with_views(VIEWS, SCORES, f"SELECT {SCORE_SQL} FROM scores"))
def site_scores_all(spark, sf_dir):
    return all_scores(spark, sf_dir)


@query(
    "site_score_avg",
    with_views(
        VIEWS, SCORES, f"SELECT site_id, {', '.join(r6(f'avg({c})', c) for c in SCORE_COLS)} FROM scores GROUP BY site_id"
    ),
)
def site_score_avg(spark, sf_dir):
    return net.site_score_avg(all_scores(spark, sf_dir))


@query(
    "anomaly_sites",
    with_views(
        VIEWS,
        SCORES,
        f"SELECT channel, site_id, {r6('ri', 'ri')}, {r6('threshold', 'threshold')} FROM scores JOIN thr USING (channel) WHERE ri < threshold",
    ),
)
def anomaly_sites(spark, sf_dir):
    scores = materialize(all_scores(spark, sf_dir), "scores")
    return net.anomaly_sites(scores, PARAMS).select("channel", "site_id", "ri", "threshold")


@query(
    "worst_site",
    with_views(
        VIEWS,
        SCORES,
        f"SELECT channel, site_id AS worst_site, {r6('ri', 'min_ri')} FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ri, site_id) AS rn "
        "FROM scores WHERE ri IS NOT NULL) WHERE rn = 1",
    ),
)
def worst_site(spark, sf_dir):
    return net.worst_site(all_scores(spark, sf_dir))


WINDOW_Z = 2.0
WINDOW_STEPS = DEV | {
    "m1": "SELECT channel, site_id, median(e) AS med FROM dev GROUP BY 1, 2",
    "m2": "SELECT channel, site_id, med, median(abs(e - med)) + 1e-9 AS mad FROM dev JOIN m1 USING (channel, site_id) GROUP BY 1, 2, 3",
    "z": f"SELECT channel, site_id, dt, coalesce(abs(0.6745 * (e - med) / mad) > {WINDOW_Z}, false) AS f FROM dev LEFT JOIN m2 USING (channel, site_id)",
    "n": "SELECT *, row_number() OVER (PARTITION BY channel, site_id ORDER BY dt) AS rn FROM z",
    "runs": "SELECT *, rn - row_number() OVER (PARTITION BY channel, site_id ORDER BY dt) AS run FROM n WHERE f",
}


@query(
    "anomaly_windows",
    with_views(
        VIEWS,
        WINDOW_STEPS,
        f"SELECT channel, site_id, {big('min(rn) - 1', 'start_index')}, {big('max(rn) - 1', 'end_index')}, min(dt) AS start_dt, "
        f"max(dt) AS end_dt, {big('count(*)', 'len')} FROM runs GROUP BY channel, site_id, run HAVING count(*) >= 2",
    ),
)
def anomaly_windows(spark, sf_dir):
    params = ScoreParams(window_z=WINDOW_Z, window_min_len=2)
    return net.anomaly_windows(materialize(deviation(spark, sf_dir), "deviation"), params)


ROUNDS = 25


def _two_means_sql() -> dict[str, str]:
    """Rounds of two clusters; further rounds change nothing once no centre moves."""
    dist = " + ".join(f"pow({c} - {{0}}.{c}, 2)" for c in net.SCALED)
    steps = {
        "pts": "SELECT channel, site_id, ri, " + ", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in net.SCALED) + " FROM scores",
        "k0": "SELECT channel, 0 AS g, " + ", ".join(f"arg_min({c}, (ri, site_id)) AS {c}" for c in net.SCALED) + " FROM pts GROUP BY channel UNION ALL "
        "SELECT channel, 1, " + ", ".join(f"arg_max({c}, (ri, site_id))" for c in net.SCALED) + " FROM pts GROUP BY channel",
    }
    for i in range(1, ROUNDS + 2):
        d0, d1 = (" + ".join(f"pow(p.{c} - {k}.{c}, 2)" for c in net.SCALED) for k in ("a", "b"))
        steps[f"in{i}"] = (
            f"SELECT p.*, CASE WHEN {d1} < {d0} THEN 1 ELSE 0 END AS cluster FROM pts p JOIN k{i - 1} a ON a.channel = p.channel AND a.g = 0 "
            f"JOIN k{i - 1} b ON b.channel = p.channel AND b.g = 1"
        )
        steps[f"k{i}"] = (
            f"SELECT k.channel, k.g, " + ", ".join(f"coalesce(avg(p.{c}), any_value(k.{c})) AS {c}" for c in net.SCALED)
            + f" FROM k{i - 1} k LEFT JOIN in{i} p ON p.channel = k.channel AND p.cluster = k.g GROUP BY 1, 2"
        )
    steps["cluster_means"] = f"SELECT channel, cluster, avg(ri) AS cluster_mean_ri FROM in{ROUNDS + 1} GROUP BY 1, 2"
    steps["worst_cluster"] = "SELECT channel, arg_min(cluster, (cluster_mean_ri, cluster)) AS w FROM cluster_means GROUP BY 1"
    steps["clustered"] = f"SELECT x.*, cluster_mean_ri, cluster = w AS anomalous FROM in{ROUNDS + 1} x JOIN cluster_means USING (channel, cluster) JOIN worst_cluster USING (channel)"
    return steps


TWO_MEANS = SCORES | _two_means_sql()


@query(
    "kmeans_anomaly",
    with_views(
        VIEWS, TWO_MEANS, f"SELECT channel, site_id, {big('cluster', 'cluster')}, {r6('ri', 'ri')}, {r6('cluster_mean_ri', 'cluster_mean_ri')}, anomalous FROM clustered", once=True
    ),
)
def kmeans_anomaly(spark, sf_dir):
    out = net.kmeans_anomaly(materialize(all_scores(spark, sf_dir), "scores"))
    return out.select("channel", "site_id", "cluster", "ri", "cluster_mean_ri", "anomalous")


WIDTH = 16


@query(
    "pivot_deviation",
    with_views(
        VIEWS,
        DEV
        | {
            "place": "SELECT site_id, row_number() OVER (ORDER BY site_id) - 1 AS spot FROM (SELECT DISTINCT site_id FROM dev)",
            "placed": f"SELECT dev.*, spot // {WIDTH} AS block, spot % {WIDTH} AS j FROM dev JOIN place USING (site_id)",
        },
        f"SELECT channel, dt, {big('block', 'block')}, " + ", ".join(r6(f"max(e) FILTER (j = {j})", f"s{j}") for j in range(WIDTH)) + " FROM placed GROUP BY channel, dt, block",
    ),
)
def pivot_deviation(spark, sf_dir):
    """The spatial deviation of all sites as wide rows, in blocks of sites."""
    return net.pivot_blocks(materialize(deviation(spark, sf_dir), "deviation"), "e", width=WIDTH)


REPORT = ScoreParams(jump_z=JUMP, window_z=WINDOW_Z, window_min_len=2)


@query(
    "network_report",
    with_views(
        VIEWS,
        TWO_MEANS
        | {n: s for n, s in WINDOW_STEPS.items() if n not in DEV}
        | {
            "worst_ri": "SELECT channel, arg_min(site_id, (ri, site_id)) AS worst_site FROM scores WHERE ri IS NOT NULL GROUP BY channel",
            "found": "SELECT channel, site_id, min(rn) - 1 AS i0, max(rn) - 1 AS i1, count(*) AS len FROM runs GROUP BY channel, site_id, run HAVING count(*) >= 2",
            "listed": "SELECT w.channel, worst_site, count(i0) AS n_windows, string_agg(i0 || '-' || i1 || ':' || len, ';' ORDER BY i0) AS windows "
            "FROM worst_ri w LEFT JOIN found f ON f.channel = w.channel AND f.site_id = w.worst_site GROUP BY 1, 2",
            "groups": "SELECT channel, count(*) AS n_sites, count(*) FILTER (anomalous) AS n_low, min(cluster_mean_ri) FILTER (anomalous) AS low, "
            "min(cluster_mean_ri) FILTER (NOT anomalous) AS high FROM clustered GROUP BY channel",
        },
        f"SELECT channel, {big('n_sites', 'n_sites')}, {big(DAY_US, 'step_us')}, 'quantile' AS threshold_type, {r6('any_value(threshold)', 'threshold')}, "
        f"{r6('0.15', 'quantile_q')}, {r6('0.5', 'fixed_value')}, {r6(JUMP, 'jump_z')}, {big('count(*) FILTER (ri < threshold)', 'n_anomalous')}, "
        f"{big('n_low', 'n_low_cluster')}, {r6('low', 'low_mean_ri')}, {r6('high', 'high_mean_ri')}, worst_site, {big('n_windows', 'n_windows')}, windows "
        "FROM scores JOIN thr USING (channel) JOIN listed USING (channel) JOIN groups USING (channel) "
        "GROUP BY channel, n_sites, n_low, low, high, worst_site, n_windows, windows",
        once=True,
    ),
)
def network_report(spark, sf_dir):
    """The whole flow from readings to the report, written as JSON and read back."""
    result = score_network(
        fx.site_readings(spark, sf_dir), fx.sites(spark, sf_dir), "ts", CHANNELS, ["hum", "wind"], DAY_US, REPORT
    )
    path = scratch_path(spark, "report")
    write_json(result.report, path)
    back = spark.read.schema(result.report.schema).json(path)
    window = lambda w: F.concat(w["start_index"], F.lit("-"), w["end_index"], F.lit(":"), w["len"])
    return back.select(
        "channel",
        "n_sites",
        "step_us",
        F.col("threshold.type").alias("threshold_type"),
        F.col("threshold.value").alias("threshold"),
        "threshold.quantile_q",
        "threshold.fixed_value",
        "jump_z",
        "n_anomalous",
        F.col("two_means.n_anomalous").alias("n_low_cluster"),
        F.col("two_means.anomalous_mean_ri").alias("low_mean_ri"),
        F.col("two_means.other_mean_ri").alias("high_mean_ri"),
        "worst_site",
        "n_windows",
        F.array_join(F.transform("windows", window), ";").alias("windows"),
    )
