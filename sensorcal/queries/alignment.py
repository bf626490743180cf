"""Time alignment and the metrics on its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import align, bins, metrics
from ..plans.agreement import compare_sensor
from ..schema import PRESSURE_TO_PA, SensorSchema
from .base import big, query, r6, with_views
from .readings import ANCHORS, DEDUPED, NEAREST, PARSED, micros

HOURS = {
    "a": ANCHORS.format(t="ts", src="micro"),
    "b": NEAREST.format(src="a"),
    "agg": "SELECT hour_nearest AS hour, count(v) AS n_points, min(delta_nearest_min) AS min_delta, avg(v) AS mean, "
    "median(v) AS median, stddev_samp(v) AS std, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr "
    "FROM b WHERE delta_nearest_min <= 5 GROUP BY 1",
}
ALIGNED = HOURS | {
    "aligned": "SELECT hour, y AS station, CASE WHEN n_points >= 3 THEN median ELSE mean END AS company, "
    "coalesce(n_points, 0) AS n_points, min_delta, std, iqr, coalesce(n_points, 0) > 0 AS matched "
    "FROM station LEFT JOIN agg USING (hour)",
    "matched_rows": "SELECT *, company - station AS res FROM aligned WHERE matched AND station IS NOT NULL AND company IS NOT NULL",
}
VIEWS = ["micro", "station"]


def aligned_hours(spark, sf_dir):
    return align.align_nearest_hour(fx.station(spark, sf_dir), fx.micro(spark, sf_dir), "ts", "v")


def matched(spark, sf_dir):
    return metrics.matched_pairs(aligned_hours(spark, sf_dir)).withColumn("res", F.col("company") - F.col("station"))


@query(
    "hour_window_stats",
    with_views(
        ["micro"],
        HOURS,
        f"SELECT hour, {big('n_points', 'n_points')}, " + ", ".join(r6(c, c) for c in ("mean", "median", "std", "iqr"))
        + f", {big('round(min_delta * 60000000)', 'min_delta')} FROM agg",
    ),
)
def hour_window_stats(spark, sf_dir):
    stats = align.hour_window_stats(fx.micro(spark, sf_dir), "ts", "v")
    return stats.withColumn("min_delta", micros("min_delta"))


@query(
    "align_nearest_hour",
    with_views(
        VIEWS,
        ALIGNED,
        f"SELECT hour, {r6('station', 'station')}, {r6('company', 'company')}, {big('n_points', 'n_points')}, "
        f"{big('round(min_delta * 60000000)', 'min_delta')}, {r6('std', 'std')}, {r6('iqr', 'iqr')}, matched FROM aligned",
    ),
)
def align_nearest_hour(spark, sf_dir):
    return aligned_hours(spark, sf_dir).withColumn("min_delta", micros("min_delta"))


@query(
    "agreement_metrics",
    with_views(
        VIEWS,
        ALIGNED,
        f"SELECT (SELECT {big('count(*)', 'n')} FROM aligned) AS total_hours, "
        f"(SELECT {big('count(*)', 'n')} FROM aligned WHERE matched) AS matched_hours, "
        f"(SELECT {r6('avg(CASE WHEN matched THEN 1.0 ELSE 0.0 END)', 'c')} FROM aligned) AS coverage, "
        f"{r6('avg(n_points)', 'mean_n_points')}, {r6('avg(abs(res))', 'mae')}, {r6('sqrt(avg(res * res))', 'rmse')}, "
        f"{r6('avg(res)', 'bias')} FROM matched_rows",
    ),
)
def agreement_metrics(spark, sf_dir):
    return metrics.agreement_metrics(aligned_hours(spark, sf_dir))


KEYED = {
    "a": ANCHORS.format(t="ts", src="micro_keyed"),
    "b": NEAREST.format(src="a"),
    "agg": "SELECT sensor, hour_nearest AS hour, count(v) AS n_points, avg(v) AS mean, median(v) AS median FROM b "
    "WHERE delta_nearest_min <= 25 GROUP BY 1, 2",
    "aligned": "SELECT sensor, hour, y AS station, CASE WHEN n_points >= 3 THEN median ELSE mean END AS company, "
    "coalesce(n_points, 0) AS n_points, coalesce(n_points, 0) > 0 AS matched FROM station_keyed LEFT JOIN agg USING (sensor, hour)",
    "errors": "SELECT *, CASE WHEN matched THEN company - station END AS res FROM aligned",
}


@query(
    "agreement_keyed",
    with_views(
        ["station_keyed", "micro_keyed"],
        KEYED,
        f"SELECT sensor, {big('count(*)', 'total_hours')}, {big('count(*) FILTER (matched)', 'matched_hours')}, "
        f"{r6('avg(CASE WHEN matched THEN 1.0 ELSE 0.0 END)', 'coverage')}, {r6('avg(n_points) FILTER (res IS NOT NULL)', 'mean_n_points')}, "
        f"{r6('avg(abs(res))', 'mae')}, {r6('sqrt(avg(res * res))', 'rmse')}, {r6('avg(res)', 'bias')} FROM errors GROUP BY sensor",
    ),
)
def agreement_keyed(spark, sf_dir):
    """Every sensor against its own reference."""
    aligned = align.align_nearest_hour(fx.station_keyed(spark, sf_dir), fx.micro_keyed(spark, sf_dir), "ts", "v", 25, keys=["sensor"])
    return metrics.agreement_metrics(aligned, keys=["sensor"])


@query(
    "corr_metrics",
    with_views(
        VIEWS,
        ALIGNED,
        f"SELECT {big('count(*)', 'n')}, {r6('avg(abs(res))', 'mae')}, {r6('sqrt(avg(res * res))', 'rmse')}, {r6('avg(res)', 'bias')}, "
        f"{r6('corr(company, station)', 'r')}, {r6('regr_slope(company, station)', 'slope')}, "
        f"{r6('regr_intercept(company, station)', 'intercept')} FROM matched_rows",
    ),
)
def corr_metrics(spark, sf_dir):
    return metrics.corr_metrics(matched(spark, sf_dir))


#: The same continued fraction, step by step in a recursive query; the factor in front from the logarithm of the gamma function.
P_VALUE = {
    "rn": "SELECT grp, n, r, (n - 2) / 2.0::DOUBLE AS h, r * r AS rr FROM (SELECT grp, count(*) AS n, corr(y_true, hum) AS r FROM pairs GROUP BY grp)",
    "way": "SELECT *, 1 - rr < (h + 1) / (h + 2.5::DOUBLE) AS direct FROM rn",
    "ab": "SELECT grp, n, r, rr, direct, CASE WHEN direct THEN h ELSE 0.5::DOUBLE END AS a, CASE WHEN direct THEN 0.5::DOUBLE ELSE h END AS b, "
    "CASE WHEN direct THEN 1 - rr ELSE rr END AS x, exp(h * ln(1 - rr) + ln(abs(r)) + lgamma(h + 0.5::DOUBLE) - lgamma(h) - ln(pi()) / 2) AS front FROM way",
    "cf": "SELECT grp, 1 AS m, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS f FROM ab "
    "UNION ALL SELECT grp, m + 1, c2, d2, f * c1 * d1 * c2 * d2 FROM (SELECT *, 1 + odd / c1 AS c2, 1 / (1 + odd * d1) AS d2 FROM "
    "(SELECT *, 1 + even / c AS c1, 1 / (1 + even * d) AS d1 FROM (SELECT cf.*, m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)) AS even, "
    "-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)) AS odd FROM cf JOIN ab USING (grp) WHERE m <= 2000)))",
}


@query(
    "corr_pvalue",
    with_views(
        ["pairs"],
        P_VALUE,
        f"SELECT grp, {big('n', 'n')}, {r6('r', 'r')}, {r6('CASE WHEN direct THEN front * f / a ELSE 1 - front * f / a END', 'p_value')} "
        "FROM cf JOIN ab USING (grp) WHERE m = 2001",
    ),
)
def corr_pvalue(spark, sf_dir):
    return metrics.corr_pvalue(fx.pairs(spark, sf_dir), "y_true", "hum", ["grp"])


@query(
    "residual_trend",
    with_views(
        VIEWS,
        ALIGNED,
        f"SELECT {big('count(*)', 'n')}, {r6('regr_slope(res, station)', 'slope')}, "
        f"{r6('regr_intercept(res, station)', 'intercept')} FROM matched_rows",
    ),
)
def residual_trend(spark, sf_dir):
    return metrics.residual_trend(matched(spark, sf_dir))


def _window_sql(cols, tol, keys=()):
    on = "".join(f" AND m.{k} = s.{k}" for k in keys)
    s_keys = "".join(f"s.{k}, " for k in keys)
    stats = ", ".join(
        f'avg(m."{c}") AS "mc_{c}_mean", stddev_pop(m."{c}") AS "mc_{c}_std", '
        f'quantile_cont(m."{c}", 0.75) - quantile_cont(m."{c}", 0.25) AS "mc_{c}_iqr"'
        for c in cols
    )
    return (
        f"SELECT {s_keys}s.hour, count(*) AS n_points, "
        f"min(abs(CAST(floor(date_diff('microsecond', s.hour, m.ts) / 1000000.0::DOUBLE) AS BIGINT))) AS min_delta_sec, {stats} "
        f"FROM {{st}} s JOIN {{mc}} m ON m.ts BETWEEN s.hour - INTERVAL {tol} MINUTE AND s.hour + INTERVAL {tol} MINUTE{on} "
        f"GROUP BY {s_keys}s.hour"
    )


CHANNELS = [*fx.EVENT_TYPES, "hum"]
WIDE_STEPS = {
    "win": _window_sql(CHANNELS, 5).format(st="station_wide", mc="micro_wide"),
    "aligned": "SELECT *, n_points IS NOT NULL AS matched FROM station_wide LEFT JOIN win USING (hour)",
}
MC = [f"mc_{c}_{s}" for c in CHANNELS for s in ("mean", "std", "iqr")]


def aligned_wide(spark, sf_dir, tol_minutes=5):
    return align.align_window(
        fx.station_wide(spark, sf_dir), fx.micro_wide(spark, sf_dir), "hour", "ts", CHANNELS, tol_minutes
    )


@query(
    "align_window",
    with_views(
        ["station_wide", "micro_wide"],
        WIDE_STEPS,
        "SELECT hour, "
        + ", ".join(r6(f'"{c}"', f'"{c}"') for c in (*fx.EVENT_TYPES, *MC))
        + f", {big('coalesce(n_points, 0)', 'n_points')}, {big('min_delta_sec', 'min_delta_sec')}, matched FROM aligned",
    ),
)
def align_window(spark, sf_dir):
    return aligned_wide(spark, sf_dir)


@query(
    "align_window_keyed",
    with_views(
        ["station_keyed", "micro_keyed"],
        {"win": _window_sql(["v"], 90, ["sensor"]).format(st="station_keyed", mc="micro_keyed")},
        f"SELECT sensor, hour, {r6('y', 'y')}, {big('coalesce(n_points, 0)', 'n_points')}, {big('min_delta_sec', 'min_delta_sec')}, "
        + ", ".join(r6(f"mc_v_{s}", f"mc_v_{s}") for s in ("mean", "std", "iqr"))
        + ", n_points IS NOT NULL AS matched FROM station_keyed LEFT JOIN win USING (sensor, hour)",
    ),
)
def align_window_keyed(spark, sf_dir):
    return align.align_window(
        fx.station_keyed(spark, sf_dir), fx.micro_keyed(spark, sf_dir), "hour", "ts", ["v"], 90, ["sensor"]
    )


@query(
    "channel_errors",
    with_views(
        ["station_wide", "micro_wide"],
        WIDE_STEPS,
        " UNION ALL ".join(
            f"SELECT hour, '{c}' AS channel, "
            + r6(f'"mc_{c}_mean" - "{c}"', "error")
            + " FROM aligned"
            for c in fx.EVENT_TYPES
        ),
    ),
)
def channel_errors(spark, sf_dir):
    return metrics.channel_errors(aligned_wide(spark, sf_dir), ["hour"], fx.EVENT_TYPES)


@query(
    "diurnal_mean",
    with_views(
        VIEWS,
        ALIGNED,
        f"SELECT {big('hour(hour)', 'hour_of_day')}, {r6('avg(res)', 'mean')}, {big('count(res)', 'n')} FROM matched_rows GROUP BY hour(hour)",
    ),
)
def diurnal_mean(spark, sf_dir):
    return metrics.diurnal_mean(matched(spark, sf_dir), "hour", "res")


PAIR_RES = {"p": "SELECT *, y_raw - y_true AS res FROM pairs"}


@query(
    "residual_band",
    with_views(
        ["pairs"],
        PAIR_RES,
        f"SELECT {r6('quantile_cont(res, 0.05)', 'q_lo')}, {r6('quantile_cont(res, 0.95)', 'q_hi')} FROM p",
    ),
)
def residual_band(spark, sf_dir):
    return metrics.residual_band(residuals(spark, sf_dir), "res")


def residuals(spark, sf_dir):
    return fx.pairs(spark, sf_dir).withColumn("res", F.col("y_raw") - F.col("y_true"))


def _cell_sql(x, bins):
    return f"CAST(least(floor(({x} - {x}0) * {bins} / ({x}1 - {x}0)), {bins - 1}) AS BIGINT)"


@query(
    "density_2d",
    with_views(
        ["pairs"],
        {
            "xy": "SELECT y_true AS x, y_raw AS y FROM pairs",
            "lim": "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM xy",
        },
        f"SELECT {_cell_sql('x', 40)} AS x_bin, {_cell_sql('y', 40)} AS y_bin, {big('count(*)', 'n')} FROM xy, lim GROUP BY 1, 2",
    ),
)
def density_2d(spark, sf_dir):
    return metrics.density_2d(fx.pairs(spark, sf_dir), "y_true", "y_raw", 40)


@query(
    "histogram_equal_width",
    with_views(
        ["pairs"],
        PAIR_RES
        | {
            "lim": "SELECT min(res) AS x0, max(res) AS x1 FROM p",
            "c": f"SELECT {_cell_sql('x', 40)} AS bin, count(*) AS n FROM (SELECT res AS x FROM p), lim GROUP BY 1",
        },
        f"SELECT CAST(b AS BIGINT) AS bin, {r6('x0 + (x1 - x0) / 40 * b', 'lo')}, {r6('x0 + (x1 - x0) / 40 * (b + 1)', 'hi')}, "
        f"{big('coalesce(n, 0)', 'n')} FROM range(40) t(b) LEFT JOIN c ON c.bin = b, lim",
    ),
)
def histogram_equal_width(spark, sf_dir):
    return metrics.histogram_equal_width(residuals(spark, sf_dir), "res", 40)


def pack_sql(t, p, prefix=""):
    """SQL of the metrics pack over two columns without missing values."""
    return ", ".join(
        [
            r6(f"avg(abs({p} - {t}))", f"{prefix}mae"),
            r6(f"sqrt(avg(({p} - {t}) * ({p} - {t})))", f"{prefix}rmse"),
            r6(f"1 - sum(({p} - {t}) * ({p} - {t})) / (var_pop({t}) * count(*))", f"{prefix}r2"),
            r6(
                f"2 * covar_samp({t}, {p}) / (var_samp({t}) + var_samp({p}) + (avg({t}) - avg({p})) * (avg({t}) - avg({p})))",
                f"{prefix}ccc",
            ),
            r6(f"avg({p} - {t})", f"{prefix}bias"),
            r6(f"corr({t}, {p})", f"{prefix}r"),
        ]
    )


@query(
    "metrics_pack",
    with_views(["pairs"], {}, f"SELECT grp, {big('count(*)', 'n')}, {pack_sql('y_true', 'y_raw')} FROM pairs GROUP BY grp"),
)
def metrics_pack(spark, sf_dir):
    return metrics.metrics_pack(fx.pairs(spark, sf_dir), "y_true", "y_raw", ["grp"])


def _qbins(bins):
    edges = ", ".join(repr(i / bins) + "::DOUBLE" for i in range(bins + 1))
    return f"SELECT list_distinct(quantile_cont(x, [{edges}])) AS edges FROM xy"


_BIN = "CAST(greatest(len(list_filter(edges, lambda e: e < x)) - 1, 0) AS BIGINT)"


@query(
    "quantile_bin_trend",
    with_views(
        ["pairs"],
        {"xy": "SELECT y_true AS x, y_raw - y_true AS y FROM pairs", "q": _qbins(20)},
        f"SELECT {_BIN} AS bin, {r6('avg(x)', 'x_mean')}, {r6('avg(y)', 'y_mean')}, {big('count(*)', 'n')} FROM xy, q GROUP BY 1",
    ),
)
def quantile_bin_trend(spark, sf_dir):
    return bins.quantile_bin_trend(residuals(spark, sf_dir), "y_true", "res", 20)


@query(
    "quantile_bin_trend_keyed",
    with_views(
        ["pairs"],
        {
            "xy": "SELECT grp, y_true AS x, y_raw - y_true AS y FROM pairs",
            "q": _qbins(20).replace("SELECT", "SELECT grp,") + " GROUP BY grp",
        },
        f"SELECT grp, {_BIN} AS bin, {r6('avg(x)', 'x_mean')}, {r6('avg(y)', 'y_mean')}, {big('count(*)', 'n')} FROM xy JOIN q USING (grp) GROUP BY 1, 2",
    ),
)
def quantile_bin_trend_keyed(spark, sf_dir):
    return bins.quantile_bin_trend(residuals(spark, sf_dir), "y_true", "res", 20, ["grp"])


@query(
    "median_split_2x2_keyed",
    with_views(
        ["pairs"],
        PAIR_RES | {"m": "SELECT grp, median(hum) AS mh, median(y_true) AS my FROM p GROUP BY grp"},
        "SELECT grp, CASE WHEN hum >= mh THEN 'high' ELSE 'low' END AS a_half, CASE WHEN y_true >= my THEN 'high' ELSE 'low' END AS b_half, "
        f"{big('count(*)', 'n')}, {r6('avg(res)', 'mean')}, {r6('median(res)', 'median')}, {r6('stddev_samp(res)', 'std')} FROM p JOIN m USING (grp) GROUP BY 1, 2, 3",
    ),
)
def median_split_2x2_keyed(spark, sf_dir):
    return bins.median_split_2x2(residuals(spark, sf_dir), "hum", "y_true", "res", ["grp"])


@query(
    "interaction_trend",
    with_views(
        ["pairs"],
        {
            "xy": "SELECT y_true AS x, y_raw - y_true AS y, hum FROM pairs",
            "q": _qbins(15),
            "m": "SELECT median(hum) AS m FROM xy",
        },
        f"SELECT CASE WHEN hum >= m THEN 'high' ELSE 'low' END AS half, {_BIN} AS bin, {r6('avg(x)', 'x_mean')}, "
        f"{r6('avg(y)', 'y_mean')}, {big('count(*)', 'n')} FROM xy, q, m GROUP BY 1, 2",
    ),
)
def interaction_trend(spark, sf_dir):
    return bins.interaction_trend(residuals(spark, sf_dir), "y_true", "res", "hum", 15)


@query(
    "median_split_2x2",
    with_views(
        ["pairs"],
        PAIR_RES | {"m": "SELECT median(hum) AS mh, median(y_true) AS my FROM p"},
        "SELECT CASE WHEN hum >= mh THEN 'high' ELSE 'low' END AS a_half, CASE WHEN y_true >= my THEN 'high' ELSE 'low' END AS b_half, "
        f"{big('count(*)', 'n')}, {r6('avg(res)', 'mean')}, {r6('median(res)', 'median')}, {r6('stddev_samp(res)', 'std')} FROM p, m GROUP BY 1, 2",
    ),
)
def median_split_2x2(spark, sf_dir):
    return bins.median_split_2x2(residuals(spark, sf_dir), "hum", "y_true", "res")


@query(
    "seeded_sample",
    with_views(
        ["pairs"],
        PAIR_RES,
        f"SELECT dt, {', '.join(fx.PAIR_ORDER[1:])}, grp, {r6('y_true', 'y_true')}, {r6('y_raw', 'y_raw')}, {r6('hum', 'hum')}, {r6('res', 'res')} FROM p "
        f"ORDER BY md5(concat_ws('|', '0', {', '.join(f'{c}::VARCHAR' for c in fx.PAIR_ORDER)})), {', '.join(fx.PAIR_ORDER)} LIMIT 6000",
    ),
)
def seeded_sample(spark, sf_dir):
    return bins.seeded_sample(residuals(spark, sf_dir), fx.PAIR_ORDER, 6000)


CLEAN_THEN_ALIGN = {
    "parsed": PARSED,
    "deduped": DEDUPED,
    "ranged": "SELECT time, CASE WHEN v >= 0 THEN v END AS v FROM deduped",
    "lim": "SELECT quantile_cont(v, 0.005) AS v0, quantile_cont(v, 0.995) AS v1 FROM ranged",
    "micro": "SELECT time AS ts, CASE WHEN v IS NOT NULL THEN greatest(v0, least(v1, v)) END AS v FROM ranged, lim",
} | ALIGNED


@query(
    "compare_sensor",
    with_views(
        ["dirty", "station"],
        CLEAN_THEN_ALIGN,
        f"SELECT {big('count(*)', 'n')}, {r6('avg(abs(res))', 'mae')}, {r6('sqrt(avg(res * res))', 'rmse')}, {r6('avg(res)', 'bias')}, "
        f"{r6('corr(company, station)', 'r')}, {r6('regr_slope(company, station)', 'slope')}, "
        f"{r6('regr_intercept(company, station)', 'intercept')} FROM matched_rows",
    ),
)
def compare_sensor_flow(spark, sf_dir):
    """Raw text to correlation with the station in one flow."""
    raw = fx.dirty(spark, sf_dir).withColumnsRenamed({"time_s": "time", "v_s": "v", "pressure_s": "pressure"})
    schema = SensorSchema("time", ("v",), ("pressure",))
    ranges = {"v": (0.0, None), "pressure": (8.0e4, 1.1e5)}
    return compare_sensor(fx.station(spark, sf_dir), raw, schema, "v", ranges, {"pressure": PRESSURE_TO_PA})[2]
