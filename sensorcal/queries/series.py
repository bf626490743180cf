"""Calendar features, grids, robust scores, runs and chronological splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.time import DAY_US
from ..operators import ordering, timeseries
from .base import big, query, r6, with_views

TIME_SQL = """
SELECT *, date_diff('microsecond', (SELECT min(ts) FROM micro), ts) / 86400000000.0::DOUBLE AS t_days,
  hour(ts) AS hour_of_day, isodow(ts) - 1 AS dow, month(ts) AS month,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  sin(2 * pi() * hour(ts) / 24) AS sin_hour, cos(2 * pi() * hour(ts) / 24) AS cos_hour,
  sin(2 * pi() * (month(ts) - 1) / 12) AS sin_month, cos(2 * pi() * (month(ts) - 1) / 12) AS cos_month
FROM micro
"""


@query(
    "time_features",
    with_views(
        ["micro"],
        {"f": TIME_SQL},
        f"SELECT event_id, {r6('t_days', 't_days')}, "
        + ", ".join(big(c, c) for c in ("hour_of_day", "dow", "month", "is_weekend"))
        + ", "
        + ", ".join(r6(c, c) for c in ("sin_hour", "cos_hour", "sin_month", "cos_month"))
        + " FROM f",
    ),
)
def time_features(spark, sf_dir):
    return timeseries.time_features(fx.micro(spark, sf_dir), "ts").drop("ts", "v", "hum")


# Daily grid of one site's channels; empty days stay as missing.
def grid_sql(step: str, cols: tuple[str, ...]) -> dict[str, str]:
    means = ", ".join(f"avg({c}) AS {c}" for c in cols)
    return {
        "means": f"SELECT site_id, date_trunc('{step}', ts) AS dt, {means} FROM site_readings GROUP BY 1, 2",
        "spine": f"SELECT site_id, dt FROM (SELECT DISTINCT site_id FROM site_readings), "
        f"(SELECT unnest(generate_series(date_trunc('{step}', min(ts)), date_trunc('{step}', max(ts)), INTERVAL 1 {step})) AS dt FROM site_readings)",
        "grid": f"SELECT site_id, dt, {', '.join(cols)} FROM spine LEFT JOIN means USING (site_id, dt)",
    }


GRID = grid_sql("day", ("v", "hum", "wind"))


def grid(spark, sf_dir):
    return timeseries.resample_mean(fx.site_readings(spark, sf_dir), "ts", DAY_US, ["v", "hum", "wind"], ["site_id"])


@query(
    "resample_mean",
    with_views(
        ["site_readings"],
        GRID,
        f"SELECT site_id, dt, {r6('v', 'v')}, {r6('hum', 'hum')}, {r6('wind', 'wind')} FROM grid",
    ),
)
def resample_mean(spark, sf_dir):
    return grid(spark, sf_dir)


ROBUST = {
    "med": "SELECT grp, median(res) AS med FROM p GROUP BY grp",
    "mad": "SELECT grp, med, median(abs(res - med)) + 1e-9 AS mad FROM p JOIN med USING (grp) GROUP BY grp, med",
}


@query(
    "robust_z",
    with_views(
        ["pairs"],
        {"p": "SELECT *, y_raw - y_true AS res FROM pairs"} | ROBUST,
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + r6("0.6745 * (res - med) / mad", "z") + " FROM p JOIN mad USING (grp)",
    ),
)
def robust_z(spark, sf_dir):
    res = fx.pairs(spark, sf_dir).withColumn("res", F.col("y_raw") - F.col("y_true"))
    return timeseries.robust_z(res, "res", ["grp"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "z")


@query(
    "minmax01",
    with_views(
        ["pairs"],
        {"lim": "SELECT grp, min(y_raw) AS lo, max(y_raw) AS hi FROM pairs GROUP BY grp"},
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6('(y_raw - lo) / (hi - lo + 1e-12)', 'y_raw_n')} FROM pairs JOIN lim USING (grp)",
    ),
)
def minmax01(spark, sf_dir):
    scaled = timeseries.minmax01(fx.pairs(spark, sf_dir), ["y_raw"], ["grp"])
    return scaled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y_raw_n")


@query(
    "contiguous_segments",
    with_views(
        ["site_readings"],
        GRID
        | {
            "n": "SELECT site_id, dt, coalesce(v > 45, false) AS f, row_number() OVER (PARTITION BY site_id ORDER BY dt) AS rn FROM grid",
            "runs": "SELECT site_id, dt, rn, rn - row_number() OVER (PARTITION BY site_id ORDER BY dt) AS run FROM n WHERE f",
        },
        f"SELECT site_id, {big('min(rn) - 1', 'start_index')}, {big('max(rn) - 1', 'end_index')}, min(dt) AS start_dt, max(dt) AS end_dt, "
        f"{big('count(*)', 'len')} FROM runs GROUP BY site_id, run HAVING count(*) >= 2",
    ),
)
def contiguous_segments(spark, sf_dir):
    return timeseries.contiguous_segments(grid(spark, sf_dir), F.col("v") > 45, "dt", ["site_id"], 2)


@query(
    "series_stats_ar1",
    with_views(
        ["site_readings"],
        GRID
        | {
            "long": "SELECT site_id, 'v' AS channel, dt, v AS x FROM grid UNION ALL SELECT site_id, 'hum', dt, hum FROM grid",
            "lagged": "SELECT site_id, channel, x AS x1, lag(x) OVER (PARTITION BY site_id, channel ORDER BY dt) AS x0 FROM long WHERE x IS NOT NULL",
            "st": "SELECT site_id, channel, avg(x1) AS mu, stddev_pop(x1) AS sd, count(x1) AS n, "
            "stddev_pop(x0) AS s0, stddev_pop(CASE WHEN x0 IS NOT NULL THEN x1 END) AS s1, covar_pop(x0, x1) AS cv FROM lagged GROUP BY 1, 2",
        },
        f"SELECT site_id, channel, {r6('mu', 'mu')}, {r6('greatest(sd, 1e-6)', 'sd')}, "
        + r6("greatest(0.2, least(0.98, CASE WHEN n >= 5 AND s0 >= 1e-12 AND s1 >= 1e-12 THEN cv / (s0 * s1) ELSE 0.7 END))", "rho")
        + " FROM st",
    ),
)
def series_stats_ar1(spark, sf_dir):
    entries = [F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in ("v", "hum")]
    long = grid(spark, sf_dir).select("site_id", "dt", F.inline(F.array(*entries)))
    return timeseries.series_stats_ar1(long, "x", "dt", ["site_id", "channel"])


ORDER_SQL = ", ".join(fx.PAIR_ORDER)
NUMBERED = {
    "num": f"SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS rn, count(*) OVER () AS n FROM pairs",
}
# Half-to-even rounding of 20 % of the training rows.
SPLIT = NUMBERED | {
    "sized": "SELECT *, n - greatest(1, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT)) AS n_train FROM num",
    "split": "SELECT *, CASE WHEN rn > n_train THEN 'test' WHEN rn > greatest(50, n_train - greatest(50, "
    "CAST(round_even(n_train * 0.2::DOUBLE, 0) AS BIGINT))) THEN 'cal' ELSE 'fit' END AS part FROM sized",
}
ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def split_pairs(spark, sf_dir):
    return ordering.time_split(fx.pairs(spark, sf_dir), fx.PAIR_ORDER)


@query("global_row_number", with_views(["pairs"], NUMBERED, f"SELECT {ID}, {big('rn', 'rn')} FROM num"))
def global_row_number(spark, sf_dir):
    return ordering.global_row_number(fx.pairs(spark, sf_dir), fx.PAIR_ORDER).select(*fx.PAIR_ORDER[1:], "rn")


@query("time_split", with_views(["pairs"], SPLIT, f"SELECT {ID}, part FROM split"))
def time_split(spark, sf_dir):
    return split_pairs(spark, sf_dir).select(*fx.PAIR_ORDER[1:], "part")


@query(
    "time_series_folds",
    with_views(
        ["pairs"],
        NUMBERED,
        f"SELECT {ID}, {big('greatest(0, 5 - ((n - rn) // (n // 6)))', 'fold')} FROM num",
    ),
)
def time_series_folds(spark, sf_dir):
    return ordering.time_series_folds(fx.pairs(spark, sf_dir), fx.PAIR_ORDER, 5).select(*fx.PAIR_ORDER[1:], "fold")
