"""Feature columns, feature lists and train-fitted preprocessing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .clean import q
from .quantiles import exact_medians, one_row

STATS = ("mean", "std", "iqr")
# Calendar and alignment-quality columns used as model features.
TIME_FEATURES = ("t_days", "sin_hour", "cos_hour", "sin_month", "cos_month", "is_weekend")
QUALITY_FEATURES = ("n_points", "min_delta_sec")


def short_name(target: str) -> str:
    """Name of a channel as used in file and column names."""
    return target.lower().replace(".", "")


def log_level(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def derived_features(aligned: DataFrame, target: str, hum: str = "Humidity", log_of: str | None = None) -> DataFrame:
    """Level and humidity interactions of an aligned table; columns whose inputs are missing are skipped."""
    cols, out = aligned.columns, {}
    if log_of and log_of in cols:
        out[f"log_st_{short_name(log_of)}"] = log_level(q(log_of))
    mc, h = f"mc_{target}_mean", f"mc_{hum}_mean"
    if h in cols:
        # The leading channel's interaction is a covariate of every target.
        if log_of and log_of in cols:
            out[f"{short_name(log_of)}_hum"] = q(log_of) * q(h)
        if target in cols:
            out[f"{short_name(target)}_hum"] = q(target) * q(h)
        if mc in cols:
            out[f"{mc}_x_hum"] = q(mc) * q(h)
    if target == "O3" and "mc_NO2_mean" in cols and "sin_hour" in cols:
        out["mc_NO2_mean_x_sin_hour"] = q("mc_NO2_mean") * q("sin_hour")
    return aligned.withColumns(out) if out else aligned


def _stat_columns(names: Sequence[str]) -> list[str]:
    return [f"mc_{c}_{s}" for c in names for s in STATS]


def explain_features(columns: Sequence[str], target: str, channels: Sequence[str], weather: Sequence[str], log_of: str = "") -> list[str]:
    """Features explaining the error of ``target``: station levels and other sensors, never the target's own sensor."""
    others = [c for c in channels if c != target]
    wanted = [
        *channels,
        f"log_st_{short_name(log_of)}",
        *_stat_columns(others),
        *_stat_columns(weather),
        *TIME_FEATURES,
        *QUALITY_FEATURES,
        f"{short_name(target)}_hum",
        f"{short_name(log_of)}_hum",
    ]
    return list(dict.fromkeys(c for c in wanted if c in columns))


def deploy_features(columns: Sequence[str], target: str, channels: Sequence[str], weather: Sequence[str]) -> list[str]:
    """Features available without a station: sensor windows, weather, calendar, alignment quality."""
    others = [c for c in channels if c != target]
    wanted = [
        *_stat_columns([target]),
        *_stat_columns(others),
        *_stat_columns(weather),
        *TIME_FEATURES,
        "hour_of_day",
        *QUALITY_FEATURES,
        f"mc_{target}_mean_x_hum",
        *(["mc_NO2_mean_x_sin_hour"] if target == "O3" else []),
    ]
    return list(dict.fromkeys(c for c in wanted if c in columns))


def impute_median(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Missing values replaced by the exact median of the training rows."""
    med = one_row(exact_medians(train or df, cols).toDF(*[f"m{i}" for i in range(len(cols))]))
    return df.withColumns({c: F.coalesce(q(c), med[f"m{i}"]) for i, c in enumerate(cols)})


def standardize(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Mean 0 and population deviation 1 on the training rows; constant columns are only centred."""
    stats = []
    for i, c in enumerate(cols):
        stats += [F.avg(q(c)).alias(f"a{i}"), F.stddev_pop(q(c)).alias(f"s{i}")]
    row = one_row((train or df).agg(*stats))
    return df.withColumns(
        {
            c: (q(c) - row[f"a{i}"]) / F.when(row[f"s{i}"] == 0, F.lit(1.0)).otherwise(row[f"s{i}"])
            for i, c in enumerate(cols)
        }
    )


def bspline_position_sql(x: str, lo: str, hi: str, knots: int = 6) -> str:
    """SQL of the place of x among ``knots`` uniform knots over [lo, hi], from 0 to knots − 1; held constant outside."""
    clamped = f"greatest(least({x}, {hi}), {lo})"
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce(try_divide(({clamped} - {lo}) * {knots - 1}, {hi} - {lo}), 0D) END"


def bspline_sql(pos: str, j: int) -> str:
    """SQL of the j-th cubic B-spline at a present place ``pos`` from :func:`bspline_position_sql`.

    Written with two clipped cubes, which keeps the generated code of many basis columns small.
    """
    d = f"abs({pos} + {1 - j})"
    return f"(pow(greatest(2D - {d}, 0D), 3) - 4 * pow(greatest(1D - {d}, 0D), 3)) / 6D"


def bspline_basis(df: DataFrame, x: str, knots: int = 6, train: DataFrame | None = None) -> DataFrame:
    """Adds ``<x>_s0…``: all cubic basis columns but the last, knots spread over the training range."""
    r = one_row((train or df).agg(F.min(q(x)).cast("double").alias("lo"), F.max(q(x)).cast("double").alias("hi")))
    placed = df.withColumns({"_lo": r["lo"], "_hi": r["hi"]}).withColumn(
        "_pos", F.expr(bspline_position_sql(f"`{x}`", "_lo", "_hi", knots))
    )
    basis = {
        f"{x}_s{j}": F.when(F.col("_pos").isNotNull(), F.expr(bspline_sql("_pos", j))) for j in range(knots + 1)
    }
    return placed.withColumns(basis).drop("_lo", "_hi", "_pos")
