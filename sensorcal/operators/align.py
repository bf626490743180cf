"""Time alignment of irregular sensor readings with a reference series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import MINUTE_US, epoch_us, hour_floor
from ..runtime import materialize
from .clean import hour_anchors, q
from .quantiles import exact_quantiles


def near_full_hour(micro: DataFrame, time: str, tol_minutes: float) -> DataFrame:
    """Readings at most ``tol_minutes`` from a full hour, with that hour as ``hour`` and the distance as ``delta_min``."""
    return (
        hour_anchors(micro, time)
        .where(F.col("delta_nearest_min") <= tol_minutes)
        .withColumnsRenamed({"hour_nearest": "hour", "delta_nearest_min": "delta_min"})
        .drop("hour_floor", "hour_ceil", "delta_floor_min", "delta_ceil_min")
    )


def _beside_group(rows: DataFrame, stats: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left join on a group of columns; NULL keys meet NULL keys."""
    right = stats.select(*[q(c).alias(f"_s_{c}" if c in group else c) for c in stats.columns])
    same = reduce(Column.__and__, [q(k).eqNullSafe(q(f"_s_{k}")) for k in group])
    return rows.join(right, same, "left").drop(*[f"_s_{k}" for k in group])


def hour_window_stats(
    micro: DataFrame, time: str, value: str, tol_minutes: float = 5, keys: Sequence[str] = ()
) -> DataFrame:
    """Per key and full hour: present values, smallest distance, mean, median, sample deviation and interquartile range."""
    near = near_full_hour(micro, time, tol_minutes).select(*map(q, keys), "hour", "delta_min", q(value).alias("v"))
    group = [*keys, "hour"]
    basic = near.groupBy(*map(q, group)).agg(
        F.count("v").alias("n_points"),
        F.min("delta_min").alias("min_delta"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
    )
    spread = exact_quantiles(near, ["v"], [0.25, 0.5, 0.75], group).select(
        *map(q, group), F.col("v")[1].alias("median"), (F.col("v")[2] - F.col("v")[0]).alias("iqr")
    )
    same = [q(k) for k in group]
    return _beside_group(basic, spread, group).select(
        *same, "n_points", "min_delta", "mean", "median", "std", "iqr"
    )


def align_nearest_hour(
    station: DataFrame, micro: DataFrame, time: str, value: str, tol_minutes: float = 5, min_median: int = 3, keys: Sequence[str] = ()
) -> DataFrame:
    """Station rows ``(keys…, hour, y)`` with the sensor's value around that hour (median from ``min_median`` readings on, else mean)."""
    group = [*keys, "hour"]
    stats = hour_window_stats(micro, time, value, tol_minutes, keys).select(
        *map(q, group),
        F.when(F.col("n_points") >= min_median, F.col("median")).otherwise(F.col("mean")).alias("company"),
        "n_points",
        "min_delta",
        F.col("std").alias("std"),
        F.col("iqr").alias("iqr"),
    )
    return (
        _beside_group(station.withColumnRenamed("y", "station"), stats, group)
        .withColumn("n_points", F.coalesce("n_points", F.lit(0)))
        .withColumn("matched", F.col("n_points") > 0)
    )


def _cell_of(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(width_us)).cast("long")


def _cell_width(tol_us: int) -> int:
    return max(1, 2 * tol_us)


def _window_readings(
    station: DataFrame, micro: DataFrame, station_time: str, micro_time: str, cols: Sequence[str], tol_us: int, keys: list[str]
) -> DataFrame:
    """Every (station time, reading) pair with the reading inside the closed window, keyed by ``keys`` and ``_t``.

    The time axis is cut into cells as wide as a window, so a window touches at most two cells: an equality
    join on the cell plus the exact test, instead of comparing all rows with all rows. Tolerance 0 matches equal times.
    """
    cell = _cell_width(tol_us)

    times = station.select(*keys, q(station_time).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    t_us = epoch_us(F.col("_t"))
    windows = times.select(
        *keys,
        "_t",
        t_us.alias("_t_us"),
        F.explode(F.sequence(_cell_of(t_us - tol_us, cell), _cell_of(t_us + tol_us, cell))).alias("_cell"),
    )
    readings = micro.select(*keys, *map(q, cols), epoch_us(q(micro_time)).alias("_us")).withColumn(
        "_cell", _cell_of(F.col("_us"), cell)
    )
    delta = F.col("_us") - F.col("_t_us")
    return (
        windows.join(readings, [*keys, "_cell"])
        .where(delta.between(-tol_us, tol_us))
        .select(*keys, "_t", *map(q, cols), F.abs(F.floor(delta / F.lit(1_000_000))).cast("long").alias("_sec"))
    )


def align_window(
    station: DataFrame,
    micro: DataFrame,
    station_time: str,
    micro_time: str,
    cols: Sequence[str],
    tol_minutes: float = 5,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Station rows with statistics of all readings in ``[t - tol, t + tol]`` (windows may overlap).

    Adds ``matched, n_points`` (readings, missing values included), ``min_delta_sec`` and for each column
    ``mc_<col>_mean``, ``mc_<col>_std`` (population) and ``mc_<col>_iqr``. Rows without readings stay.
    """
    keys = list(keys)
    tol_us = int(tol_minutes * MINUTE_US)
    # Written, so that the join runs once for all statistics.
    inside = materialize(_window_readings(station, micro, station_time, micro_time, cols, tol_us, keys), "inside")
    group = [*keys, "_t"]
    stats = inside.groupBy(*group).agg(
        F.count("*").alias("n_points"),
        F.min("_sec").alias("min_delta_sec"),
        *[F.avg(q(c)).alias(f"mc_{c}_mean") for c in cols],
        *[F.stddev_pop(q(c)).alias(f"mc_{c}_std") for c in cols],
    )
    spread = exact_quantiles(inside, cols, [0.25, 0.75], group).select(
        *group, *[(q(c)[1] - q(c)[0]).alias(f"mc_{c}_iqr") for c in cols]
    )
    per_window = stats.join(spread, group, "left").withColumnRenamed("_t", station_time)
    return (
        station.join(per_window, [*keys, station_time], "left")
        .withColumn("n_points", F.coalesce("n_points", F.lit(0)))
        .withColumn("matched", F.col("n_points") > 0)
    )


def hourly_mean(df: DataFrame, time: str, values: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Hourly reference series ``(keys, hour, <name>…)`` from readings."""
    return df.groupBy(*keys, hour_floor(q(time)).alias("hour")).agg(*[F.avg(e).alias(n) for n, e in values.items()])
