"""Cleaning of raw readings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import no_nan
from ..functions.time import hour_ceil, hour_floor, minutes_between
from ..runtime import materialize
from ..schema import SensorSchema, strip_headers
from .lookup import beside
from .quantiles import exact_medians, exact_quantiles, one_row


def q(name: str) -> Column:
    """Column by exact name (channel names contain dots)."""
    return F.col(f"`{name}`")


def coerce_time(df: DataFrame, time: str) -> DataFrame:
    """Timestamps from text; rows whose time does not parse are dropped."""
    return df.withColumn(time, q(time).try_cast("timestamp_ntz")).where(q(time).isNotNull())


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Doubles from text; junk and NaN become NULL. Columns that do not exist are skipped."""
    return df.withColumns({c: no_nan(q(c).try_cast("double")) for c in cols if c in df.columns})


def dedupe_time(df: DataFrame, keys: Sequence[str], measures: Sequence[str], others: Mapping[str, str] | None = None) -> DataFrame:
    """One row per key: mean of measures, first present value of other columns in the order of their tie-break column."""
    firsts = [F.min_by(q(c), F.when(q(c).isNotNull(), q(o))).alias(c) for c, o in (others or {}).items()]
    return df.groupBy(*map(q, keys)).agg(*[F.avg(q(c)).alias(c) for c in measures], *firsts)


def unit_factor(median: Column, rules: Sequence[tuple[float, float, float]]) -> Column:
    factor = F.lit(1.0)
    for lo, hi, f in reversed(rules):
        factor = F.when(median.between(lo, hi), F.lit(f)).otherwise(factor)
    return factor


def normalize_unit(
    df: DataFrame, col: str, rules: Sequence[tuple[float, float, float]], keys: Sequence[str] = ()
) -> DataFrame:
    """Rescale a column whose median shows which unit it is in; ``keys`` decides per sensor instead of for all rows."""
    if not keys:
        med = one_row(exact_medians(df, [col]).toDF("m"))["m"]
        return df.withColumn(col, q(col) * unit_factor(med, rules))
    med = exact_medians(df, [col], keys).select(*keys, unit_factor(q(col), rules).alias("_factor"))
    return (
        beside(df, med, list(keys))
        .withColumn(col, q(col) * F.coalesce("_factor", F.lit(1.0)))
        .drop("_factor")
    )


def range_null_out(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """NULL instead of values outside their (inclusive) valid range; rows stay."""
    out = {}
    for c, (lo, hi) in ranges.items():
        if c not in df.columns:
            continue
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (q(c) >= lo)
        if hi is not None:
            ok = ok & (q(c) <= hi)
        out[c] = F.when(ok, q(c))
    return df.withColumns(out) if out else df


def winsorize(
    df: DataFrame, cols: Sequence[str], lo: float = 0.005, hi: float = 0.995, keys: Sequence[str] = ()
) -> DataFrame:
    """Clip each column to its own exact quantiles, of all rows or per ``keys``; missing values stay missing."""
    cols = [c for c in cols if c in df.columns]
    names = [f"_w{i}" for i in range(len(cols))]
    if keys:
        limits = exact_quantiles(df, cols, [lo, hi], keys)
        limits = limits.select(*map(q, keys), *[q(c).alias(n) for c, n in zip(cols, names, strict=True)])
        near = beside(df, limits, list(keys))
        clipped = {
            c: F.when(q(c).isNotNull(), F.greatest(F.col(n)[0], F.least(F.col(n)[1], q(c))))
            for c, n in zip(cols, names, strict=True)
        }
        return near.withColumns(clipped).drop(*names)
    limits = one_row(exact_quantiles(df, cols, [lo, hi]).toDF(*names))
    return df.withColumns(
        {
            c: F.when(q(c).isNotNull(), F.greatest(limits[n][0], F.least(limits[n][1], q(c))))
            for c, n in zip(cols, names, strict=True)
        }
    )


def drop_all_null(df: DataFrame, keep: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Only the wanted columns, and only rows with at least one measurement."""
    measures = [c for c in measures if c in df.columns]
    present = F.coalesce(*[q(c).cast("string") for c in measures]).isNotNull()
    return df.select(*map(q, keep), *map(q, measures)).where(present)


def drop_any_null(df: DataFrame, required: Sequence[str]) -> DataFrame:
    ok = F.lit(True)
    for c in required:
        ok = ok & q(c).isNotNull()
    return df.where(ok)


def exclude_days(df: DataFrame, ts: str, days: Mapping[str, Sequence[str]], target: Column) -> DataFrame:
    """Drop the excluded days of each target."""
    bad = F.lit(False)
    for name, dates in days.items():
        bad = bad | ((target == name) & F.to_date(q(ts)).isin([F.lit(d).cast("date") for d in dates]))
    return df.where(~bad)


def clip_nonneg(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def missing_report(df: DataFrame, name: str, cols: Sequence[str]) -> DataFrame:
    """One row per column: table name, table shape and share of missing values."""
    cols = [c for c in cols if c in df.columns]
    rates = df.agg(
        F.count("*").alias("_n"), *[F.avg(q(c).isNull().cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)]
    )
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing_rate")) for i, c in enumerate(cols)]
    return rates.select(
        F.lit(name).alias("name"),
        F.col("_n").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("cols"),
        F.inline(F.array(*entries)),
    )


def hour_anchors(df: DataFrame, time: str) -> DataFrame:
    """Full hour before, after and nearest (ties: before) with distances in minutes."""
    t = q(time)
    df = df.withColumns({"hour_floor": hour_floor(t), "hour_ceil": hour_ceil(t)})
    df = df.withColumns(
        {
            "delta_floor_min": minutes_between(F.col("hour_floor"), t),
            "delta_ceil_min": minutes_between(t, F.col("hour_ceil")),
        }
    )
    before = F.col("delta_floor_min") <= F.col("delta_ceil_min")
    return df.withColumns(
        {
            "hour_nearest": F.when(before, F.col("hour_floor")).otherwise(F.col("hour_ceil")),
            "delta_nearest_min": F.least("delta_floor_min", "delta_ceil_min"),
        }
    )


def clean_readings(
    df: DataFrame,
    schema: SensorSchema,
    ranges: Mapping[str, tuple[float | None, float | None]],
    unit_rules: Mapping[str, Sequence[tuple[float, float, float]]] | None = None,
    winsor: tuple[float, float] | None = (0.005, 0.995),
    others: Mapping[str, str] | None = None,
) -> DataFrame:
    """Parse, de-duplicate, fix units, null out impossible values, winsorize, add hour anchors — in this order.

    With ``schema.keys`` each sensor has its own unit and limits. The de-duplicated table is written once, because medians
    and quantiles read it again.
    """
    df = strip_headers(df)
    measures = [c for c in schema.measures if c in df.columns]
    df = coerce_numeric(coerce_time(df, schema.time), measures)
    df = materialize(dedupe_time(df, [*schema.keys, schema.time], measures, others), "readings")
    for col, rules in (unit_rules or {}).items():
        df = normalize_unit(df, col, rules, schema.keys)
    df = range_null_out(df, ranges)
    if winsor:
        df = winsorize(df, measures, *winsor, keys=schema.keys)
    return hour_anchors(df, schema.time)
