"""Series on a regular grid: calendar features, resampling, robust scores, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import DAY_US, cyclic, epoch_us, floor_to, from_epoch_us
from ..runtime import materialize
from .clean import q
from .lookup import beside
from .quantiles import exact_medians, one_row


# Bins of a gap that one task's array holds at most.
GAP_BLOCK = 4096


def time_features(df: DataFrame, ts: str) -> DataFrame:
    """Calendar columns; ``t_days`` counts from the table's first time."""
    t = q(ts)
    start = one_row(df.agg(F.min(t).alias("t0")))["t0"]
    hour, month = F.hour(t), F.month(t)
    sin_hour, cos_hour = cyclic(hour, 24.0)
    sin_month, cos_month = cyclic(month - 1, 12.0)
    dow = F.weekday(t)
    return df.withColumns(
        {
            "t_days": F.timestamp_diff("MICROSECOND", start, t) / F.lit(float(DAY_US)),
            "hour_of_day": hour,
            "dow": dow,
            "month": month,
            "is_weekend": (dow >= 5).cast("int"),
            "sin_hour": sin_hour,
            "cos_hour": cos_hour,
            "sin_month": sin_month,
            "cos_month": cos_month,
        }
    )


def resample_mean(df: DataFrame, ts: str, step_us: int, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Means on a fixed grid: every key gets every bin between the first and the last of the table, empty bins as NULL.

    Missing bins come from the gaps between a key's bins, and before its first and after its last; a gap is cut into
    blocks that are dealt out, so no array is longer than ``GAP_BLOCK`` bins and a key without readings for years is
    no single task's work. Nothing is joined. The bins that have readings are written once.
    """
    keys = list(keys)
    binned = df.select(*map(q, keys), floor_to(q(ts), step_us).alias("dt"), *map(q, cols))
    means = materialize(binned.groupBy(*map(q, keys), "dt").agg(*[F.avg(q(c)).alias(c) for c in cols]), "bins")
    us, step = epoch_us(F.col("dt")), F.lit(step_us)
    span = one_row(means.agg(F.min("dt").alias("t0"), F.max("dt").alias("t1")))
    lo, hi = epoch_us(span["t0"]) - step, epoch_us(span["t1"]) + step
    following = F.lead(us).over(Window.partitionBy(*map(q, keys)).orderBy("dt"))
    between = means.where(F.col("dt").isNotNull()).select(*map(q, keys), us.alias("_a"), following.alias("_b"))
    # A key without any time has one gap from end to end.
    ends = means.groupBy(*map(q, keys)).agg(F.min(us).alias("_first"), F.max(us).alias("_last")).select(
        *map(q, keys),
        F.inline(F.array(F.struct(lo.alias("_a"), F.coalesce("_first", hi).alias("_b")), F.struct(F.col("_last").alias("_a"), hi.alias("_b")))),
    )
    gaps = between.unionByName(ends).where(F.col("_b") - F.col("_a") > step).withColumn("_n", F.floor((F.col("_b") - F.col("_a")) / step) - 1)
    block = F.lit(GAP_BLOCK).cast("long")
    blocks = gaps.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, block)).alias("_s"))
    dealt = blocks.repartition(*map(q, keys), "_a", "_s")
    bins = dealt.select(*map(q, keys), "_a", F.explode(F.sequence(F.col("_s") + 1, F.least(F.col("_s") + block, F.col("_n")))).alias("_i"))
    kinds = {f.name: f.dataType for f in means.schema}
    empty = bins.select(
        *map(q, keys), from_epoch_us(F.col("_a") + F.col("_i") * step).alias("dt"), *[F.lit(None).cast(kinds[c]).alias(c) for c in cols]
    )
    return means.where(F.col("dt").isNotNull()).unionByName(empty)


def first_difference(df: DataFrame, x: str, order: str, keys: Sequence[str]) -> DataFrame:
    """Adds ``diff`` for every row but the first of each key (which is dropped); expects grid series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (
        df.withColumns({"diff": q(x) - F.lag(q(x)).over(w), "_rn": F.row_number().over(w)})
        .where(F.col("_rn") > 1)
        .drop("_rn")
    )


def robust_z(df: DataFrame, x: str, keys: Sequence[str] = (), name: str = "z") -> DataFrame:
    """Adds 0.6745 · (x − median) / (MAD + 1e-9) per key.

    Two rounds of exact medians, joined back; rows with their median are written once between the rounds.
    Input that is costly to compute should be materialized by the caller.
    """
    keys = list(keys)
    if keys:
        med = exact_medians(df.withColumn("_med", q(x)), ["_med"], keys)
        with_med = materialize(beside(df, med, keys), "centred")
        mad = exact_medians(with_med.withColumn("_dev", F.abs(q(x) - F.col("_med"))), ["_dev"], keys)
        centred, med_c, mad_c = beside(with_med, mad, keys), F.col("_med"), F.col("_dev")
    else:
        med_c = one_row(exact_medians(df, [x]).toDF("m"))["m"]
        mad = exact_medians(df.select(F.abs(q(x) - med_c).alias("_dev")), ["_dev"])
        centred, mad_c = df, one_row(mad)["_dev"]
    z = F.lit(0.6745) * (q(x) - med_c) / (mad_c + F.lit(1e-9))
    return centred.withColumn(name, z).drop("_med", "_dev")


def minmax01(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), suffix: str = "_n") -> DataFrame:
    """Adds each column scaled to [0, 1] per key; all zeros (missing entries too) when the range is below 1e-12."""
    keys, eps = list(keys), F.lit(1e-12)
    ranges = df.groupBy(*keys).agg(
        *[F.min(q(c)).alias(f"_lo_{c}") for c in cols], *[F.max(q(c)).alias(f"_hi_{c}") for c in cols]
    )
    if keys:
        joined = beside(df, ranges, keys)
        bound = F.col
    else:
        joined, row = df, one_row(ranges)
        bound = lambda c: row[c]

    def scaled(c: str) -> Column:
        lo, hi = bound(f"_lo_{c}"), bound(f"_hi_{c}")
        flat = lo.isNull() | (hi - lo < eps)
        return F.when(flat, F.lit(0.0)).otherwise((q(c) - lo) / (hi - lo + eps))

    return joined.withColumns({f"{c}{suffix}": scaled(c) for c in cols}).drop(*[c for c in ranges.columns if c not in keys])


def contiguous_segments(
    df: DataFrame, flag: Column, order: str, keys: Sequence[str], min_len: int = 1
) -> DataFrame:
    """Runs of consecutive rows with a true flag per key: first/last row index (from 0), first/last time, length.

    Expects grid series, so a key has at most as many rows as the grid has bins.
    """
    keys = list(keys)
    marked = df.select(*keys, q(order).alias("_o"), F.coalesce(flag, F.lit(False)).alias("_f")).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))
    )
    in_run = marked.where("_f").withColumn(
        "_run", F.col("_rn") - F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))
    )
    return (
        in_run.groupBy(*keys, "_run")
        .agg(
            (F.min("_rn") - 1).alias("start_index"),
            (F.max("_rn") - 1).alias("end_index"),
            F.min("_o").alias("start_dt"),
            F.max("_o").alias("end_dt"),
            F.count("*").alias("len"),
        )
        .where(F.col("len") >= min_len)
        .drop("_run")
    )


def series_stats_ar1(df: DataFrame, x: str, order: str, keys: Sequence[str]) -> DataFrame:
    """Mean, population deviation (at least 1e-6) and lag-1 autocorrelation in [0.2, 0.98] of grid series per key.

    Missing values are left out before lagging; the autocorrelation is 0.7 below five values or without spread.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    pairs = df.where(q(x).isNotNull()).select(*keys, q(x).alias("x1"), F.lag(q(x)).over(w).alias("x0"))
    x0, x1 = F.col("x0"), F.when(F.col("x0").isNotNull(), F.col("x1"))
    s0, s1 = F.stddev_pop(x0), F.stddev_pop(x1)
    rho = F.try_divide(F.covar_pop(x0, x1), s0 * s1)
    usable = (F.count("x1") >= 5) & (s0 >= 1e-12) & (s1 >= 1e-12)
    return pairs.groupBy(*keys).agg(
        F.avg("x1").alias("mu"),
        F.greatest(F.stddev_pop("x1"), F.lit(1e-6)).alias("sd"),
        F.greatest(F.lit(0.2), F.least(F.lit(0.98), F.coalesce(F.when(usable, rho), F.lit(0.7)))).alias("rho"),
    )
