"""Global order: row numbers, chronological splits and expanding folds without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialize


def global_row_number(df: DataFrame, order_cols: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Adds ``name`` = 1..n by ``order_cols`` (which must end in a unique tail) and ``name + '_total'`` = n.

    Range-partitioned sort, written once; each partition's rows are numbered by their position and shifted by
    the sizes of the partitions before it. Only the table of partition sizes is windowed as a whole.
    """
    low_bits = (1 << 33) - 1
    placed = materialize(
        df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_pid", F.shiftrightunsigned("_mid", 33))
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_pid",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"),
        F.sum("_size").over(whole).alias(f"{name}_total"),
    )
    # One row per partition of the sort: bounded by the partition count, not by the data.
    return (
        placed.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(low_bits) + 1)
        .drop("_pid", "_mid", "_off")
    )


def holdout_size(n: Column, ratio: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(float(ratio)))).cast("long")


def tail_split_size(n: Column, ratio: float, least: int = 50) -> Column:
    """Rows of the fitting part when the last ``ratio`` (half-to-even rounded, at least ``least``) is set aside."""
    n_cal = F.greatest(F.lit(least), F.bround(n * F.lit(float(ratio)))).cast("long")
    return F.greatest(F.lit(least), n - n_cal).cast("long")


def _fold(rn: Column, n: Column, k: int) -> Column:
    """Fold of row ``rn`` among the first ``n``: the last k blocks of n div (k + 1) rows are folds 1..k, the rest is 0."""
    size = F.floor(n / F.lit(k + 1))
    from_end = F.floor((n - rn) / F.greatest(size, F.lit(1)))
    return F.when(size > 0, F.greatest(F.lit(0), F.lit(k) - from_end)).otherwise(F.lit(0)).cast("int")


def time_split(
    df: DataFrame, order_cols: Sequence[str], ratio: float = 0.2, cal_ratio: float = 0.2, folds: int | None = None
) -> DataFrame:
    """Adds ``part``: ``test`` for the last part by time; training rows are ``fit`` or, in their tail, ``cal``.

    With ``folds`` the training rows also get their cross-validation ``fold`` from the same numbering.
    """
    numbered = global_row_number(df, order_cols, "_rn")
    rn = F.col("_rn")
    n_train = F.col("_rn_total") - holdout_size(F.col("_rn_total"), ratio)
    part = F.when(rn > n_train, "test").when(rn > tail_split_size(n_train, cal_ratio), "cal").otherwise("fit")
    added = {"part": part}
    if folds is not None:
        added["fold"] = F.when(rn <= n_train, _fold(rn, n_train, folds))
    return numbered.withColumns(added).drop("_rn", "_rn_total")


def time_series_folds(df: DataFrame, order_cols: Sequence[str], k: int = 5) -> DataFrame:
    """Adds ``fold``: 0 for rows only ever trained on, i = 1..k for the rows tested in fold i.

    Fold i is trained on every row with a smaller fold number.
    """
    numbered = global_row_number(df, order_cols, "_rn")
    return numbered.withColumn("fold", _fold(F.col("_rn"), F.col("_rn_total"), k)).drop("_rn", "_rn_total")
