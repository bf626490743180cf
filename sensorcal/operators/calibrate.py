"""Calibration: linear corrections, gates, fallback, delivery and summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import stats
from .clean import clip_nonneg, q
from .lookup import beside
from .metrics import pack_exprs


def _attach(df: DataFrame, params: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Parameter columns beside the rows: joined by key, or the single parameter row."""
    if keys:
        return beside(df, params.select(*keys, *cols), keys)
    row = params.select(F.struct(*cols).alias("s")).scalar()
    return df.withColumn("_p", row).withColumns({c: F.col(f"_p.{c}") for c in cols}).drop("_p")


def fit_posthoc(
    df: DataFrame, y_true: str, y_pred: str, keys: Sequence[str] = (), min_points: int = 20, use: Column | None = None
) -> DataFrame:
    """Least squares ``y_true ≈ a · y_pred + b`` per key over the rows where ``use`` holds; identity below ``min_points``."""
    t, p = q(y_true), q(y_pred)
    if use is not None:
        t = F.when(use, t)
    n, slope = F.count(t + p), F.regr_slope(t, p)
    ok = (n >= max(2, min_points)) & slope.isNotNull()
    return df.groupBy(*keys).agg(
        n.alias("n_fit"),
        F.when(ok, slope).otherwise(F.lit(1.0)).alias("a"),
        F.when(ok, F.regr_intercept(t, p)).otherwise(F.lit(0.0)).alias("b"),
        F.coalesce(ok, F.lit(False)).alias("fitted"),
    )


def apply_posthoc(df: DataFrame, params: DataFrame, y_pred: str, out: str, keys: Sequence[str] = (), clip: bool = False) -> DataFrame:
    """Adds ``out`` = a · y_pred + b."""
    fixed = F.coalesce("a", F.lit(1.0)) * q(y_pred) + F.coalesce("b", F.lit(0.0))
    applied = _attach(df, params, keys, ["a", "b"]).withColumn(out, clip_nonneg(fixed) if clip else fixed)
    return applied.drop("a", "b")


def gated_posthoc(
    df: DataFrame,
    y_true: str,
    y_pred: str,
    keys: Sequence[str] = (),
    part: str = "part",
    min_gain: float = 0.005,
    min_points: int = 50,
    min_train: int = 200,
    clip: bool = False,
) -> DataFrame:
    """Correction per key fitted on the ``cal`` rows and kept only when it lowers their RMSE by the share ``min_gain``.

    Keys with fewer than ``min_train`` training rows stay uncorrected. Columns ``a, b, posthoc_used, gain, n_train``.
    """
    keys = list(keys)
    cal = q(part) == "cal"
    fit = fit_posthoc(df, y_true, y_pred, keys, min_points, cal)
    t = F.when(cal, q(y_true))
    corrected = F.col("a") * q(y_pred) + F.col("b")
    if clip:
        corrected = clip_nonneg(corrected)
    judged = (
        _attach(df, fit, keys, ["a", "b", "fitted"])
        .groupBy(*keys)
        .agg(
            F.first("a").alias("a"),
            F.first("b").alias("b"),
            F.first("fitted").alias("fitted"),
            F.count_if(q(part) != "test").alias("n_train"),
            stats.rmse(t, q(y_pred)).alias("before"),
            stats.rmse(t, corrected).alias("after"),
        )
    )
    used = (
        F.col("fitted")
        & (F.col("n_train") >= min_train)
        & (F.col("before") > 1e-9)
        & (F.try_divide(F.col("before") - F.col("after"), F.col("before")) >= min_gain)
    )
    return judged.withColumn("posthoc_used", F.coalesce(used, F.lit(False))).select(
        *keys,
        F.when(F.col("posthoc_used"), F.col("a")).otherwise(F.lit(1.0)).alias("a"),
        F.when(F.col("posthoc_used"), F.col("b")).otherwise(F.lit(0.0)).alias("b"),
        "posthoc_used",
        F.when(F.col("posthoc_used"), F.col("before") - F.col("after")).otherwise(F.lit(0.0)).alias("gain"),
        "n_train",
    )


def with_fallback(
    df: DataFrame, y_true: str, raw: str, cal: str, keys: Sequence[str] = (), judge: Column | None = None
) -> DataFrame:
    """Replaces ``cal`` by ``raw`` for keys whose calibrated RMSE is worse on the rows where ``judge`` holds.

    Adds ``used_fallback``. The usual judge is the test part; pass the calibration part to keep the test honest.
    """
    t = q(y_true) if judge is None else F.when(judge, q(y_true))
    flags = df.groupBy(*keys).agg(
        F.coalesce(stats.rmse(t, q(cal)) > stats.rmse(t, q(raw)), F.lit(False)).alias("used_fallback")
    )
    flagged = _attach(df, flags, keys, ["used_fallback"])
    return flagged.withColumn(cal, F.when(F.col("used_fallback"), q(raw)).otherwise(q(cal)))


def calibration_summary(df: DataFrame, y_true: str, raw: str, cal: str, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics before and after calibration with the improvements, one aggregation."""
    table = df.groupBy(*keys).agg(
        F.count(q(y_true)).alias("n"),
        *pack_exprs(q(y_true), q(raw), "base_"),
        *pack_exprs(q(y_true), q(cal), "cal_"),
    )
    return table.withColumns(
        {
            "improve_rmse": F.col("base_rmse") - F.col("cal_rmse"),
            "improve_mae": F.col("base_mae") - F.col("cal_mae"),
        }
    )


def performance_table(
    delivered: DataFrame,
    gate: DataFrame,
    y_true: str,
    raw: str,
    cal: str,
    keys: Sequence[str],
    part: str = "part",
    method: str = "direct",
    tol_minutes: float | None = None,
) -> DataFrame:
    """:func:`calibration_summary` per key and part with how the key was calibrated.

    Adds ``n_train, n_test, cal_method, tol_minutes, used_fallback, posthoc_used, posthoc_a, posthoc_b, posthoc_gain``;
    ``gate`` is what :func:`gated_posthoc` gave for the keys, ``delivered`` carries ``used_fallback``.
    """
    keys = list(keys)
    line = gate.select(*map(q, keys), "posthoc_used", F.col("a").alias("posthoc_a"), F.col("b").alias("posthoc_b"), F.col("gain").alias("posthoc_gain"))
    counts = delivered.groupBy(*map(q, keys)).agg(
        F.count_if(q(part) != "test").alias("n_train"), F.count_if(q(part) == "test").alias("n_test"), F.first("used_fallback").alias("used_fallback")
    )
    table = calibration_summary(delivered, y_true, raw, cal, [*keys, part])
    return beside(beside(table, counts, keys), line, keys).withColumns(
        {"cal_method": F.lit(method), "tol_minutes": F.lit(tol_minutes).cast("double")}
    )
