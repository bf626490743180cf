"""Agreement and error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import stats
from .clean import drop_any_null, q
from .quantiles import exact_quantiles, one_row


def agreement_metrics(
    aligned: DataFrame, truth: str = "station", estimate: str = "company", keys: Sequence[str] = ()
) -> DataFrame:
    """Per key: coverage over all hours, errors over matched hours where both sides are present."""
    usable = F.col("matched") & q(truth).isNotNull() & q(estimate).isNotNull()
    t, e = F.when(usable, q(truth)), F.when(usable, q(estimate))
    return aligned.groupBy(*keys).agg(
        F.count("*").alias("total_hours"),
        F.count_if("matched").alias("matched_hours"),
        F.try_divide(F.count_if("matched").cast("double"), F.count("*")).alias("coverage"),
        F.avg(F.when(usable, F.col("n_points"))).alias("mean_n_points"),
        stats.mae(t, e).alias("mae"),
        stats.rmse(t, e).alias("rmse"),
        stats.bias(t, e).alias("bias"),
    )


def matched_pairs(aligned: DataFrame, truth: str = "station", estimate: str = "company") -> DataFrame:
    return drop_any_null(aligned.where("matched"), [truth, estimate])


def corr_metrics(pairs: DataFrame, x: str = "station", y: str = "company", keys: Sequence[str] = ()) -> DataFrame:
    """Per key: errors, Pearson r and the least-squares line ``y = slope * x + intercept``."""
    return drop_any_null(pairs, [x, y]).groupBy(*keys).agg(
        F.count("*").alias("n"),
        stats.mae(q(x), q(y)).alias("mae"),
        stats.rmse(q(x), q(y)).alias("rmse"),
        stats.bias(q(x), q(y)).alias("bias"),
        stats.pearson(q(x), q(y)).alias("r"),
        F.regr_slope(q(y), q(x)).alias("slope"),
        F.regr_intercept(q(y), q(x)).alias("intercept"),
    )


def corr_pvalue(pairs: DataFrame, x: str = "station", y: str = "company", keys: Sequence[str] = ()) -> DataFrame:
    """Pairs, Pearson r and its two-sided p-value, per key."""
    table = drop_any_null(pairs, [x, y]).groupBy(*keys).agg(F.count("*").alias("n"), stats.pearson(q(x), q(y)).alias("r"))
    return table.withColumn("p_value", stats.correlation_p_value(F.col("r"), F.col("n")))


def residual_trend(
    pairs: DataFrame, truth: str = "station", estimate: str = "company", keys: Sequence[str] = ()
) -> DataFrame:
    """Per key: least-squares line of the residual over the reference level."""
    res = q(estimate) - q(truth)
    return pairs.groupBy(*keys).agg(
        F.count(res).alias("n"),
        F.regr_slope(res, q(truth)).alias("slope"),
        F.regr_intercept(res, q(truth)).alias("intercept"),
    )


def pack_exprs(y_true: Column, y_pred: Column, prefix: str = "") -> list[Column]:
    return [
        stats.mae(y_true, y_pred).alias(f"{prefix}mae"),
        stats.rmse(y_true, y_pred).alias(f"{prefix}rmse"),
        stats.r_squared(y_true, y_pred).alias(f"{prefix}r2"),
        stats.concordance(y_true, y_pred).alias(f"{prefix}ccc"),
        stats.bias(y_true, y_pred).alias(f"{prefix}bias"),
        stats.pearson(y_true, y_pred).alias(f"{prefix}r"),
    ]


def metrics_pack(df: DataFrame, y_true: str, y_pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R², concordance, bias (pred − true) and r per key, in one aggregation."""
    return df.groupBy(*keys).agg(F.count(q(y_true) + q(y_pred)).alias("n"), *pack_exprs(q(y_true), q(y_pred)))


def channel_errors(aligned: DataFrame, keep: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Long ``(keep…, channel, error)`` with error = sensor window mean − station."""
    entries = [
        F.struct(F.lit(c).alias("channel"), (q(f"mc_{c}_mean") - q(c)).alias("error")) for c in channels
    ]
    return aligned.select(*map(q, keep), F.inline(F.array(*entries)))


def diurnal_mean(df: DataFrame, ts: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.hour(q(ts)).alias("hour_of_day")).agg(F.avg(q(x)).alias("mean"), F.count(q(x)).alias("n"))


def residual_band(df: DataFrame, res: str, lo: float = 0.05, hi: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    band = exact_quantiles(df, [res], [lo, hi], keys)
    return band.select(*map(q, keys), q(res)[0].alias("q_lo"), q(res)[1].alias("q_hi"))


def _cell(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Index of ``x`` among equal-width bins on [lo, hi], the last bin closed."""
    pos = F.coalesce(F.try_divide((x - lo) * bins, hi - lo), F.lit(0.0))
    return F.least(F.floor(pos), F.lit(bins - 1)).cast("int")


def density_2d(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """Counts on a bins × bins grid over the value ranges; empty cells are left out."""
    df = drop_any_null(df, [x, y]).select(q(x).alias("x"), q(y).alias("y"))
    r = one_row(df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    return df.groupBy(
        _cell(F.col("x"), r["x0"], r["x1"], bins).alias("x_bin"), _cell(F.col("y"), r["y0"], r["y1"], bins).alias("y_bin")
    ).agg(F.count("*").alias("n"))


def histogram_equal_width(df: DataFrame, x: str, bins: int = 40) -> DataFrame:
    """All ``bins`` equal-width bins with edges and counts."""
    df = drop_any_null(df, [x]).select(q(x).cast("double").alias("x"))
    r = one_row(df.agg(F.min("x").alias("x0"), F.max("x").alias("x1")))
    counts = df.groupBy(_cell(F.col("x"), r["x0"], r["x1"], bins).alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (r["x1"] - r["x0"]) / bins
    return spine.join(counts, "bin", "left").select(
        "bin",
        (r["x0"] + width * F.col("bin")).alias("lo"),
        (r["x0"] + width * (F.col("bin") + 1)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
