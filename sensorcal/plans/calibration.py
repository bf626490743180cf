"""Calibrate every channel of an aligned table and deliver the corrected series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import model as m
from ..operators.calibrate import apply_posthoc, calibration_summary, fit_posthoc, gated_posthoc, with_fallback
from ..operators.clean import clip_nonneg, exclude_days, q
from ..operators.features import deploy_features, derived_features
from ..operators.lookup import beside
from ..operators.ordering import time_split
from ..runtime import materialize, run_together
from ..schema import PosthocParams


def calibrate_channel(
    aligned: DataFrame,
    target: str,
    channels: Sequence[str],
    weather: Sequence[str],
    time: str,
    id_cols: Sequence[str] = (),
    residual: bool = False,
    clip: bool = False,
    k: int = 5,
    forest: Mapping | None = None,
    excluded: Mapping[str, Sequence[str]] | None = None,
    correction: str = "gated",
    posthoc: PosthocParams = PosthocParams(),
) -> tuple[DataFrame, m.Fitted]:
    """Delivered series of one channel and its model.

    Columns: ids, ``time, target, part, truth, raw, calibrated, used_fallback, best_model, cal_method, posthoc_used,
    posthoc_a, posthoc_b, posthoc_gain``; ``part`` is NULL on
    rows outside the training pool (no truth, excluded day), which are calibrated all the same.
    ``correction`` is ``none``, ``linear`` (fitted on the training part) or ``gated``: fitted on the tail of the
    training part with a model that has not seen it, and used only when it helps there. The delivered model is
    trained on the whole training part. ``residual`` models the difference truth − raw.
    """
    if correction not in ("none", "linear", "gated"):
        raise ValueError(f"unknown correction {correction!r}")
    ids = [*id_cols, time]
    raw = f"mc_{target}_mean"
    df = derived_features(aligned.where("matched"), target, weather[0])
    feats = deploy_features(df.columns, target, channels, weather)
    df = df.withColumns({"truth": q(target), "raw": q(raw)})
    label = (F.col("truth") - F.col("raw")) if residual else F.col("truth")
    pool = exclude_days(df.withColumn("label", label).where("label is not null and raw is not null"), time, excluded or {}, F.lit(target))
    split = time_split(pool, [time, *id_cols], folds=k)
    train = split.where("part <> 'test'")
    splines = tuple(c for c in (raw, f"mc_{weather[0]}_mean", "t_days") if c in feats)
    ridge = m.RidgeSpline(splines, tuple(c for c in feats if c not in splines))
    best, _ = m.model_select([ridge, m.Forest(tuple(feats), **(forest or {}))], train, "label", k)

    def delivered(model: m.Fitted, rows: DataFrame) -> DataFrame:
        level = F.col("prediction") + F.col("raw") if residual else F.col("prediction")
        return model.transform(rows).withColumn("calibrated", clip_nonneg(level) if clip else level).drop("prediction")

    final = best.fit(train, "label")
    columns = [*df.columns, "part"]
    line = None
    if correction == "linear":
        line = fit_posthoc(delivered(final, train.select(*map(q, columns))), "truth", "calibrated")
    elif correction == "gated":
        early = best.fit(train.where("part = 'fit'"), "label")
        line = gated_posthoc(
            delivered(early, train.select(*map(q, columns))),
            "truth",
            "calibrated",
            min_gain=posthoc.gate(target),
            min_points=posthoc.min_points,
            min_train=posthoc.min_train,
            clip=clip,
        )
    parts = split.select(*ids, "part")
    full = delivered(final, df).join(parts, ids, "left")
    used = {"posthoc_used": F.lit(False), "posthoc_a": F.lit(1.0), "posthoc_b": F.lit(0.0), "posthoc_gain": F.lit(0.0)}
    if line is not None:
        line = materialize(line, "line")
        full = apply_posthoc(full, line, "calibrated", "calibrated", clip=clip)
        r = line.first()
        used |= {"posthoc_a": F.lit(r["a"]), "posthoc_b": F.lit(r["b"]), "posthoc_used": F.lit(r["fitted"] if correction == "linear" else r["posthoc_used"])}
        used["posthoc_gain"] = F.lit(r["gain"] if correction == "gated" else 0.0)
    full = with_fallback(full, "truth", "raw", "calibrated", judge=F.col("part") == "test")
    return (
        full.select(
            *ids,
            F.lit(target).alias("target"),
            "part",
            "truth",
            "raw",
            clip_nonneg(F.col("calibrated")).alias("calibrated") if clip else F.col("calibrated"),
            "used_fallback",
            F.lit(best.name).alias("best_model"),
            F.lit("residual" if residual else "direct").alias("cal_method"),
            *[v.alias(c) for c, v in used.items()],
        ),
        final,
    )


def calibrate_channels(aligned: DataFrame, channels: Sequence[str], weather: Sequence[str], time: str, residual: Sequence[str] = (), **kw) -> DataFrame:
    """Long series of all channels; the aligned table is written once and only channels are looped over."""
    aligned = materialize(aligned, "aligned")
    jobs = [
        partial(calibrate_channel, aligned, t, channels, weather, time, residual=t in residual, **kw) for t in channels
    ]
    return reduce(DataFrame.unionByName, [series for series, _ in run_together(aligned.sparkSession, jobs)])


def summarize(series: DataFrame, tol_minutes: float | None = None) -> DataFrame:
    """Before/after metrics on the test part of every channel, and how it was calibrated."""
    how = ["target", "best_model", "cal_method", "used_fallback", "posthoc_used", "posthoc_a", "posthoc_b", "posthoc_gain"]
    counts = series.groupBy("target").agg(F.count_if(F.col("part") != "test").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"))
    table = calibration_summary(series.where("part = 'test'"), "truth", "raw", "calibrated", how)
    return beside(table, counts, ["target"]).withColumn("tol_minutes", F.lit(tol_minutes).cast("double"))


def importance_table(
    aligned: DataFrame, channels: Sequence[str], weather: Sequence[str], time: str, id_cols: Sequence[str] = (), residual: Sequence[str] = (), repeats: int = 20, **kw
) -> DataFrame:
    """``target, feature, importance_mean, importance_std`` on the test part of every channel's delivered model."""
    aligned = materialize(aligned, "aligned")

    def one(target: str) -> DataFrame:
        series, model = calibrate_channel(aligned, target, channels, weather, time, id_cols, residual=target in residual, **kw)
        test = series.where("part = 'test'").select(*id_cols, time, "truth", "raw")
        rows = derived_features(aligned.where("matched"), target, weather[0]).join(test, [*id_cols, time])
        # A model of the difference is scored on the level it delivers.
        level = F.col("prediction") + F.col("raw") if target in residual else None
        return m.permutation_importance(model, rows, "truth", [time, *id_cols], repeats, delivered=level).withColumn("target", F.lit(target))

    return reduce(DataFrame.unionByName, run_together(aligned.sparkSession, [partial(one, t) for t in channels]))
