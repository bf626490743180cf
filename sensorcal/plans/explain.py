"""Why does the sensor err? Error models of all channels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import stats
from ..operators import model as m
from ..operators.clean import exclude_days, q
from ..operators.features import derived_features, explain_features
from ..operators.ordering import time_split
from ..runtime import materialize, run_together


def explain_channel(
    aligned: DataFrame,
    target: str,
    channels: Sequence[str],
    weather: Sequence[str],
    time: str,
    id_cols: Sequence[str],
    k: int = 5,
    boosted: Mapping | None = None,
    excluded: Mapping[str, Sequence[str]] | None = None,
) -> tuple[m.Fitted, DataFrame, dict]:
    """Fit the error model of one channel: the fitted model, its hold-out predictions and the summary row."""
    df = derived_features(aligned, target, weather[0], log_of=channels[0])
    feats = explain_features(df.columns, target, channels, weather, channels[0])
    df = df.where("matched").withColumn("error", q(f"mc_{target}_mean") - q(target)).where("error is not null")
    df = exclude_days(df, time, excluded or {}, F.lit(target))
    split = time_split(df, [time, *id_cols], folds=k)
    train = split.where("part <> 'test'")
    splines = tuple(c for c in (channels[0], f"mc_{weather[0]}_mean", "t_days") if c in feats)
    ridge = m.RidgeSpline(splines, tuple(c for c in feats if c not in splines))
    best, scores = m.model_select([ridge, m.Boosted(tuple(feats), **(boosted or {}))], train, "error", k)
    fitted = best.fit(train, "error")
    test = split.where("part = 'test'")
    predicted = materialize(m.holdout_predictions(fitted, test, [*id_cols, time], "error"), "holdout")
    e, p = q("error"), q("prediction")
    row = predicted.agg(
        stats.rmse(e, p).alias("test_rmse"), stats.mae(e, p).alias("test_mae"), F.count("*").alias("n_test")
    ).first()
    summary = {"target": target, "best_model": best.name, "n_train": train.count(), **row.asDict()}
    for name, s in scores.items():
        summary |= {f"{name}_{c}": s[c] for c in ("cv_rmse", "cv_mae", "cv_r2")}
    return fitted, predicted, summary


def explain_all_channels(aligned: DataFrame, channels: Sequence[str], weather: Sequence[str], time: str, id_cols: Sequence[str] = (), **kw) -> DataFrame:
    """Summary table with one row per channel. The aligned table is written once; only channels are looped over."""
    aligned = materialize(aligned, "aligned")
    jobs = [partial(explain_channel, aligned, t, channels, weather, time, id_cols, **kw) for t in channels]
    rows = [summary for _, _, summary in run_together(aligned.sparkSession, jobs)]
    types = {str: "string", int: "long", float: "double"}
    schema = ", ".join(f"{c} {types[type(v)]}" for c, v in rows[0].items())
    return aligned.sparkSession.createDataFrame(rows, schema)


def importance_table(
    aligned: DataFrame, channels: Sequence[str], weather: Sequence[str], time: str, id_cols: Sequence[str] = (), repeats: int = 20, **kw
) -> DataFrame:
    """``target, feature, importance_mean, importance_std`` of every channel's error model on its hold-out rows."""
    aligned = materialize(aligned, "aligned")

    def one(target: str) -> DataFrame:
        fitted, predicted, _ = explain_channel(aligned, target, channels, weather, time, id_cols, **kw)
        return m.permutation_importance(fitted, predicted.drop("prediction", "residual"), "error", [time, *id_cols], repeats).withColumn("target", F.lit(target))

    return reduce(DataFrame.unionByName, run_together(aligned.sparkSession, [partial(one, t) for t in channels]))
