"""Calibration: corrections, gate, fallback, delivery, summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import calibrate as cal
from ..plans.calibration import calibrate_channels, importance_table, summarize
from ..runtime import materialize
from .alignment import pack_sql
from .base import big, query, r6, with_views
from .modelling import aligned_for_models
from .series import ID, SPLIT, split_pairs

KEYS = ["grp"]
FIT = SPLIT | {
    "fit": "SELECT grp, count(*) AS n_fit, regr_slope(y_true, y_raw) AS a, regr_intercept(y_true, y_raw) AS b FROM split "
    "WHERE part <> 'test' GROUP BY grp",
}
GATE = SPLIT | {
    "cfit": "SELECT grp, count(*) AS n_cal, regr_slope(y_true, y_raw) AS a, regr_intercept(y_true, y_raw) AS b FROM split "
    "WHERE part = 'cal' GROUP BY grp",
    "judged": "SELECT grp, n_cal, a, b, count(*) FILTER (part <> 'test') AS n_train, "
    "sqrt(avg((y_true - y_raw) * (y_true - y_raw)) FILTER (part = 'cal')) AS before, "
    "sqrt(avg((y_true - a * y_raw - b) * (y_true - a * y_raw - b)) FILTER (part = 'cal')) AS after "
    "FROM split JOIN cfit USING (grp) GROUP BY grp, n_cal, a, b",
    "used": "SELECT *, n_cal >= 50 AND n_train >= 200 AND before > 1e-9 AND (before - after) / before >= 0.005 AS u FROM judged",
    "gate": "SELECT grp, CASE WHEN u THEN a ELSE 1 END AS a, CASE WHEN u THEN b ELSE 0 END AS b, u AS posthoc_used, "
    "CASE WHEN u THEN before - after ELSE 0 END AS gain, n_train FROM used",
    "fixed": "SELECT split.*, greatest(a * y_raw + b, 0) AS fixed FROM split JOIN gate USING (grp)",
    "flags": "SELECT grp, coalesce(sqrt(avg((fixed - y_true) * (fixed - y_true)) FILTER (part = 'test')) > "
    "sqrt(avg((y_raw - y_true) * (y_raw - y_true)) FILTER (part = 'test')), false) AS used_fallback FROM fixed GROUP BY grp",
    "delivered": "SELECT fixed.*, used_fallback, CASE WHEN used_fallback THEN y_raw ELSE fixed END AS calibrated FROM fixed JOIN flags USING (grp)",
}


def _split(spark, sf_dir):
    return split_pairs(spark, sf_dir)


def _delivered(spark, sf_dir):
    return _gated(spark, sf_dir)[1]


def _gated(spark, sf_dir):
    df = _split(spark, sf_dir)
    gate = materialize(cal.gated_posthoc(df, "y_true", "y_raw", KEYS), "gate")
    fixed = cal.apply_posthoc(df, gate, "y_raw", "calibrated", KEYS, clip=True)
    return gate, cal.with_fallback(fixed, "y_true", "y_raw", "calibrated", KEYS, F.col("part") == "test")


@query(
    "posthoc_linear",
    with_views(["pairs"], FIT, f"SELECT grp, {big('n_fit', 'n_fit')}, {r6('a', 'a')}, {r6('b', 'b')}, n_fit >= 20 AS fitted FROM fit"),
)
def posthoc_linear(spark, sf_dir):
    return cal.fit_posthoc(_split(spark, sf_dir), "y_true", "y_raw", KEYS, 20, F.col("part") != "test")


@query(
    "posthoc_gated",
    with_views(["pairs"], GATE, f"SELECT grp, {r6('a', 'a')}, {r6('b', 'b')}, posthoc_used, {r6('gain', 'gain')}, {big('n_train', 'n_train')} FROM gate"),
)
def posthoc_gated(spark, sf_dir):
    return cal.gated_posthoc(_split(spark, sf_dir), "y_true", "y_raw", KEYS)


@query(
    "calibrate_fallback",
    with_views(["pairs"], GATE, "SELECT grp, used_fallback FROM flags"),
)
def calibrate_fallback(spark, sf_dir):
    return _delivered(spark, sf_dir).select("grp", "used_fallback").distinct()


@query(
    "calibrate_apply",
    with_views(
        ["pairs"],
        GATE,
        f"SELECT {ID}, part, {r6('y_true', 'truth')}, {r6('calibrated', 'calibrated')} FROM delivered",
    ),
)
def calibrate_apply(spark, sf_dir):
    return _delivered(spark, sf_dir).select(
        *fx.PAIR_ORDER[1:], "part", F.col("y_true").alias("truth"), "calibrated"
    )


@query(
    "calibration_summary",
    with_views(
        ["pairs"],
        GATE,
        f"SELECT grp, part, {big('count(*)', 'n')}, {pack_sql('y_true', 'y_raw', 'base_')}, {pack_sql('y_true', 'calibrated', 'cal_')}, "
        + r6(
            "sqrt(avg((y_raw - y_true) * (y_raw - y_true))) - sqrt(avg((calibrated - y_true) * (calibrated - y_true)))",
            "improve_rmse",
        )
        + ", "
        + r6("avg(abs(y_raw - y_true)) - avg(abs(calibrated - y_true))", "improve_mae")
        + f", {big('any_value(g.n_train)', 'n_train')}, {big('any_value(n_test)', 'n_test')}, any_value(d.used_fallback) AS used_fallback, "
        + "any_value(g.posthoc_used) AS posthoc_used, "
        + f"{r6('any_value(g.a)', 'posthoc_a')}, {r6('any_value(g.b)', 'posthoc_b')}, {r6('any_value(g.gain)', 'posthoc_gain')}, 'direct' AS cal_method, {r6('5.0::DOUBLE', 'tol_minutes')} "
        + "FROM delivered d JOIN gate g USING (grp) JOIN (SELECT grp, count(*) FILTER (part = 'test') AS n_test FROM split GROUP BY grp) USING (grp) GROUP BY grp, part",
    ),
)
def calibration_summary(spark, sf_dir):
    gate, out = _gated(spark, sf_dir)
    return cal.performance_table(materialize(out, "delivered"), gate, "y_true", "y_raw", "calibrated", KEYS, tol_minutes=5)


@query("calibrate_importance")
def calibrate_importance(spark, sf_dir):
    """Importance of the delivered models' features, on the level also where the difference is modelled."""
    return importance_table(
        aligned_for_models(spark, sf_dir), fx.EVENT_TYPES, ["hum"], "hour", residual=["view"], k=2, forest={"trees": 3, "depth": 5}
    )


@query("calibrate_channels")
def calibrate_all(spark, sf_dir):
    series = calibrate_channels(
        aligned_for_models(spark, sf_dir),
        fx.EVENT_TYPES,
        ["hum"],
        "hour",
        residual=["view"],
        k=2,
        forest={"trees": 3, "depth": 5},
    )
    return summarize(materialize(series, "calibrated"), tol_minutes=30)
