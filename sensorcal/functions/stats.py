"""Aggregate expressions that give NULL, never an error or NaN, on degenerate groups (ANSI mode)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def no_nan(x: Column) -> Column:
    """NULL is the only missing value inside the library."""
    return F.when(~F.isnan(x), x)


def both(x: Column, y: Column) -> tuple[Column, Column]:
    """Blank each of the two columns on rows where the other is missing."""
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def pearson(x: Column, y: Column) -> Column:
    x, y = both(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(x) >= 2, F.try_divide(F.covar_pop(x, y), spread))


def concordance(x: Column, y: Column) -> Column:
    """Lin's concordance with sample moments."""
    x, y = both(x, y)
    gap = F.avg(x) - F.avg(y)
    return F.try_divide(2 * F.covar_samp(x, y), F.var_samp(x) + F.var_samp(y) + gap * gap)


def r_squared(y_true: Column, y_pred: Column) -> Column:
    y_true, y_pred = both(y_true, y_pred)
    sse = F.sum((y_true - y_pred) * (y_true - y_pred))
    return F.when(
        F.count(y_true) >= 2,
        1 - F.try_divide(sse, F.var_pop(y_true) * F.count(y_true)),
    )


def mae(y_true: Column, y_pred: Column) -> Column:
    return F.avg(F.abs(y_pred - y_true))


def rmse(y_true: Column, y_pred: Column) -> Column:
    return F.sqrt(F.avg((y_pred - y_true) * (y_pred - y_true)))


def bias(y_true: Column, y_pred: Column) -> Column:
    return F.avg(y_pred - y_true)


def _log_gamma_step(a: Column) -> Column:
    """ln Γ(a + ½) − ln Γ(a) for a > 0, from its series at a + 8."""
    s = a + 8
    series = F.log(s) / 2 - 1 / (8 * s) + 1 / (192 * F.pow(s, F.lit(3.0))) - 1 / (640 * F.pow(s, F.lit(5.0)))
    for i in range(8):
        series = series + F.log((a + i) / (a + (i + 0.5)))
    return series


def _beta_fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function, from the front with Lentz's method."""
    tiny = F.lit(1e-300)
    held = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d0 = 1 / held(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def half(state: Column, term: Column) -> Column:
        c, d = held(1 + term / state["c"]), 1 / held(1 + term * state["d"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        # One-element transforms name a state, so that it is computed once.
        first = F.transform(F.array(state), lambda s: half(s, even))
        return F.get(F.transform(first, lambda s: half(s, odd)), F.lit(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda m: m.cast("double")), start, step)["h"]


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson r over n pairs (t-test): the regularized incomplete beta function at 1 − r².

    NULL below three pairs; 0 for an exact line. The number of steps grows with the root of n.
    """
    a, half = (n - 2) / 2.0, F.lit(0.5)
    rr, x = r * r, 1 - r * r
    front = F.exp(a * F.log1p(-rr) + F.log(F.abs(r)) + _log_gamma_step(a) - F.log(F.lit(math.pi)) / 2)
    steps = F.least(F.lit(5_000_000), F.ceil(100 + 5 * F.sqrt(a))).cast("int")
    direct = front * _beta_fraction(a, half, x, steps) / a
    other = 1 - front * _beta_fraction(half, a, rr, steps) / half
    inside = F.when(r == 0, 1.0).when(x < (a + 1) / (a + 2.5), direct).otherwise(other)
    return F.when((n < 3) | r.isNull(), None).when(F.abs(r) >= 1, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside)))
