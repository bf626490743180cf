"""Time expressions on TIMESTAMP_NTZ columns; none depends on the session time zone."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
MINUTE_US = 60_000_000

# The zero point of the microsecond axis.
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_us(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def from_epoch_us(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH))


def floor_to(ts: Column, step_us: int) -> Column:
    """Start of the grid cell of width ``step_us`` that holds ``ts``."""
    return F.timestamp_add("MICROSECOND", -F.pmod(epoch_us(ts), F.lit(step_us)), ts)


def hour_floor(ts: Column) -> Column:
    return floor_to(ts, HOUR_US)


def hour_ceil(ts: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.pmod(-epoch_us(ts), F.lit(HOUR_US)), ts)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(MINUTE_US))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine position of ``value`` on a cycle of length ``period``."""
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
