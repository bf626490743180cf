"""From raw readings to agreement with the reference station."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..operators.align import align_nearest_hour
from ..operators.clean import clean_readings
from ..operators.metrics import agreement_metrics, corr_metrics, matched_pairs
from ..schema import SensorSchema


def compare_sensor(
    station: DataFrame,
    raw: DataFrame,
    schema: SensorSchema,
    value: str,
    ranges: Mapping,
    unit_rules: Mapping | None = None,
    tol_minutes: float = 5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean raw sensor text, align it with the hourly station, measure: ``(aligned, agreement, correlation)``."""
    clean = clean_readings(raw, schema, ranges, unit_rules)
    aligned = align_nearest_hour(station, clean.select(schema.time, value), schema.time, value, tol_minutes)
    return aligned, agreement_metrics(aligned), corr_metrics(matched_pairs(aligned))
