"""Column contracts and parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

# Channel names, valid ranges, unit rules and defaults of the sensor network.
POLLUTANTS = ("PM2.5", "PM10", "CO", "NO2", "SO2", "O3")
WEATHER = ("WindSpeed", "Pressure", "Precipitation", "Temperature", "Humidity")
VALID_RANGES = {
    "PM2.5": (0.0, None),
    "PM10": (0.0, None),
    "CO": (0.0, None),
    "NO2": (0.0, None),
    "SO2": (0.0, None),
    "O3": (0.0, None),
    "WindSpeed": (0.0, None),
    "Pressure": (8.0e4, 1.1e5),
    "Precipitation": (0.0, None),
    "Humidity": (0.0, 100.0),
    "Temperature": (-60.0, 60.0),
}
PRESSURE_TO_PA = ((800.0, 1200.0, 100.0), (80.0, 120.0, 1000.0))
TIME_NAMES = ("Time", "time", "datetime", "dt", "DateTime", "Timestamp")
EXCLUDED_DAYS = {"SO2": ("2019-01-23",), "PM10": ("2019-02-19",)}


@dataclass(frozen=True)
class SensorSchema:
    """Which columns of a readings table mean what."""

    time: str
    channels: tuple[str, ...]
    covariates: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()

    @property
    def measures(self) -> tuple[str, ...]:
        return (*self.channels, *self.covariates)


@dataclass(frozen=True)
class ScoreParams:
    """Defaults of network-consistency scoring."""

    k_neighbors: int = 6
    k_meteo: int = 4
    alpha: float = 0.45
    beta: float = 0.20
    gamma: float = 0.35
    jump_z: float = 3.5
    ri_quantile: float | None = 0.15
    ri_fixed: float = 0.50
    window_z: float = 3.0
    window_min_len: int = 3
    eps: float = 1e-6


@dataclass(frozen=True)
class PosthocParams:
    """Defaults of the gated linear correction after calibration."""

    min_points: int = 50
    min_train: int = 200
    min_gain: float = 0.005
    strict_gain: float = 0.01
    strict_targets: tuple[str, ...] = field(default=("SO2", "O3"))

    def gate(self, target: str) -> float:
        return self.strict_gain if target in self.strict_targets else self.min_gain


def strip_headers(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks or a byte-order mark."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def column_contract(df: DataFrame, required: Sequence[str], optional: Mapping[str, str] | None = None) -> DataFrame:
    """Raise when a required column is missing; add missing optional columns as NULL of the given type."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    absent = {c: F.lit(None).cast(t) for c, t in (optional or {}).items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def resolve_time(df: DataFrame, candidates: Sequence[str] = TIME_NAMES, name: str = "dt") -> DataFrame:
    """Rename the first candidate present to ``name``."""
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, name)
    raise ValueError(f"no time column among {list(candidates)}")
