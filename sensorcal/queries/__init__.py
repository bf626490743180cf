"""Named queries over the test tables."""

from . import alignment, calibration, modelling, network, ranking, readings, series, storage  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
