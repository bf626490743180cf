"""Queries of the operators over the test tables; where SQL can say the same, its text stands beside the query."""

from importlib import import_module

from .base import ORACLES, QUERIES

for _name in ("lines", "quality", "mixing", "urls", "ids", "packing", "fingerprints", "html", "jaccard", "chat", "codes", "pieces", "importance"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
