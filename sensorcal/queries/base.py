"""Registry of named queries with their SQL counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..fixtures import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``key``, with the SQL that must give the same rows."""

    def register(fn):
        QUERIES[key] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, whole numbers as BIGINT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def r6(expr: str, name: str) -> str:
    """SQL: a double rounded to six decimals, NaN as NULL, no negative zero."""
    return f"CASE WHEN isnan({expr}) THEN NULL ELSE round({expr}, 6) + 0.0::DOUBLE END AS {name}"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def with_views(views: list[str], steps: Mapping[str, str], final: str, once: bool = False) -> str:
    """``WITH`` query over the named fixture views and further named steps, each computed ``once`` if wanted."""
    how = "AS MATERIALIZED" if once else "AS"
    ctes = [f"{v} AS ({SQL[v]})" for v in views] + [f"{n} {how} ({s})" for n, s in steps.items()]
    recursive = any(re.search(rf"\b{n}\b", s) for n, s in steps.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {final}"
