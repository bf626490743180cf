"""Trends over quantile bins and median splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .clean import drop_any_null, q
from .lookup import beside
from .quantiles import exact_medians, exact_quantiles, one_row


def with_edges(df: DataFrame, x: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``_edges``, the distinct quantile edges of x (bins + 1 numbers at most), of all rows or per key."""
    edges = exact_quantiles(df, [x], [i / bins for i in range(bins + 1)], keys)
    if keys:
        return beside(df, edges.select(*map(q, keys), F.array_distinct(q(x)).alias("_edges")), keys)
    return df.withColumn("_edges", F.array_distinct(one_row(edges.toDF("e"))["e"]))


def bin_of(x: Column, edges: Column, bins: int) -> Column:
    """Right-closed bin index from 0 among at most ``bins`` + 1 edges; the smallest value belongs to the first bin."""
    below = sum((F.when(F.get(edges, i) < x, 1).otherwise(0) for i in range(bins + 1)), F.lit(0))
    return F.greatest(below - 1, F.lit(0)).cast("int")


def _means(binned: DataFrame, group: Sequence[str]) -> DataFrame:
    return binned.groupBy(*map(q, group), "bin").agg(F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"), F.count("*").alias("n"))


def quantile_bin_trend(df: DataFrame, x: str, y: str, bins: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of x and y in quantile bins of x (repeated edges merged), of all rows or per key."""
    df = drop_any_null(df, [x, y]).select(*map(q, keys), q(x).alias("x"), q(y).alias("y"))
    return _means(with_edges(df, "x", bins, keys).withColumn("bin", bin_of(F.col("x"), F.col("_edges"), bins)), keys)


def with_halves(df: DataFrame, halves: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds a column per entry: is its value at or above its median (``high``), of all rows or per key, or below (``low``)?"""
    cols = list(halves.values())
    if keys:
        medians = exact_medians(df, cols, keys).select(*map(q, keys), *[q(c).alias(f"_m{i}") for i, c in enumerate(cols)])
        near, at = beside(df, medians, keys), [F.col(f"_m{i}") for i in range(len(cols))]
    else:
        row = one_row(exact_medians(df, cols))
        near, at = df, [row[c] for c in cols]
    marked = near.withColumns({n: F.when(q(c) >= m, "high").otherwise("low") for (n, c), m in zip(halves.items(), at)})
    return marked.drop(*[f"_m{i}" for i in range(len(cols))])


def interaction_trend(df: DataFrame, x: str, y: str, split: str, bins: int = 15, keys: Sequence[str] = ()) -> DataFrame:
    """As :func:`quantile_bin_trend` with one line per half of ``split``."""
    df = drop_any_null(df, [x, y, split]).select(*map(q, keys), q(x).alias("x"), q(y).alias("y"), q(split).alias("s"))
    halved = with_edges(with_halves(df, {"half": "s"}, keys), "x", bins, keys)
    return _means(halved.withColumn("bin", bin_of(F.col("x"), F.col("_edges"), bins)), [*keys, "half"])


def median_split_2x2(df: DataFrame, a: str, b: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median and sample deviation of y in the four quadrants of two median splits, of all rows or per key."""
    df = drop_any_null(df, [a, b, y]).select(*map(q, keys), q(a).alias("a"), q(b).alias("b"), q(y).alias("y"))
    parts = with_halves(df, {"a_half": "a", "b_half": "b"}, keys).drop("a", "b")
    group = [*keys, "a_half", "b_half"]
    basic = parts.groupBy(*map(q, group)).agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std")
    )
    return beside(basic, exact_medians(parts, ["y"], group).withColumnRenamed("y", "median"), group)


def seeded_sample(df: DataFrame, id_cols: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same rows for the same seed: the smallest digests of seed and ids."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[q(c).cast("string") for c in id_cols]))
    return df.orderBy(digest, *map(q, id_cols)).limit(n)
