"""Ranking of feature importance tables ``(target, feature, importance_mean, importance_std)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def topk_features(imp: DataFrame, k: int = 12, positive_only: bool = True) -> DataFrame:
    """The k most important features of each target with their rank.

    The rank limit is applied inside every map task before the shuffle (a group limit), so a target with
    very many features does not end up in one task.
    """
    if positive_only:
        imp = imp.where(F.col("importance_mean") > 0)
    order = Window.partitionBy("target").orderBy(F.col("importance_mean").desc_nulls_last(), "feature")
    return imp.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk_wide(top: DataFrame, k: int = 12) -> DataFrame:
    """One row per target with columns ``top<r>_feature``, ``top<r>_importance_mean``, ``top<r>_importance_std``."""
    cells = [
        F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"top{r}_{c}")
        for r in range(1, k + 1)
        for c in ("feature", "importance_mean", "importance_std")
    ]
    return top.groupBy("target").agg(*cells)


def feature_frequency(top: DataFrame) -> DataFrame:
    """In how many targets' top lists a feature appears, with mean rank, mean importance and the sorted targets."""
    return (
        top.groupBy("feature")
        .agg(
            F.count("*").alias("count"),
            F.avg("rank").alias("avg_rank"),
            F.avg("importance_mean").alias("avg_importance"),
            F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"),
        )
        .orderBy(F.col("count").desc(), F.col("avg_importance").desc(), "feature")
    )


def head_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)
