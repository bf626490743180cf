"""Fitted models with what is needed to apply them later."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..operators.model import Fitted


def save_model(spark: SparkSession, model: Fitted, path: str, **flags: str | float | bool) -> None:
    """Pipeline under ``path/model``, features and flags as one row under ``path/meta``."""
    model.pipeline.write().save(f"{path}/model")
    meta = {"name": model.name, "features": list(model.features), "flags": {k: str(v) for k, v in flags.items()}}
    spark.createDataFrame([meta], "name string, features array<string>, flags map<string, string>").write.parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[Fitted, dict[str, str]]:
    meta = spark.read.parquet(f"{path}/meta").first()
    pipeline = PipelineModel.load(f"{path}/model")
    return Fitted(pipeline, tuple(meta["features"]), meta["name"]), dict(meta["flags"])
