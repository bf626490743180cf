from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..fingerprints import fingerprints
from .base import query


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
