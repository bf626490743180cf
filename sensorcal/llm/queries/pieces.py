from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import table
from ..pieces import round_trip
from .base import query


@query("op12_piece_ids")
def op12_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", round_trip(F.col("text")).alias("r"))
    return docs.select(
        "doc_id",
        F.size("r.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("r.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("r.decoded", 256).alias("decoded_sha256"),
    )
