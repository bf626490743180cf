from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import table
from ..lines import line_dedup, without_lines
from .base import query


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    left = line_dedup(docs).withColumn("left", without_lines(text, F.col("_removed")))
    return left.select(
        "doc_id",
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.length("left").cast("long").alias("n_chars"),
        F.sha2("left", 256).alias("text_sha256"),
    )
