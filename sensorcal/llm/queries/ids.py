from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import table
from ..ids import ids_round_trip
from .base import query


@query("op5_token_ids")
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = ids_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
