from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..packing import pack
from .base import query


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
