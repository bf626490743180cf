from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import table
from ..html import extract
from .base import query


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
