"""From raw documents to packed training sequences: quality rules, line dedup, near duplicates, mixing, packing.

Every stage but the last takes and returns the columns of ``documents``. Between stages the rows are written as
Parquet and read again, so that a lost executor costs one stage's task and each stage sees rows that stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorcal.llm.common import WORD, aside, table
from sensorcal.llm.jaccard import one_of_each
from sensorcal.llm.lines import line_dedup, without_lines
from sensorcal.llm.mixing import letter_quality, mix, sampling_key
from sensorcal.llm.packing import pack
from sensorcal.llm.quality import quality_filter
from sensorcal.runtime import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; so does a document of which no word is left."""
    gone = F.col("_removed")
    free, back = aside(docs, ["_removed"])
    out = line_dedup(free).withColumn("text", without_lines(F.col("text"), gone))
    out = out.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.filter(gone.isNull() | F.col("text").rlike(WORD)).select(*free.columns).withColumnsRenamed(back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it."""
    text = F.coalesce("text", F.lit(""))
    key = sampling_key(F.col("doc_id"), text, letter_quality(text))
    free, back = aside(docs, ["_size", "_source_size", "_target", "_copies", "_copy"])
    mixed = mix(free, F.regexp_count(text, F.lit(WORD)), F.col("source"), key).filter("_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*free.columns).withColumnsRenamed(back)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the alignment nor the tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "documents")
    return STAGES[-1][1](spark, docs, sf_dir)
