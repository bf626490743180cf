"""Files in and out. Folders are the caller's; nothing is deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schema import strip_headers


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header row. Without a schema all columns are text, and headers lose a byte-order mark and blanks."""
    reader = spark.read.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    return reader.schema(schema).csv(path) if schema is not None else strip_headers(reader.csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Report rows (nested structs and arrays) as JSON lines."""
    df.write.json(path)


def read_keyed_csv(spark: SparkSession, root: str, glob: str, pattern: str, schema: StructType | str, key: str) -> DataFrame:
    """All matching files under ``root``, with ``key`` taken from the file name by ``pattern`` or else from its folder."""
    path = F.col("_metadata.file_path")
    from_name = F.regexp_extract(path, pattern, 1)
    folder = F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)
    return (
        spark.read.option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .schema(schema)
        .csv(root)
        .withColumn(key, F.when(from_name != "", from_name).otherwise(folder))
    )
