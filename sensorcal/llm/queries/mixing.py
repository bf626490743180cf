from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import WORD, table
from ..mixing import SEED, letter_quality, mix, sampling_key
from .base import query

SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5(concat_ws('|', '{SEED}', doc_id, t)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
        / CASE WHEN length(t) > 0 THEN greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) / length(t)) ELSE 1.0 END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS most, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM r),
v AS (SELECT *, (SELECT level FROM l x WHERE x.level < x.most / x.weight ORDER BY x.most / x.weight, x.source NULLS LAST LIMIT 1) AS top FROM l),
t AS (SELECT source, source_size, CASE WHEN top IS NULL OR most <= top * weight THEN most::DOUBLE ELSE top * weight END AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * (epochs + (rest > 0 AND before + size / 2.0 <= rest)::INT)::BIGINT AS taken FROM c"""


@query("op3_source_mixing", SQL)
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    out = mix(docs, F.regexp_count(text, F.lit(WORD)), F.col("source"), sampling_key(F.col("doc_id"), text, letter_quality(text)))
    return out.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.round("_target", 6).alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )
