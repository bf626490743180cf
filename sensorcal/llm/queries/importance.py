from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import table
from ..importance import resample
from .base import query


def _features(name: str, table_name: str, key: str) -> str:
    """Distinct features per row with their number."""
    return rf"""{name}w AS (SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {table_name}),
{name}i AS (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM {name}w),
{name}f AS (SELECT k, f, count(*) AS n FROM (
  SELECT k, ws[i] AS f FROM {name}i
  UNION ALL SELECT k, ws[i] || ' ' || ws[i + 1] FROM {name}i WHERE i < len(ws)
  UNION ALL SELECT k, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM {name}i WHERE i + 1 < len(ws)) GROUP BY ALL)"""


#: CRC-32 bit by bit: DuckDB has no function for it.
SQL = rf"""
WITH {_features("d", "documents", "doc_id")},
{_features("b", "benchmark", "item_id")},
u AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
o AS (SELECT f, flatten(list_transform(regexp_extract_all(hex(encode(f)), '..'),
  lambda h: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: (('0x' || h)::BIGINT >> k) & 1))) AS bits FROM u),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, x: xor(c >> 1, 3988292384::BIGINT * (xor(c, x) & 1))), 4294967295::BIGINT) % 10000 AS bucket FROM o),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN c USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bf JOIN c USING (f) GROUP BY bucket),
g AS (SELECT r.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE)
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(bucket) LEFT JOIN s ON s.bucket = r.bucket LEFT JOIN t ON t.bucket = r.bucket),
w AS (SELECT k AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM df JOIN c USING (f) JOIN g USING (bucket) GROUP BY k),
a AS (SELECT dw.k AS doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || dw.k), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM dw LEFT JOIN w ON w.doc_id = dw.k),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, sum((n_words >= 20)::INT) OVER () AS able FROM a)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= floor(5 * able / 100) THEN place END AS rank FROM r"""


@query("op11_importance_resampling", SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "text")
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_features").alias("n_features"),
        F.col("_weight").alias("weight"),
        F.col("_score").alias("score"),
        F.col("_rank").alias("rank"),
    )
