from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..jaccard import jaccard_components
from .base import query

#: Shingles, their pairs with enough in common, and the smallest id that links reach.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (
        SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
        UNION ALL SELECT doc_id, len(ws) || ':' || array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root)::BIGINT AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x"""


@query("op9_jaccard_join", SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
