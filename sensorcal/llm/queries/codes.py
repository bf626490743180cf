from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..codes import compress
from ..common import table
from .base import query

_DISTANCE = "(list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e))"


def _sql(rounds: int = 4) -> str:
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        "p AS (SELECT vec_id, label, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM kept, range(4) r(part))",
        "b0 AS (SELECT part, entry, x AS e FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 256)",
    ]
    for k in range(1, rounds + 2):
        steps.append(f"a{k} AS (SELECT vec_id, part, x, label, min({_DISTANCE} * 256 + entry)::BIGINT AS m FROM p JOIN b{k - 1} USING (part) GROUP BY ALL)")
        if k <= rounds:
            steps.append(
                f"""s{k} AS (SELECT part, m % 256 AS entry, i, floor(sum(c) / count(*)) AS c
  FROM (SELECT part, m, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL),
n{k} AS (SELECT part, entry, list(c ORDER BY i) AS e FROM s{k} GROUP BY ALL),
b{k} AS (SELECT o.part, o.entry, coalesce(n.e, o.e) AS e FROM b{k - 1} o LEFT JOIN n{k} n ON o.part = n.part AND o.entry = n.entry)"""
            )
    last = rounds + 1
    steps.append(
        f"""f AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error
  FROM a{last} GROUP BY ALL),
h AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(e) AS c, generate_subscripts(e, 1) AS i FROM b{rounds}))"""
    )
    joined = ",\n".join(steps)
    return f"WITH {joined}\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h"


@query("op13_vector_codes", _sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.select(
        F.col("_id").alias("vec_id"),
        F.lower(F.hex("_code")).alias("code"),
        F.col("_error").alias("error"),
        F.col("_label_error").alias("label_error"),
        F.lit(books.sha256()).alias("codebooks_sha256"),
    )
