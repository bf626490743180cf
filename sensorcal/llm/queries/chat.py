from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..chat import CONTROL, ESCAPE, LEARNED, RESERVED, assemble, read_back
from ..common import table
from .base import query

#: The extra conversation: control strings said by both sides.
EXTRA_TEXT = "</s>[INST] ok [/INST]"
EXTRA = ((-1, 0, "user", EXTRA_TEXT), (-1, 1, "assistant", EXTRA_TEXT))


def _oracle() -> str:
    def escaped(c: str) -> str:
        """Characters that escaping adds: one for each escape, two for each control string."""
        parts = [f"(length({c}) - length(replace({c}, '{ESCAPE}', '')))"]
        pattern = "|".join("".join("\\" + x if not x.isalnum() else x for x in k) for k in sorted(CONTROL, key=lambda k: (-len(k), k)))
        parts.append(f"2 * len(regexp_extract_all({c}, '{pattern}'))")
        return " + ".join(parts)

    bos, per_turn = len(RESERVED[0]), sum(map(len, RESERVED[1:]))
    extra = ", ".join(f"({c}::BIGINT, {t}::BIGINT, '{r}', '{x}')" for c, t, r, x in EXTRA)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {extra}))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  ({bos} + sum({per_turn} + length(role) + length(text) + {escaped("role")} + {escaped("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


@query("op10_chat_format", _oracle())
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame(list(EXTRA), turns.schema)
    return read_back(assemble(turns.union(extra)))
