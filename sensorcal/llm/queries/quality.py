from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..quality import LEAST_DOCS, MEASURES, SIGNALS, quality_verdicts
from .base import query

# The windows of eight words are counted with positions: a word is repeated if some window over it occurs twice.
_MEASURED = r"""
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 8) AS r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m0 AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
       FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m0)"""


def _oracle() -> str:
    values = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{s.name}' AS signal, {s.num} * 1000 // {s.den} AS v, {s.slack} AS slack, {s.spread} AS spread, {s.low} AS low FROM m WHERE NOT base_failed AND {s.den} > 0"
        for s in SIGNALS
    )
    shift = "greatest(length(bin(v)) - 6, 0)"
    level = lambda k, keys: (
        f"q{k} AS (SELECT {keys} signal, any_value(docs) AS docs, min(CASE WHEN upto * 4 >= docs THEN b END) AS q1, min(CASE WHEN upto * 4 >= docs * 3 THEN b END) AS q3"
        f" FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} signal ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys} signal) AS docs"
        f" FROM (SELECT {keys} signal, b, count(*) AS n FROM b GROUP BY ALL)) GROUP BY ALL)"
    )
    pick = lambda c: f"CASE WHEN q0.docs >= {LEAST_DOCS} THEN q0.{c} WHEN q1.docs >= {LEAST_DOCS} THEN q1.{c} ELSE q2.{c} END"
    return f"""
WITH {_MEASURED},
v AS ({values}),
b AS (SELECT *, ((v >> {shift}) << {shift}) AS b FROM v),
{level(0, "lang, source,")}, {level(1, "lang,")}, {level(2, "")},
lim AS (SELECT q0.lang, q0.source, q0.signal, {pick("q1")} AS q1, {pick("q3")} AS q3
        FROM q0 JOIN q1 ON q0.signal = q1.signal AND q0.lang IS NOT DISTINCT FROM q1.lang JOIN q2 ON q0.signal = q2.signal),
bad AS (SELECT DISTINCT doc_id FROM v JOIN lim ON v.signal = lim.signal AND v.lang IS NOT DISTINCT FROM lim.lang AND v.source IS NOT DISTINCT FROM lim.source
        WHERE v.v > q3 + greatest((q3 - q1) * spread, slack) OR (low AND v.v < q1 - greatest((q3 - q1) * spread, slack)))
SELECT doc_id, {", ".join(MEASURES)}, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM m LEFT JOIN bad USING (doc_id)"""


@query("op2_quality_rules", _oracle())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_verdicts(docs).select("doc_id", *MEASURES, "base_failed", "kept")
