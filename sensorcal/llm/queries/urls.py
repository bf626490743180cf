from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..urls import DAMPING, DISTRUST_RATIO, ROUNDS, RULES, SAME, url_verdicts
from .base import query

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_AFTER = "CASE WHEN contains(coalesce({0}, ''), '://') THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"


def _oracle() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda k: " ".join(f"WHEN {fits(h, p)} THEN '{h + p if k == 0 else v}'" for h, p, v in longest)
    rounds = ["r0 AS (SELECT * FROM seeds)"]
    for k in range(ROUNDS):
        rounds.append(
            f"r{k + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT r.kind, coalesce(dst, host) AS host, score * {DAMPING}::DOUBLE * coalesce(share, 1) AS score"
            f" FROM r{k} r LEFT JOIN ways w ON r.kind = w.kind AND r.host = w.src UNION ALL SELECT kind, host, score * (1 - {DAMPING}::DOUBLE) FROM seeds) GROUP BY ALL)"
        )
    return f"""
WITH a AS (SELECT page_id, html, {_AFTER.format("url")} AS rest FROM pages),
h AS (SELECT page_id, html, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
j AS (SELECT page_id, html, host, path, CASE {case(0)} END AS rule, CASE {case(1)} END AS by_rule FROM h),
c AS (SELECT CASE by_rule WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM j WHERE by_rule IS NOT NULL AND host <> '' GROUP BY ALL),
seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind)::DOUBLE AS score FROM c),
u AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\b(?:href|src|action)\\s*=\\s*["'']?\\s*((?:https?:)?//[^\\s"''<>]+)', 1)) AS u FROM j),
k AS (SELECT src, {_LOWER.format("regexp_extract(" + _AFTER.format("v") + ", '^[^/?#]*')")} AS dst FROM (SELECT src, CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END AS v FROM u)),
linked AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM k WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
known AS (SELECT host FROM j WHERE host <> '' UNION SELECT dst FROM linked),
up AS (SELECT host AS src, regexp_extract(host, '^[^.]*\\.(.*)$', 1) AS dst, 1.0::DOUBLE AS weight FROM known WHERE len(string_split(host, '.')) > 2),
e AS (SELECT * FROM linked UNION ALL SELECT * FROM up UNION ALL SELECT dst, src, weight FROM up),
w AS (SELECT 'trust' AS kind, src, dst, weight FROM e UNION ALL SELECT 'distrust', dst, src, weight FROM e),
ways AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM w),
{", ".join(rounds)},
s AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {DISTRUST_RATIO * (1 + SAME)}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s ON j.host = s.host"""


@query("op4_url_filters", _oracle())
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("trust", "distrust")
