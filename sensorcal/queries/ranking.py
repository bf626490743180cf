"""Feature importance rankings."""

from __future__ import annotations

from .. import fixtures as fx
from ..operators import rank
from .base import big, query, r6, with_views

TOP = {
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY importance_mean DESC, feature) AS rank "
    "FROM importance WHERE importance_mean > 0) WHERE rank <= 12"
}


def top12(spark, sf_dir):
    return rank.topk_features(fx.importance(spark, sf_dir), 12)


@query(
    "topk_features",
    with_views(
        ["importance"],
        TOP,
        f"SELECT target, feature, {r6('importance_mean', 'importance_mean')}, {r6('importance_std', 'importance_std')}, {big('rank', 'rank')} FROM top",
    ),
)
def topk_features(spark, sf_dir):
    return top12(spark, sf_dir)


@query(
    "topk_wide",
    with_views(
        ["importance"],
        TOP,
        "SELECT target, "
        + ", ".join(
            f"max(CASE WHEN rank = {k} THEN feature END) AS top{k}_feature, "
            + r6(f"max(CASE WHEN rank = {k} THEN importance_mean END)", f"top{k}_importance_mean")
            + ", "
            + r6(f"max(CASE WHEN rank = {k} THEN importance_std END)", f"top{k}_importance_std")
            for k in range(1, 13)
        )
        + " FROM top GROUP BY target",
    ),
)
def topk_wide(spark, sf_dir):
    return rank.topk_wide(top12(spark, sf_dir), 12)


FREQ = (
    f"SELECT feature, {big('count(*)', 'count')}, {r6('avg(rank)', 'avg_rank')}, {r6('avg(importance_mean)', 'avg_importance')}, "
    "string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM top GROUP BY feature"
)


@query("feature_frequency", with_views(["importance"], TOP, FREQ))
def feature_frequency(spark, sf_dir):
    return rank.feature_frequency(top12(spark, sf_dir))


@query(
    "head_features",
    with_views(["importance"], TOP, FREQ + " ORDER BY count(*) DESC, avg(importance_mean) DESC, feature LIMIT 20"),
)
def head_features(spark, sf_dir):
    return rank.feature_frequency(top12(spark, sf_dir)).limit(20)
