"""Every query with a SQL counterpart gives the same rows from a plan that scales; the others give rows."""

import re

import pytest
from compare import SF, compare

from sensorcal.queries import ORACLES, QUERIES

ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES) - {"explain_all_channels", "calibrate_channels", "explain_importance", "calibrate_importance"})


def check_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan
    # A window without partitions is allowed over the table of partition sizes only.
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        if " ASC" in spec.split(",")[0]:
            assert spec.startswith("_pid"), spec


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, duck, key):
    df = QUERIES[key](spark, SF)
    check_plan(df)
    diff = compare(df, duck, ORACLES[key])
    # The smallest data may hold no run, no anomaly: an empty result on both sides is right there.
    assert diff in ("", "no rows"), diff


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_gives_rows(spark, key):
    assert QUERIES[key](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 1 and "coverage" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
