"""Physical plans of single operators."""

import re

from compare import SF

from sensorcal.queries import QUERIES


def test_group_limit_before_the_shuffle(spark):
    plan = QUERIES["topk_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["metrics_pack"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_returnflag", "l_extendedprice", "l_discount", "l_quantity"}
