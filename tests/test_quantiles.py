import math
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sensorcal.operators import lookup, quantiles as Q

PROBS = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]


@pytest.fixture(params=["sorted buckets", "all passes", "all passes, large parameter tables"])
def way(request, monkeypatch):
    """Buckets are sorted at once, or narrowed down to single values."""
    if request.param != "sorted buckets":
        monkeypatch.setattr(Q, "BUCKET", 0)
    if "large" in request.param:
        monkeypatch.setattr(lookup, "SMALL_ROWS", 0)


def frame(spark, values, keys=None):
    keys = keys if keys is not None else ["a"] * len(values)
    rows = [(k, None if v is None else float(v)) for k, v in zip(keys, values, strict=True)]
    return spark.createDataFrame(rows, "k string, v double")


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308]
EDGES += [math.inf, -math.inf, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), *[2.0**k for k in (-1022, -1, 1, 10, 52, 53, 1023)]]
EDGES += [math.nextafter(2.0**k, 0) for k in (-1000, -3, 3, 29, 97, 1023)]


def test_order_key_is_the_doubles_bits(spark):
    rng = np.random.default_rng(2)
    values = [*EDGES, *rng.normal(size=500), *np.frombuffer(rng.bytes(8000), "<f8")]
    values = [float(v) for v in values if not math.isnan(v)]
    for v, k in Q.with_order_key(frame(spark, values), "v", "key").select("v", "key").collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert k == (-bits - 1 if v < 0 else bits), v
    assert Q.with_order_key(frame(spark, [math.nan]), "v", "key").first().key == 2**63 - 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_equals_numpy(spark, way, values):
    got = Q.exact_quantiles(frame(spark, values), ["v"], PROBS).first()[0]
    present = [v for v in values if v is not None]
    if present:
        np.testing.assert_allclose(got, np.quantile(np.array(present, float), PROBS), rtol=1e-12, atol=1e-9)
    else:
        assert got is None or all(v is None for v in got)


def test_skewed_groups_and_heavy_ties(spark, way):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(30_000) < 0.8, "hot", "cold"), "v": rng.normal(size=30_000)})
    pdf.loc[rng.random(30_000) < 0.4, "v"] = 0.25
    got = Q.exact_quantiles(spark.createDataFrame(pdf), ["v"], PROBS, ["k"]).toPandas().set_index("k")["v"]
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got[k], np.quantile(g["v"], PROBS), rtol=1e-12)


def test_same_bits_as_the_builtin(spark, way):
    """Several columns, a NULL key, groups without values, values in one narrow range."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"),
        (1000 + F.sin("id")).alias("x"),
        F.when((F.col("id") % 3 > 0) & (F.col("id") % 7 != 4), F.cos("id")).alias("y z"),
    )
    want = df.groupBy("k").agg(*[F.percentile(F.col(f"`{c}`"), F.array(F.lit(0.1), F.lit(0.25), F.lit(0.77))).alias(c) for c in ("x", "y z")])
    got = Q.exact_quantiles(df, ["x", "y z"], [0.1, 0.25, 0.77], ["k"])
    plain = lambda rows: sorted((r[0] or 0, tuple(r[1]), tuple(r[2] or [None] * 3)) for r in rows)
    assert plain(got.collect()) == plain(want.collect())


def test_infinite_and_undefined_values(spark, way):
    got = Q.exact_quantiles(frame(spark, [math.inf, -math.inf, 1, 2, math.nan]), ["v"], [0.0, 0.25, 0.5, 0.75, 1.0]).first()[0]
    assert got[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4])


def test_empty_table(spark, way):
    none = frame(spark, [])
    assert Q.exact_quantiles(none, ["v"], [0.5], ["k"]).count() == 0
    assert Q.exact_quantiles(none, ["v"], [0.5]).first()[0] in (None, [None])
    assert Q.exact_medians(none, ["v"]).first()[0] is None


def test_a_bucket_larger_than_the_limit_is_narrowed(spark, monkeypatch):
    """No list is longer than the limit, whatever the passes that takes."""
    monkeypatch.setattr(Q, "BUCKET", 40)
    df = spark.range(20_000).select((5 + F.col("id") / 2.0**40).alias("v"))
    got = Q.exact_quantiles(df, ["v"], [0.3, 0.5]).first()[0]
    np.testing.assert_allclose(got, [5 + 0.3 * 19_999 / 2.0**40, 5 + 0.5 * 19_999 / 2.0**40], rtol=1e-15)


def test_scratch_tables_are_removed(spark, way, monkeypatch):
    left, remove = [], Q.release
    write = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name="stage": left.append(out := write(df, name)) or out)
    monkeypatch.setattr(Q, "release", lambda *t: [left.remove(x) for x in t] and remove(*t))
    out = Q.exact_quantiles(frame(spark, range(300)), ["v"], [0.5])
    assert len(left) == 1 and out.first()[0] == [149.5]


def test_probs_must_ascend(spark):
    with pytest.raises(ValueError):
        Q.exact_quantiles(frame(spark, [1]), ["v"], [0.5, 0.1])
