"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight; taking the smallest keys of a source is
weighted sampling without replacement. A source whose target is above its size is first taken whole, as many
times as fits; the fraction left is filled with the smallest keys up to the budget. What is handed on is one key limit
per source, so the texts themselves are neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.lookup import beside
from ..runtime import materialize
from .common import fresh, prefix_sums

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
#: Documents that are sorted together, about.
PART_ROWS = 4096
#: Steps a doubling in the sketch of a source's keys.
BINS = 64


def sampling_key(doc_id: Column, text: Column, quality: Column, seed: str = SEED) -> Column:
    """-ln(u) / quality with u in (0, 1) from the MD5 of seed, id and text: the same in every run and on every cluster."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"), text)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(u) / quality


def letter_quality(text: Column) -> Column:
    """1 for plain prose, less with each symbol: 1 - 4 x the share of ``#*$%&|<>``, at least 0.05."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * symbols / n)).otherwise(F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, ...) from (source, source_size): shares of the total by weight, none above ``cap`` times its size.

    Sources take the weights in turn, by code point, null last. What a full source can't take is shared anew among the
    others by weight. With sources in the order of cap / weight, the full ones are a prefix, so one pass finds them.
    A window holds one row per source of the mix.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(whole) * F.lit(share_percent / 100) - F.coalesce(F.sum("most").over(before), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", rest / left)
    over = F.when(F.col("level") < F.col("most") / F.col("weight"), F.col("level"))
    rows = rows.withColumn("level", F.first(over, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    full = F.col("level").isNull() | (F.col("most") <= F.col("level") * F.col("weight"))
    rows = rows.withColumn("target", F.when(full, F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rows = rows.withColumn("epochs", epochs)
    return rows.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))


def mix(docs: DataFrame, size: Column, source: Column, key: Column, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = MAX_EPOCHS) -> DataFrame:
    """All rows of ``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_copies`` (how often the mix takes the row).

    A document of the fractional part is taken if at least half of it lies within the source's budget. Repeated rows
    have equal keys and are taken alike. A null source is a source of its own; rows of size 0 take nothing from a
    budget and come as often as the whole source does. Columns of ``docs`` with the name of one of the four are replaced;
    all others stay. An empty table gives an empty table.
    """
    _size, _source, _key = (fresh(docs, f"_mix_{c}") for c in ("size", "source", "key"))
    full = docs.withColumns({_size: size.cast("long"), _source: source, _key: key}).drop("_size", "_source_size", "_target", "_copies")
    scale = F.log2(F.greatest(F.col("key"), F.lit(1e-300))) * BINS
    keyed = full.select(F.col(_source).alias("source"), F.col(_size).alias("size"), F.col(_key).alias("key"))
    keyed = materialize(keyed.withColumn("bin", F.floor(scale)), "keys")
    bins = materialize(keyed.groupBy("source", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "bins")
    plan = materialize(targets(bins.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_percent, cap), "targets")
    # Parts follow the place of the key in its source's sketch, so they are even whatever the weights are.
    below = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sketch = bins.select("source", "bin", "rows", F.coalesce(F.sum("rows").over(below), F.lit(0)).alias("below"))
    place = F.floor((F.col("below") + (scale - F.col("bin")) * F.col("rows")) / PART_ROWS).cast("long")
    dealt = beside(keyed, sketch, ["source", "bin"])
    dealt = materialize(dealt.select("source", "size", "key", place.alias("part")), "parts")
    summed = prefix_sums(dealt, ["source"], "part", [F.col("key")], "size", "before")
    open_ = plan.filter("rest > 0").select(F.col("source").alias("_s"), "rest")
    inside = summed.join(open_, F.col("source").eqNullSafe(F.col("_s"))).filter("before + size / 2.0 <= rest")
    limits = inside.groupBy("source").agg(F.max("key").alias("limit")).withColumnRenamed("source", "_l")
    mine = {c: fresh(full, f"_mix_{c}") for c in ("of", "limit", "epochs")}
    p = plan.join(limits, F.col("source").eqNullSafe(F.col("_l")), "left").select(
        F.col("source").alias(mine["of"]), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("epochs").alias(mine["epochs"]), F.col("limit").alias(mine["limit"])
    )
    # Written before it is joined: Spark sees its size and broadcasts it only if small.
    p = materialize(p, "limits")
    out = full.withColumn("_size", F.col(_size)).join(p, F.col(_source).eqNullSafe(F.col(mine["of"])), "left")
    chosen = F.coalesce(F.col(_key) <= F.col(mine["limit"]), F.lit(False)).cast("int")
    return out.withColumn("_copies", F.col(mine["epochs"]) + chosen).drop(_size, _source, _key, *mine.values())
