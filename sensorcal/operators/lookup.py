"""Parameters of groups beside the groups' rows, whatever the number of groups and however unequal they are."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize, written_bytes

#: A written parameter table of at most so many rows and bytes on disk goes to every task whole.
SMALL_ROWS = 100_000
SMALL_BYTES = 4 << 20


def _same(a: DataFrame, b: DataFrame, names: Sequence[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, [a[f"`{x}`"].eqNullSafe(b[f"`{y}`"]) for x, y in names])


def _paired(keys: Sequence[str], values: Sequence[str]) -> list[Column]:
    named = [F.col(f"`{k}`").alias(f"_beside_k{i}") for i, k in enumerate(keys)]
    return [*named, F.struct(*[F.col(f"`{c}`") for c in values]).alias("_beside_values")]


def beside(
    rows: DataFrame, params: DataFrame, keys: Sequence[str], how: str = "left", rows_bound: int | None = None
) -> DataFrame:
    """``rows`` with the other columns of ``params`` (one row per key); NULL keys meet NULL keys.

    ``params`` is written first, so its size is known. A small table is sent to the tasks and no row moves. For a
    larger one rows are counted per key: a key with more than one shuffle partition's share of all rows is heavy, and
    there are fewer heavy keys than shuffle partitions, so theirs can be sent whatever the data. Only rows of the
    other keys are dealt by key; heavy rows are dealt evenly and bring their parameters along. ``how`` is ``left`` or
    ``inner``. A column of ``params`` that ``rows`` has too (other than the keys) replaces it. A caller who has counted
    a written ``params`` gives ``rows_bound``; up to ``SMALL_ROWS`` narrow rows it is then not written again.
    """
    spark, keys = rows.sparkSession, list(keys)
    values = [c for c in params.columns if c not in keys]
    rows = rows.drop(*[c for c in values if c in rows.columns])
    if not keys:
        raise ValueError("keys must not be empty")
    own = params.select(*_paired(keys, values))
    small = rows_bound is not None and rows_bound <= SMALL_ROWS
    if not small:
        # A table as ``materialize`` returned it is not written again.
        table = params if hasattr(params, "_scratch") else materialize(params, "params")
        own = own if table is params else table.select(*_paired(keys, values))
        small = written_bytes(table) <= SMALL_BYTES and table.count() <= SMALL_ROWS
    named = [(k, f"_beside_k{i}") for i, k in enumerate(keys)]
    out = [F.col(f"`{c}`") for c in rows.columns] + [F.col(f"_beside_values.`{c}`").alias(c) for c in values]
    if small:
        return rows.join(F.broadcast(own), _same(rows, own, named), how).select(*out)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(rows.groupBy(*[F.col(f"`{k}`").alias(f"_beside_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_rows")), "rows-per-key")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    # By the definition of the filter fewer rows than ``parts``.
    heavy = counts.where(F.col("_rows") * parts > total).drop("_rows")
    names = [f"_beside_k{i}" for i in range(len(keys))]
    known = heavy.select(*[F.col(n).alias(f"_h{n}") for n in names])
    # An outer join can send its optional side only, so the heavy keys are met first, then those without parameters added.
    met = own.join(F.broadcast(known), reduce(Column.__and__, [own[n].eqNullSafe(known[f"_h{n}"]) for n in names]))
    met = met.select(*[F.col(f"_h{n}").alias(f"_m{n}") for n in names], F.col("_beside_values").alias("_beside_heavy"))
    found = known.join(F.broadcast(met), reduce(Column.__and__, [F.col(f"_h{n}").eqNullSafe(F.col(f"_m{n}")) for n in names]), "left")
    found = materialize(found.select(*[f"_h{n}" for n in names], "_beside_heavy", F.lit(True).alias("_beside_is_heavy")), "heavy-params")
    placed = rows.join(F.broadcast(found), _same(rows, found, [(k, f"_h{n}") for k, n in zip(keys, names)]), "left").drop(*[f"_h{n}" for n in names])
    placed = placed.withColumn("_beside_place", F.when(F.col("_beside_is_heavy"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)) + 1).otherwise(F.lit(0)))
    salted = own.withColumn("_beside_at", F.lit(0).cast("long"))
    same = _same(placed, salted, named) & placed["_beside_place"].eqNullSafe(salted["_beside_at"])
    # By hint: Spark takes a compressed file for far smaller than its rows and would send it whole after all.
    joined = placed.join(salted.withColumn("_beside_met", F.lit(True)).hint("merge"), same, "left")
    joined = joined.withColumn("_beside_values", F.coalesce("_beside_heavy", "_beside_values"))
    if how == "inner":
        joined = joined.where(F.col("_beside_met") | F.col("_beside_heavy").isNotNull())
    return joined.select(*out)
