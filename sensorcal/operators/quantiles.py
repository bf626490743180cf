"""Exact quantiles (linear interpolation) by radix selection, the same way for every size of table and group.

Values become 64-bit keys with the same order. A pass counts values per group and per next 16 bits of the key, among the
values whose earlier bits are those of a wanted order statistic; running sums over a histogram say which bucket holds
the statistic and at which place. A bucket of one value is done; one of at most 65,536 values is sorted as it is, which
takes no more room than its next histogram would. So after four passes at most every statistic is known, all columns and
probabilities are found together, nothing is estimated, and no task holds more of a group than a histogram.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialize, release
from .lookup import SMALL_ROWS, beside

# Bits of the key that one pass looks at.
DIGIT = 16
# A bucket with at most so many values is sorted.
BUCKET = 1 << DIGIT
_SMALLEST_NORMAL = 2.0**-1022
_MANTISSA = 1 << 52


def with_order_key(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds a long that orders as the present double ``value`` does (undefined values last), a key of its own for every value.

    It is the exponent and the fraction of the double, found by exact division by a power of two.
    """
    v = F.col(value)
    special = F.isnan(v) | (F.abs(v) == float("inf")) | (F.abs(v) < _SMALLEST_NORMAL)
    scaled = (
        df.withColumn("_abs", F.when(special, 1.0).otherwise(F.abs(v)))
        # The logarithm may be off by one near powers of two; the fraction then lies in [1/2, 1) or [2, 4).
        .withColumn("_exp", F.least(F.floor(F.log2("_abs")), F.lit(1023)))
        .withColumn("_frac", F.col("_abs") / F.pow(F.lit(2.0), F.col("_exp")))
    )
    e, m = F.col("_exp").cast("long"), F.col("_frac")
    normal = (
        F.when(m >= 2, (e + 1023) * _MANTISSA + (m * (_MANTISSA / 2)).cast("long"))
        .when(m < 1, (e + 1021) * _MANTISSA + (m * (_MANTISSA * 2.0)).cast("long"))
        .otherwise((e + 1022) * _MANTISSA + (m * float(_MANTISSA)).cast("long"))
    )
    size = (
        F.when(F.isnan(v), F.lit((1 << 63) - 1))
        .when(F.abs(v) == float("inf"), F.lit(2047 * _MANTISSA))
        # Below the smallest normal value the step is constant.
        .when(F.abs(v) < _SMALLEST_NORMAL, (F.abs(v) / 2.0**-1074).cast("long"))
        .otherwise(normal)
    )
    return scaled.withColumn(name, F.when(v < 0, -size - 1).otherwise(size)).drop("_abs", "_exp", "_frac")


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    return reduce(Column.__and__, [a[f"`{n}`"].eqNullSafe(b[f"`_b_{n}`"]) for n in names])


def _asked(ranks: DataFrame, buckets: int) -> DataFrame:
    """For a join: by hint dealt by key if of many buckets, as Spark takes exploded rows of compressed files for few."""
    return ranks if buckets <= SMALL_ROWS else ranks.hint("merge")


def _within(histogram: DataFrame, ranks: Column, within: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The buckets that hold a wanted rank; ``ranks`` then count from the bucket's start."""
    before = Window.partitionBy(*within).orderBy("_pre").rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).withColumn("_ranks", ranks)
    cum, k = F.col("_before"), F.col("_k")
    here = F.filter("_ranks", lambda r: (r["at"] >= cum) & (r["at"] < cum + k))
    moved = F.transform(here, lambda r: F.struct(r["i"].alias("i"), r["side"].alias("side"), (r["at"] - cum).alias("at"), r["pos"].alias("pos")))
    return placed.select(*keep, "_pre", "_k", "_mn", "_mx", moved.alias("_ranks")).where(F.size("_ranks") > 0)


def _histogram(values: DataFrame, group: Sequence[str], shift: int) -> DataFrame:
    return values.groupBy(*group, F.shiftright("_key", shift).alias("_pre")).agg(
        F.count("*").alias("_k"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx")
    )


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key (one row in all without keys); column ``<col>`` is the array of its quantiles.

    Missing values are left out; a NULL key is a group of its own; ``probs`` must ascend. A group without any value is
    absent or all NULL. The passes run when this is called; the result is a small written table.
    """
    if list(probs) != sorted(probs):
        raise ValueError("probs must ascend")
    keys, cols = list(keys), list(cols)
    group = [*[f"_g{i}" for i in range(len(keys))], "_c"]
    entries = [F.struct(F.lit(i).alias("_c"), F.col(f"`{c}`").cast("double").alias("_v")) for i, c in enumerate(cols)]
    long = df.select(*[F.col(f"`{k}`").alias(g) for k, g in zip(keys, group)], F.inline(F.array(*entries))).where(F.col("_v").isNotNull())
    values = with_order_key(long, "_v", "_key")

    shift = 64 - DIGIT
    all_of = Window.partitionBy(*group)
    first = _histogram(values, group, shift).withColumn("_n", F.sum("_k").over(all_of))
    # Wanted are the places below and above (n - 1) · p, counted from 0.
    last = F.col("_n") - 1

    def places(p: Column, i: Column) -> Column:
        pos = p * last
        return F.array(*[F.struct(i.alias("i"), F.lit(s).alias("side"), f(pos).alias("at"), pos.alias("pos")) for s, f in ((0, F.floor), (1, F.ceil))])

    ranks = F.flatten(F.transform(F.array(*[F.lit(float(p)) for p in probs]), places))
    wanted = materialize(_within(first, ranks, group, group), "ranks")
    single = F.col("_mn").eqNullSafe(F.col("_mx"))
    done, scratch = [], [wanted]
    while True:
        done.append(wanted.where(single).select(*group, F.inline("_ranks"), F.col("_mn").alias("_x")))
        open_buckets, most = wanted.where(~single).agg(F.count("*"), F.max("_k")).first()
        if not open_buckets:
            break
        marks = wanted.where(~single).select(*group, "_pre", F.lit(1).alias("_wanted"))
        inside = beside(values.withColumn("_pre", F.shiftright("_key", shift)), marks, [*group, "_pre"], "inner", rows_bound=open_buckets)
        if most <= BUCKET:
            listed = inside.groupBy(*group, "_pre").agg(F.sort_array(F.collect_list("_v")).alias("_list"))
            asked = wanted.where(~single).select(*[F.col(c).alias(f"_b_{c}") for c in (*group, "_pre")], F.explode("_ranks").alias("_r"))
            found = listed.join(_asked(asked, open_buckets), _same(listed, asked, [*group, "_pre"])).select(*group, "_r.*", F.get("_list", F.col("_r.at").cast("int")).alias("_x"))
            done.append(found)
            break
        values = materialize(inside.select(*group, "_v", "_key"), "values")
        shift -= DIGIT
        finer = _histogram(values, group, shift).withColumn("_up", F.shiftright("_pre", DIGIT))
        above = wanted.where(~single).select(*[F.col(c).alias(f"_b_{c}") for c in group], F.col("_pre").alias("_b__up"), F.col("_ranks").alias("_asked"))
        finer = finer.join(_asked(above, open_buckets), _same(finer, above, [*group, "_up"])).drop(*above.columns[:-1])
        wanted = materialize(_within(finer, F.col("_asked"), [*group, "_up"], group), "ranks")
        scratch += [values, wanted]

    x0, x1 = (F.max(F.when(F.col("side") == s, F.col("_x"))) for s in (0, 1))
    both = reduce(DataFrame.unionByName, done).groupBy(*group, "i").agg(x0.alias("_x0"), x1.alias("_x1"), F.max("pos").alias("_pos"))
    between = (F.ceil("_pos") - F.col("_pos")) * F.col("_x0") + (F.col("_pos") - F.floor("_pos")) * F.col("_x1")
    q = both.withColumn("_q", F.when((F.floor("_pos") == F.col("_pos")) | (F.col("_x0") == F.col("_x1")), F.col("_x0")).otherwise(between))
    arrays = [
        F.array(*[F.max(F.when((F.col("_c") == ci) & (F.col("i") == i), F.col("_q"))) for i in range(len(probs))]).alias(c)
        for ci, c in enumerate(cols)
    ]
    out = q.groupBy(*group[:-1]).agg(*arrays).withColumnsRenamed(dict(zip(group, keys)))
    out = materialize(out, "quantiles")
    release(*scratch)
    return out


def exact_medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """As :func:`exact_quantiles` with scalar columns holding the medians."""
    q = exact_quantiles(df, cols, [0.5], keys)
    medians = q.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{c}`")[0].alias(c) for c in cols])
    medians._scratch = q._scratch
    return medians


def one_row(df: DataFrame) -> Column:
    """The single row of ``df`` as a struct usable in another query's expressions (scalar subquery)."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_s")).scalar()
