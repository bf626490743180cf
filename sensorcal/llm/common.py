"""Small parts that several of the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Words are what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: Places of the bitmap that tells which rows may meet a table.
MARKS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; Spark computes an outer expression again for each element of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file lies on this machine (each executor has its own installation)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of these ``names`` (whatever the case) renamed to free ones, and the renaming that undoes it."""
    wanted, back = {n.lower() for n in names}, {}
    for c in df.columns:
        if c.lower() in wanted:
            free = fresh(df, f"_own_{c}")
            df, back[free] = df.withColumnRenamed(c, free), c
    return df, back


def may_meet(rows: DataFrame, key: str, table: DataFrame, other: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``key`` may be among ``other`` of ``table``, and those whose key is not.

    Keys are told by a bit for the remainder of their hash; at most MARKS / 64 numbers are sent to the tasks, whatever
    the table. Rows that pass by chance find nothing in the join that follows.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    word, bits, row_word = (fresh(rows, n) for n in ("_word", "_bits", "_row_word"))
    marks = table.select((at(other) / 64).cast("int").alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), (at(other) % 64).cast("int")).alias("bit"))
    marks = marks.groupBy(word).agg(F.bit_or("bit").alias(bits))
    marked = rows.withColumn(row_word, (at(key) / 64).cast("int")).join(F.broadcast(marks), F.col(row_word) == F.col(word), "left")
    may = F.coalesce(F.bit_get(bits, (at(key) % 64).cast("int")) == 1, F.lit(False))
    return tuple(marked.filter(part).drop(word, bits, row_word) for part in (may, ~may))


def prefix_sums(df: DataFrame, keys: list[str], part: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``keys`` before this one.

    Rows are ordered by ``part``, then by ``order``. Only the rows of one part are ever sorted together; the sums
    of whole parts are added from a table with one row per part. So a key may hold any share of all rows as long
    as its parts are small. Nulls in ``keys`` count as a value. ``df`` has to be a written table.
    """
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("_in_part"))
    sums = sums.select(*keys, part, F.coalesce(F.sum("_in_part").over(before), F.lit(0)).alias("_before_part"))
    within = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    for k in [*keys, part]:
        sums = sums.withColumnRenamed(k, f"_r_{k}")
    same = [inside[k].eqNullSafe(sums[f"_r_{k}"]) for k in [*keys, part]]
    joined = inside.join(sums, same, "left").drop(*(f"_r_{k}" for k in [*keys, part]))
    return joined.withColumn(name, F.col("_inside") + F.col("_before_part")).drop("_inside", "_before_part")
