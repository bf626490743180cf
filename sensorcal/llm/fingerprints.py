"""Document fingerprints from closed syncmers of words.

A k-mer is ``K`` words in a row. Its inner substrings are the ``S``-word runs in it; the k-mer is chosen if the smallest of
their hashes is that of the first or of the last. The choice depends on the k-mer alone, so equal passages give equal
anchors wherever they stand, and an anchor is never further than K - S words from the next.

The fingerprint keeps the ``SIZE`` anchors with the smallest hashes, each with the number of its first word. Two
fingerprints are compared on the smallest anchors of both together (which estimates the share of common anchors), and
common anchors count where they lie on the most frequent shift of position between the two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialize
from .common import let, words

K = 8
S = 2
SIZE = 96
#: An anchor is one number: a 31-bit hash above, the word number below.
POSITION_BITS = 32


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """All closed syncmers of the text as array<long>, in order of position. Fewer than ``k`` words are one k-mer."""
    packed = lambda h, at: F.shiftleft(F.shiftrightunsigned(h, 33), POSITION_BITS).bitwiseOR(at.cast("long"))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        hashed = F.transform(w, lambda x: F.xxhash64(x))

        def inner(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), n - s + 1), lambda i: F.xxhash64(*(F.get(h, i + j - 1) for j in range(s))))

        def chosen(m: Column) -> Column:
            # i: number of the first inner substring of a k-mer; k - s + 1 of them lie in it.
            span = k - s + 1
            closed = F.filter(F.sequence(F.lit(1), n - k + 1), lambda i: let(F.slice(m, i, F.lit(span)), lambda x: F.array_min(x) == F.least(F.get(x, F.lit(0)), F.get(x, F.lit(span - 1)))))
            return F.transform(closed, lambda i: packed(F.xxhash64(F.slice(m, i, F.lit(span))), i - 1))

        long_ = let(let(hashed, inner), chosen)
        short = F.array(packed(F.xxhash64(w, F.lit(k)), F.lit(0)))
        return F.when(n >= k, long_).when(n > 0, short).otherwise(F.array().cast("array<long>"))

    return let(words(text), of_words)


def sketch(found: Column, size: int = SIZE) -> Column:
    """The anchors with the ``size`` smallest hashes, each hash once at its first position, in order of hash."""

    def once(a: Column) -> Column:
        high = lambda x: F.shiftrightunsigned(x, POSITION_BITS)
        return F.slice(F.filter(a, lambda x, i: (i == 0) | (high(x) != high(F.get(a, i - 1)))), F.lit(1), F.lit(size))

    return let(F.sort_array(found), once)


def as_text(fingerprint: Column) -> Column:
    """16 hexadecimal digits for each anchor."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """0 to 1: of the ``size`` smallest anchors of both, the share that both have at the most frequent shift; 1 if neither has any."""
    high = lambda x: F.shiftrightunsigned(x, POSITION_BITS)
    low = lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))

    def of_hashes(h: Column) -> Column:
        ha, hb = h["a"], h["b"]

        def of_both(both: Column) -> Column:
            union = F.slice(F.array_sort(F.array_union(ha, hb)), F.lit(1), F.lit(size))

            def counted(u: Column) -> Column:
                common = F.array_intersect(u, both)
                shift = lambda x: low(F.element_at(a, F.array_position(ha, x).cast("int"))) - low(F.element_at(b, F.array_position(hb, x).cast("int")))

                def most(d: Column) -> Column:
                    counts = F.transform(F.array_distinct(d), lambda x: F.size(F.filter(d, lambda y: x == y)))
                    return F.array_max(counts) / F.size(u)

                return let(F.transform(common, shift), most)

            return F.coalesce(let(union, counted), F.lit(0.0))

        return F.when(F.size(ha) + F.size(hb) == 0, 1.0).otherwise(let(F.array_intersect(ha, hb), lambda both: F.when(F.size(both) == 0, 0.0).otherwise(of_both(both))))

    return let(F.struct(F.transform(a, high).alias("a"), F.transform(b, high).alias("b")), of_hashes)


def beside_next(docs: DataFrame, order: str, text: str, derived: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Adds ``derived`` columns, and ``next_<column>`` of them and of ``text``: the values in the row that follows.

    Rows follow each other by descending ``order``, then descending text; the first follows the last. Rows are dealt to
    ranges of ``order`` and sorted within; the last row of a range also needs the first of the next one, which is sent
    there. So each text is shuffled once, and one per range twice.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # At most ``parts`` bounds: quantiles of the order column, from a sketch of fixed size.
    bounds = docs.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("q")).first().q
    below = F.array(*(F.lit(b).cast("long") for b in sorted(set(bounds or [])))).cast("array<long>")
    rows = docs.withColumn("_range", F.size(F.filter(below, lambda x: x < F.col(order))))
    # Windows over one row per range.
    top = rows.groupBy("_range").agg(F.max(order).alias("_top"))
    above = F.lag("_range").over(Window.orderBy(F.desc("_range")))
    ring = top.select(F.col("_range").alias("_from"), "_top", F.coalesce(above, F.min("_range").over(Window.partitionBy())).alias("_to"))
    ring = materialize(ring, "ring")
    firsts = rows.join(ring, (F.col("_range") == F.col("_from")) & (F.col(order) == F.col("_top")))
    sent = firsts.groupBy("_to").agg(F.max(text).alias(text)).withColumnRenamed("_to", "_range").withColumn("_sent", F.lit(True))
    both = rows.withColumn("_sent", F.lit(False)).unionByName(sent, allowMissingColumns=True).withColumns(derived)
    within = Window.partitionBy("_range").orderBy("_sent", F.desc(order), F.desc(text))
    out = both.withColumns({f"next_{c}": F.lead(c).over(within) for c in (text, *derived)})
    return out.filter(~F.col("_sent")).drop("_sent", "_range")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row of ``docs``.

    The edited text has the last half (rounded down) of the code points replaced by the first as many of the next document's,
    in descending order of id, nulls last, equal ids by text; the last document's next is the first. A null text is
    empty; texts without a word have an empty fingerprint, and two such are alike (1). Repeated rows stand beside each other. A
    single row is its own next. An empty table gives an empty table.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = own.withColumn("_order", F.coalesce("doc_id", F.lit(-(1 << 63))))
    met = beside_next(own, "_order", "text", {"print": sketch(anchors(F.col("text")))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    both = met.withColumn("edited", edited).withColumn("edited_print", sketch(anchors(F.col("edited"))))
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
