"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

A sketch is a histogram whose bins are exact below 64 and have 32 steps per doubling above (at most 3 % wide).
It is a plain table of (group, signal, bin, count): sketches merge by adding counts, whatever the order, so reruns
agree and language-wide or corpus-wide sketches come from the group sketches without another pass over the texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialize
from .common import SPACES, aside, fresh, let, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Signal:
    """A whole number per document, and how far it may lie outside the quartiles of its group.

    The fence is ``spread`` quartile distances beyond the quartile, and never nearer to it than ``slack``
    (in groups where most values are equal the quartile distance says nothing).
    """

    name: str
    num: str
    den: str
    slack: int
    low: bool = False
    spread: int = 4


#: Values are per mille of the denominator (characters of a word times 1000).
SIGNALS = (
    Signal("symbols_per_word", "n_symbols", "n_words", 150),
    Signal("dup_line_share", "n_dup_lines", "n_lines", 450),
    Signal("repeat_share", "n_repeat_words", "n_words", 300),
    Signal("word_length", "word_chars", "n_words", 1200, low=True),
)
#: A group's own sketch decides from so many documents on; below, its language's, and below again, the corpus's.
LEAST_DOCS = 200


def repeated_window_words(tokens: Column, width: int = 8) -> Column:
    """Number of words inside ``width``-word windows that occur twice or more (the first occurrence included)."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        # Windows in order: each adds what reaches beyond the end of the one before.
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + width).alias("end"), (a["n"] + p + width - F.greatest(a["end"], p)).alias("n"))
        return F.aggregate(let(ordered, starts), zero, step)["n"]

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - width + 1)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(width))))
        of = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
        return F.when(F.size(w) >= width, of).otherwise(0)

    return let(tokens, count).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``MEASURES`` and ``n_lines`` (lines with a word). A null text has no words."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = lambda c: F.translate(c, SPACES, "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(bare(x)) > 0)
    counted = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    of_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).alias("rep")))
    symbols = "#*$%&|<>"
    of, by = fresh(docs, "_words"), fresh(docs, "_lines")
    out = docs.withColumns({by: counted, of: of_words}).withColumns(
        {
            "n_words": F.col(of)["n"],
            "word_chars": F.length(bare(t)).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, symbols, ""))).cast("long"),
            "n_dup_lines": F.col(by)["dup"],
            "n_repeat_words": F.col(of)["rep"],
            "n_lines": F.col(by)["n"],
        }
    )
    return out.drop(by, of)


def value(s: Signal) -> Column:
    """Per mille, rounded down; null where the denominator is 0."""
    return F.when(F.col(s.den) > 0, F.expr(f"{s.num} * 1000 div {s.den}"))


def bin_start(v: Column) -> Column:
    """The smallest value of the sketch's bin that ``v`` (0 or more) falls into."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, signal, bin, n): a row per group, signal and bin; partial sums are made before the shuffle."""
    pairs = F.array(*(F.struct(F.lit(s.name).alias("signal"), bin_start(value(s)).alias("bin")) for s in SIGNALS))
    rows = measured.filter(~F.col("base_failed")).select(*groups, F.explode(pairs).alias("p"))
    return rows.filter("p.bin IS NOT NULL").groupBy(*groups, "p.signal", "p.bin").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, signal, docs, q1, q3) from sketches; a window holds the bins of one sketch, a few hundred rows."""
    w = Window.partitionBy(*groups, "signal")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "docs": F.sum("n").over(w)})
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, F.col("bin")))
    return ranked.groupBy(*groups, "signal").agg(F.first("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketch: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per (lang, source) with a ``<signal>_low`` and ``<signal>_high`` for each signal.

    Sketches of a language and of the corpus are merged from those of the groups.
    """
    merged = lambda keys: sketch.groupBy(*keys, "signal", "bin").agg(F.sum("n").alias("n"))
    levels = [(quartiles(sketch, ["lang", "source"]), ["lang", "source"]), (quartiles(merged(["lang"]), ["lang"]), ["lang"]), (quartiles(merged([]), []), [])]
    base = sketch.select("lang", "source", "signal").distinct()
    for k, (q, keys) in enumerate(levels):
        q = q.select(*(F.col(c).alias(f"_k_{c}") for c in [*keys, "signal"]), *(F.col(c).alias(f"{c}_{k}") for c in ("docs", "q1", "q3")))
        base = base.join(q, [base[c].eqNullSafe(q[f"_k_{c}"]) for c in [*keys, "signal"]], "left").drop(*(f"_k_{c}" for c in [*keys, "signal"]))
    pick = lambda c: F.when(F.col("docs_0") >= least_docs, F.col(f"{c}_0")).when(F.col("docs_1") >= least_docs, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    base = base.withColumns({"q1": pick("q1"), "q3": pick("q3")})
    out = []
    for s in SIGNALS:
        mine = F.col("signal") == s.name
        reach = F.greatest((F.col("q3") - F.col("q1")) * s.spread, F.lit(s.slack))
        out.append(F.max(F.when(mine, F.col("q3") + reach)).alias(f"{s.name}_high"))
        if s.low:
            out.append(F.max(F.when(mine, F.col("q1") - reach)).alias(f"{s.name}_low"))
    return base.groupBy("lang", "source").agg(*out)


def quality_verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = False, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All rows of ``docs`` with the measures, ``base_failed`` and ``kept``.

    The base rules come first; the documents that pass them feed the sketches, and each is kept if all of its
    signals lie inside the fences of its language and source. ``keep_text=False`` leaves the text out.

    A null or empty text has no words and fails the base rules. A null language or source is a group of its own.
    Repeated rows are judged alike. Columns of ``docs`` that have the name of a measure are replaced; an empty table
    gives an empty table.
    """
    words_ = F.col("n_words")
    judged = measure(docs, text).withColumn("base_failed", (words_ < 20) | (100 * F.col("n_repeat_words") > 30 * words_))
    judged = judged if keep_text else judged.drop(text)
    judged = materialize(judged, "quality")
    keys = judged.withColumns({k: F.col(f"`{v}`") for k, v in {"lang": lang, "source": source}.items()}) if (lang, source) != ("lang", "source") else judged
    limits = materialize(thresholds(sketches(keys, ["lang", "source"]), least_docs), "limits")
    names = {c: fresh(judged, f"_{c}") for c in limits.columns}
    limits = limits.select(*(F.col(c).alias(n) for c, n in names.items()))
    inside = [F.coalesce(value(s) <= F.col(names[f"{s.name}_high"]), F.lit(True)) for s in SIGNALS]
    inside += [F.coalesce(value(s) >= F.col(names[f"{s.name}_low"]), F.lit(True)) for s in SIGNALS if s.low]
    # The limits are written before they are joined: Spark knows their size and broadcasts them only if small.
    on = judged[lang].eqNullSafe(F.col(names["lang"])) & judged[source].eqNullSafe(F.col(names["source"]))
    kept = ~F.col("base_failed") & reduce(lambda a, b: a & b, inside)
    return judged.join(limits, on, "left").withColumn("kept", kept).drop(*names.values())


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    Measures are appended under names that ``docs`` does not have, so no column is lost.
    """
    added = (*MEASURES, "n_lines", "base_failed", "kept")
    free, back = aside(docs, added)
    out = quality_verdicts(free, keep_text=True).filter("kept").drop(*added)
    return out.withColumnsRenamed(back).select(*(F.col(f"`{c}`") for c in docs.columns))
