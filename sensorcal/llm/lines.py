"""Line dedup by pairwise alignment.

Documents with the same lines throughout are copies: the first keeps them, the others lose them all. The others are
compared by runs: from each line on, the shortest run of lines with enough words for a block. Two documents have a common
block just if they have a common run. A rare run, which few documents hold, makes a pair of each two of them; one that
many hold pairs each with the first that holds it, which costs one pair a document. The two sequences of line hashes are
aligned by patience diff; aligned common blocks with enough words are deleted from the later document. The first document
that holds a run never loses it whole, as no earlier document has it.

Where the range between two anchors has no line that occurs once in both, patience takes its rarest line and goes on, so a
pair of texts of n lines that only repeat each other's lines can take n steps over n lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.lookup import beside
from ..runtime import materialize, release
from .common import SPACES, WORD, fresh, may_meet

#: Aligned blocks with fewer words stay: short lines agree by chance.
MIN_BLOCK_WORDS = 10
#: A run that at most so many documents hold pairs all of them; a commoner one pairs each with the first.
RARE = 8
#: Any odd number without a pattern.
BASE = 0x9E3779B97F4A7C15
#: Pairs that meet one copy of an earlier document's lines, about.
LOT = 512


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j), increasing in both, where ``a[i] == b[j]``.

    Common ends are matched first, then lines that occur once in either range, along their longest increasing
    run; where there is none, the common line with the fewest occurrences.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        common = in_a.keys() & in_b.keys()
        if not common:
            continue
        once = {x for x in common if in_a[x] == 1 == in_b[x]} or {min(common, key=lambda x: (in_a[x] * in_b[x], x))}
        first_b = {}
        for j in range(b1 - 1, b0 - 1, -1):
            if b[j] in once:
                first_b[b[j]] = j
        met, taken = [], set()
        for i in range(a0, a1):
            if a[i] in once and a[i] not in taken:
                taken.add(a[i])
                met.append((i, first_b[a[i]]))
        anchors = _increasing(met)
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def _increasing(met: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of ``met`` (sorted by i) whose j increase."""
    tails, at, back = [], [], [-1] * len(met)
    for k, (_, j) in enumerate(met):
        p = bisect_left(tails, j)
        back[k] = at[p - 1] if p else -1
        tails[p : p + 1], at[p : p + 1] = [j], [k]
    run, k = [], at[-1] if at else -1
    while k >= 0:
        run.append(met[k])
        k = back[k]
    return run[::-1]


def repeated_lines(early: Sequence[int], late: Sequence[int], words: Sequence[int], least: int = MIN_BLOCK_WORDS) -> list[int]:
    """Positions in ``late`` of the aligned common blocks that have at least ``least`` words."""
    out, block, ends = [], [], (-2, -2)
    for i, j in [*patience(early, late), (-9, -9)]:
        if (i - 1, j - 1) != ends:
            if sum(words[k] for k in block) >= least:
                out += block
            block = []
        block.append(j)
        ends = (i, j)
    return out


def _key(doc_id: Column, text: Column) -> Column:
    """Order of documents: by id, those without an id last; equal ids by a hash of the text."""
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text).alias("text"))


def runs(lines: Sequence[int], words: Sequence[int], least: int = MIN_BLOCK_WORDS) -> np.ndarray:
    """For each line with a word, a hash of the shortest run from it on that has ``least`` words, if there is one; each once."""
    line, n = np.asarray(lines, dtype=np.int64).view(np.uint64), len(lines)
    upto = np.concatenate([[0], np.cumsum(np.asarray(words, dtype=np.int64))])
    end = np.searchsorted(upto, upto[:-1] + least)
    start = np.flatnonzero((end <= n) & (upto[1:] > upto[:-1]))
    # Line k of a run counts times the k-th power of an odd number, modulo 2^64: a difference of sums, divided by the power at its start.
    power = np.cumprod(np.full(n + 1, BASE, dtype=np.uint64))
    inverse = np.cumprod(np.full(n + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(line * power[:n], dtype=np.uint64)])
    return np.unique((total[end[start]] - total[start]) * inverse[start] + power[end[start] - start]).view(np.int64)


def _pairs(held: DataFrame, rare: int) -> DataFrame:
    """(doc, early), each pair once, a written table, from (doc, run): rare runs pair all their documents, others each with the first."""
    shared = held.groupBy("run").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Written first, so that a run with any share of the rows meets one row in a join that Spark can split.
    shared = materialize(shared, "shared")
    common = held.join(shared.filter(F.col("n") > rare), "run").filter("doc <> first").select("doc", F.col("first").alias("early"))
    few = held.join(shared.filter(F.col("n") <= rare).select("run"), "run")
    few = few.groupBy("run").agg(F.sort_array(F.collect_list("doc")).alias("all"))
    earlier = F.transform("all", lambda d, i: F.transform(F.slice("all", F.lit(1), i), lambda e: F.struct(d.alias("doc"), e.alias("early"))))
    few = few.select(F.explode(F.flatten(earlier)).alias("p")).select("p.doc", "p.early")
    pairs = materialize(common.union(few).distinct(), "pairs")
    release(shared)
    return pairs


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """All rows and columns of ``docs`` and ``_removed``: positions (from 0) of the lines to delete, or null.

    Lines are the parts between newlines, compared without white space at their ends. Documents are ordered by
    ``doc_id``, then by a hash of the text; those with a null ``doc_id`` come last. Rows equal in both are one document
    and treated alike. A null or empty text has no line to delete; an empty table gives an empty table. A column
    ``_removed`` of ``docs`` is replaced; all others stay.
    """
    docs = docs.drop("_removed")
    ident, body = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    parts = F.split(body, "\n", -1)
    hashed = F.transform(parts, lambda x: F.xxhash64(F.btrim(x, F.lit(SPACES))))
    counts = F.transform(parts, lambda x: F.regexp_count(x, F.lit(WORD)))
    rows = docs.select(_key(ident, body).alias("doc"), hashed.alias("lines"), counts.alias("words"))
    rows = materialize(rows.filter(F.aggregate("words", F.lit(0), lambda a, x: a + x) >= least), "lines")
    kind = rows.schema["doc"].dataType.simpleString()

    whole = rows.select("doc", F.struct(F.xxhash64("lines"), F.xxhash64(F.lit(1), F.col("lines"))).alias("same"), F.size("lines").alias("n"))
    heads = whole.groupBy("same").agg(F.min("doc").alias("head"), F.max("doc").alias("last")).filter("head <> last")
    heads = materialize(heads.drop("last"), "heads")
    copies = whole.join(heads, "same").filter("doc <> head").select("doc", "n")
    copies = materialize(copies.distinct(), "copies")

    def all_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [runs(x, w, least) for x, w in zip(batch["lines"], batch["words"])]
            yield batch[["doc"]].assign(found=found)

    # Repeated rows are one document; one of its rows is aligned.
    late = materialize(rows.join(copies, "doc", "left_anti").dropDuplicates(["doc"]), "distinct-lines")
    held = late.mapInPandas(all_runs, f"doc {kind}, found array<bigint>").select("doc", F.explode("found").alias("run"))
    held = materialize(held, "runs")
    pairs = _pairs(held, rare)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = [repeated_lines(a.tolist(), b.tolist(), w.tolist(), least) for a, b, w in zip(batch["before"], batch["lines"], batch["words"])]
            yield batch[["doc"]].assign(gone=gone)[[bool(g) for g in gone]]

    # An early document with many pairs has its lines sent once for each lot of them.
    lots = pairs.groupBy("early").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    crowded = materialize(lots.filter("lots > 1"), "crowded")
    lots = F.coalesce("lots", F.lit(1))
    dealt = beside(pairs, crowded, ["early"]).withColumn("lot", F.pmod(F.xxhash64("doc"), lots).cast("int")).drop("lots")
    early = beside(late.select(F.col("doc").alias("early"), F.col("lines").alias("before")), crowded, ["early"])
    early = early.withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("lots")
    met = dealt.join(early, ["early", "lot"]).join(late, "doc").select("doc", "lines", "words", "before")
    found = met.mapInPandas(align, f"doc {kind}, gone array<int>")
    gone = found.select("doc", F.explode("gone").alias("at")).groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("_removed"))
    gone = gone.union(copies.select("doc", F.sequence(F.lit(0), F.col("n") - 1)))
    key, gone_key = fresh(docs, "_doc"), fresh(docs, "_gone_doc")
    gone = materialize(gone, "removed").withColumnRenamed("doc", gone_key)
    release(rows, heads, copies, late, held, pairs, crowded)
    # Most documents lose nothing, and their texts are not moved.
    found, others = may_meet(docs.withColumn(key, _key(ident, body)), key, gone, gone_key)
    found = found.join(gone, F.col(key) == F.col(gone_key), "left").drop(key, gone_key)
    return found.union(others.drop(key).withColumn("_removed", F.lit(None).cast(gone.schema["_removed"].dataType)))


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without its lines at these positions."""
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(removed, i))
    return F.when(removed.isNull(), text).otherwise(F.array_join(left, "\n"))
