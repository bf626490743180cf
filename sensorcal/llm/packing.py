"""Packing documents into training windows by non-negative least squares.

Documents are cut into full windows and a remainder. Remainders are counted by length class (a histogram of fixed
size). Short combinations of classes that fill a window are enumerated; non-negative least squares finds how often each
should be used so that the histogram is met; counts are rounded down and what is left over is packed greedily, largest
class first. All of this works on the histogram, so its cost does not depend on the number of documents. Spark
then deals the pieces, by their number within their class, to the places of the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import materialize
from .common import prefix_sums, tokens_path
from .tokens import word_ids

WINDOW = 4096
#: Width of a length class: a remainder wastes less than this in its place.
UNIT = 8
END_ID = 2
#: Pieces that are numbered together, about.
PART_ROWS = 4096


def combinations(classes: np.ndarray, full: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c >= 0 and a + b + c = full, each part a class that occurs (0: none)."""
    has = np.zeros(full + 1, bool)
    has[classes] = True
    has[0] = True
    a, b = np.meshgrid(np.arange(full + 1), np.arange(full + 1), indexing="ij")
    c = full - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = has[a] & has[b] & has[c]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def nnls_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes A x close to the histogram (least squares), A counting the classes in each combination.

    Accelerated projected gradient; A is never built, its columns have three entries.
    """
    full = len(histogram) - 1
    y = histogram.astype(float)
    y[0] = 0
    scale = max(1.0, y.sum())
    y = y / scale
    weight = (combos > 0).astype(float)

    def times(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, k], weights=x * weight[:, k], minlength=full + 1) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[combos[:, k]] * weight[:, k] for k in range(3))

    # The step is one over the largest eigenvalue of A'A, found by powers.
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / np.linalg.norm(back(times(v)))
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0, z - step * 0.98 * back(times(z) - y))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x * scale


def plan(histogram: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((class, pieces), ...) and how many windows follow each; together they use every piece once."""
    full = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out = []
    combos = combinations(np.flatnonzero(left), full)
    if len(combos):
        x = nnls_counts(histogram, combos)
        order = np.argsort(-x, kind="stable")
        # Rounded to the nearest and never beyond what is left, the most used combinations first.
        for k in order[: int((x >= 0.5).sum())]:
            classes, pieces = np.unique(combos[k][combos[k] > 0], return_counts=True)
            n = int(min(round(x[k]), *(left[classes] // pieces)))
            if n > 0:
                left[classes] -= n * pieces
                out.append((tuple(zip(classes.tolist(), pieces.tolist())), n))
    while left.any():
        # A window as the greedy would fill it; repeated as often as the pieces last.
        room, pattern = full, []
        for c in np.flatnonzero(left)[::-1].tolist():
            m = int(min(room // c, left[c]))
            if m:
                pattern.append((c, m))
                room -= c * m
        n = int(min(left[c] // m for c, m in pattern))
        for c, m in pattern:
            left[c] -= n * m
        out.append((tuple(pattern), n))
    return out


def places(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> pd.DataFrame:
    """For each class and pattern: its pieces number ``first`` to ``first + n * pieces - 1`` go to windows from ``window`` on."""
    used, rows, window = {}, [], 0
    for pattern, n in patterns:
        for slot, (c, pieces) in enumerate(pattern):
            first = used.get(c, 0)
            rows.append((c, first, pieces, window, slot))
            used[c] = first + n * pieces
        window += n
    return pd.DataFrame(rows, columns=["cls", "first", "pieces", "window", "slot"]).astype("int64")


def place(pieces: DataFrame, length: str = "length", window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """``pieces`` (a written table; lengths 1 to ``window``) with ``sequence_id`` and ``offset``.

    Offsets are gapless from 0 within a sequence, and no sequence is longer than the window.
    """
    full = window // unit
    if window % unit:
        raise ValueError("the window has to be a multiple of the unit")
    spark = pieces.sparkSession
    cls = F.ceil(F.col(length) / unit).cast("int")
    # At most window / unit rows reach the driver.
    counts = pieces.groupBy(cls.alias("c")).count().toPandas()
    histogram = np.zeros(full + 1, np.int64)
    histogram[counts["c"].to_numpy(int)] = counts["count"].to_numpy()
    # At most two patterns end with a class (its count is then used up), so the table of places is bounded as well.
    table = places(plan(histogram))
    names = pieces.columns
    parts = max(1, -(-int(histogram.max()) // PART_ROWS))
    dealt = pieces.withColumns({"_cls": cls, "_one": F.lit(1)})
    dealt = materialize(dealt.withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts))), "classes")
    ranked = prefix_sums(dealt, ["_cls"], "_part", [F.col(c) for c in names], "_one", "_rank").drop("_one", "_part")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_class = {c: g.sort_values("first") for c, g in table.groupby("cls")}
        for batch in batches:
            seq, slot = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for c, rows in batch.reset_index(drop=True).groupby("_cls"):
                g = by_class[c]
                r = rows["_rank"].to_numpy(np.int64)
                at = np.searchsorted(g["first"].to_numpy(), r, side="right") - 1
                into = r - g["first"].to_numpy()[at]
                per = g["pieces"].to_numpy()[at]
                seq[rows.index] = g["window"].to_numpy()[at] + into // per
                slot[rows.index] = g["slot"].to_numpy()[at] * full + into % per
            yield batch.drop(columns=["_cls", "_rank"]).assign(sequence_id=seq, _slot=slot)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    placed = ranked.mapInPandas(assign, f"{kinds}, sequence_id long, _slot long")
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long")).drop("_slot")


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, copy): full windows of each document and its remainder."""
    path = path or tokens_path()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, end = word_ids(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for ident, body, copy in zip(batch["doc_id"], batch["text"], batch["copy"]):
                ids = tokens.encode(body) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((start, len(part) // 4, crc32(part), n, copy))
                    rows[-1] = (ident, *rows[-1])
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"])
            yield out.assign(doc_id=pd.array(out["doc_id"], "Int64"))

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("copy"))
    return own.mapInPandas(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, unit: int = UNIT, path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, copy, sequence_id, offset.

    Ids are those of the tokenizer and a closing 2; a null or empty text has the closing id only. Repeated rows are
    packed once each, told apart by ``copy``; a null ``doc_id`` stays null. An empty table gives an empty table.
    """
    return place(materialize(cut(docs, doc_id, text, window, path), "pieces"), "length", window, unit)
