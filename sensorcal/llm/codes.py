"""Vector code compression: vectors as short codes of codebook entries, one per part, trained by rounds of averaging.

Components are integers, so every result is the same bits on any cluster. The distinct parts of all vectors, each with
its number of vectors, stand in lexicographic order. A task walks its stretch of them as a trie, depth first: a node
keeps the distances of its prefix to all entries, so vectors that begin alike share that work; leaves take the nearest
entry and add their weighted components to its sums. Only sums per entry leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.lookup import beside
from ..runtime import materialize, release

#: Leaves whose distances are held at once.
BLOCK = 1024
#: Integer components are held within this, which no vector of usual size reaches; squares then fit 64 bits.
LARGEST = 1 << 26


def _prefix_lengths(rows: np.ndarray) -> np.ndarray:
    """For each row the length of the prefix it shares with the row before; -1 for the first."""
    other = rows[1:] != rows[:-1]
    same = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return np.concatenate([[-1], same])


def _further(far: np.ndarray, value: np.ndarray, entries: np.ndarray, depth: int) -> np.ndarray:
    step = value[:, None] - entries[None, :, depth]
    return far + step * step


def nearest(rows: np.ndarray, entries: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of ``entries`` (the lower one on ties) and the squared distance, for each row.

    Rows are best in lexicographic order and distinct; the answer is right in any order. At most ``block`` times
    ``len(entries)`` distances per level of the trie are held.
    """
    n, dims = rows.shape
    index, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return index, least
    shared = _prefix_lengths(rows)
    # Stretches whose rows share their first ``depth`` components, with those components' distances.
    stack = [(0, n, 0, np.zeros((1, len(entries)), np.int64))]
    while stack:
        lo, hi, depth, far = stack.pop()
        if hi - lo > block and depth < dims:
            # Children in order; small neighbours stay together, a large one is walked by itself.
            starts = np.append(lo, lo + 1 + np.flatnonzero(shared[lo + 1 : hi] <= depth))
            ends = np.append(starts[1:], hi)
            at, todo = 0, []
            while at < len(starts):
                if ends[at] - starts[at] > block:
                    child = _further(far, rows[starts[at] : starts[at] + 1, depth], entries, depth)
                    todo.append((starts[at], ends[at], depth + 1, child))
                    at += 1
                    continue
                last = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
                todo.append((starts[at], ends[last - 1], depth, far))
                at = last
            stack += reversed(todo)
            continue
        # All nodes of one level of this subtree at once, each from its parent one level up.
        nodes = np.zeros(1, np.int64)
        first = np.full(1, lo)
        for d in range(depth, dims):
            begins = shared[lo:hi] <= d
            begins[0] = True
            first_here = lo + np.flatnonzero(begins)
            parents = np.searchsorted(first, first_here, "right") - 1
            far = _further(far[nodes[parents]], rows[first_here, d], entries, d)
            nodes, first = np.arange(len(first_here)), first_here
        best = far.argmin(axis=1)
        leaf = np.searchsorted(first, np.arange(lo, hi), "right") - 1
        index[lo:hi] = best[leaf]
        least[lo:hi] = far[np.arange(len(far)), best][leaf]
    return index, least


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assigned(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`nearest` for rows in any order, repeats included."""
    order = np.lexsort(rows.T[::-1])
    placed = rows[order]
    fresh = _prefix_lengths(placed) < rows.shape[1]
    index, least = nearest(placed[fresh], entries)
    leaf = np.cumsum(fresh) - 1
    out_i, out_d = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    out_i[order], out_d[order] = index[leaf], least[leaf]
    return out_i, out_d


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]`` are the entries of part p, as rows."""

    entries: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Of all components as decimal numbers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = 1024) -> DataFrame:
    """``_id, _label, _v``: floor(scale · x) of the vectors without missing, infinite or undefined components."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(v, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * scale))).cast("int"))
    return df.where(v.isNotNull() & (F.size(v) > 0) & whole).select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"), held.alias("_v")
    )


def distinct_parts(vectors: DataFrame, parts: int, dims: int) -> DataFrame:
    """Written table ``_part, _sub, _n`` of the distinct parts and their numbers, each file in lexicographic order."""
    width = dims // parts
    cut = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.slice("_v", p * width + 1, width).alias("s")) for p in range(parts)]))
    counted = vectors.select(cut.alias("_c")).groupBy(F.col("_c.p").alias("_part"), F.col("_c.s").alias("_sub")).agg(F.count("*").alias("_n"))
    return materialize(counted.repartitionByRange("_part", "_sub").sortWithinPartitions("_part", "_sub"), "parts")


def _round(table: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """Every entry replaced by the floored mean of the parts nearest to it; at most entries × parts rows come back."""
    names = [f"s{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "entry", "n", *names)])
    entries = books.entries

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(book), width + 1), np.int64) for book in entries]
        for batch in batches:
            part = batch.column("_part").to_numpy()
            rows, n = _matrix(batch.column("_sub"), width), batch.column("_n").to_numpy().astype(np.int64)
            for p in np.unique(part):
                here = part == p
                index, _ = nearest(rows[here], entries[p])
                weighted = np.column_stack([n[here], rows[here] * n[here][:, None]])
                order = np.argsort(index, kind="stable")
                used, at = np.unique(index[order], return_index=True)
                held[p][used] += np.add.reduceat(weighted[order], at, axis=0)
        for p, book in enumerate(held):
            used = np.flatnonzero(book[:, 0])
            columns = [np.full(len(used), p), used, *book[used].T]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], schema.names)

    total = table.mapInArrow(sums, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    new = [book.copy() for book in entries]
    for r in total.collect():
        new[r["part"]][r["entry"]] = [r[c] // r["n"] for c in names]
    return Codebooks(tuple(new))


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[Codebooks, int] | None:
    """Codebooks of ``vectors`` (see :func:`integer_vectors`, as a written table) and the number of dimensions.

    The codebooks start with the parts of the smallest ids. Vectors must have as many components as the one with the
    smallest id; None if there is no vector that can be cut into equal parts.
    """
    smallest = vectors.orderBy(F.asc_nulls_last("_id"), "_v").limit(entries)
    dims = smallest.limit(1).select(F.size("_v")).first()
    if dims is None or dims[0] % parts:
        return None
    dims = dims[0]
    fitting = vectors.where(F.size("_v") == dims)
    first = np.array([r[0] for r in fitting.orderBy(F.asc_nulls_last("_id"), "_v").limit(entries).select("_v").collect()], np.int64)
    books = Codebooks(tuple(np.split(first, parts, axis=1)))
    table = distinct_parts(fitting, parts, dims)
    for _ in range(rounds):
        books = _round(table, books, dims // parts)
    release(table)
    return books, dims


def assign(vectors: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    """``_id, _label, _code`` (one byte, or two for larger codebooks, per part) and ``_error`` of the vectors with ``dims`` components."""
    parts, width = len(books.entries), dims // len(books.entries)
    kind = np.dtype(np.uint8 if len(books.entries[0]) <= 256 else ">u2")
    fitting = vectors.where(F.size("_v") == dims).select("_id", "_label", "_v")
    schema = T.StructType([*fitting.schema.fields[:2], T.StructField("_code", T.BinaryType()), T.StructField("_error", T.LongType())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("_v"), dims)
            code, error = np.empty((len(rows), parts), kind), np.zeros(len(rows), np.int64)
            for p in range(parts):
                index, least = _assigned(rows[:, p * width : (p + 1) * width], books.entries[p])
                code[:, p] = index
                error += least
            packed = [c.tobytes() for c in code]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(error)], schema.names)

    return fitting.mapInArrow(codes, schema)


def compress(
    df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, Codebooks]:
    """``_id, _label, _code, _error, _label_error`` of every usable vector, and the codebooks.

    Left out are vectors that are null or empty, hold a null, infinite or undefined component, or have another number
    of components than the vector with the smallest id (all, if that number cannot be cut into ``parts``). Ids and
    labels may be null and may repeat; null ids come last among the smallest, null labels are one group. Other columns
    of ``df`` are not read, so their names do not matter. ``_label_error`` is the sum of ``_error`` over the label.
    """
    vectors = materialize(integer_vectors(df, id_col, vector_col, label_col, scale), "vectors")
    trained = train(vectors, parts, entries, rounds)
    if trained is None:
        empty = vectors.select("_id", "_label", F.lit(None).cast("binary").alias("_code"), F.lit(0).cast("long").alias("_error"), F.lit(0).cast("long").alias("_label_error"))
        return empty.where("false"), Codebooks(())
    books, dims = trained
    coded = materialize(assign(vectors, books, dims), "codes")
    release(vectors)
    per_label = coded.groupBy("_label").agg(F.sum("_error").alias("_label_error"))
    return beside(coded, per_label, ["_label"]), books
