"""Token ids in a compact binary file format: canonical Huffman codes of limited length.

The ids of all documents are counted, and one code is made from the global counts: lengths by package-merge, at most
``MAX_BITS``, codes canonical (by length, then id), so the code book is the list of lengths alone. Documents in
ascending order of id are joined into blocks. A block is a self-contained binary value:

    "HUF1", number of documents, of ids, of checkpoints       16 bytes, little-endian unsigned 32-bit
    ids of each document                                      32-bit each
    bit offset of each checkpoint, one for every 256 ids      32-bit each
    the codes, most significant bit first                     padded to a byte

A reader of a block starts at all checkpoints at once and looks 2^MAX_BITS-entry tables up for the next id and its
length. The format's folder has two tables: ``codebook`` (id, bits) and ``blocks`` (file, block, doc_ids, payload), in
Parquet so that any store Spark writes to will do and lost tasks are written again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..runtime import materialize, release, scratch_path
from .common import tokens_path
from .tokens import slices, word_ids

MAX_BITS = 16
END_ID = 2
#: Ids in a block, about: a block ends with the document that reaches them.
BLOCK_IDS = 1 << 19
CHECKPOINT = 256
MAGIC = b"HUF1"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol (0 where the count is 0): the best prefix code with at most ``limit`` bits, by package-merge."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    if len(used) < 2:
        bits[used] = 1
        return bits
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(float)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        order = np.argsort(items, kind="stable")
        levels.append(order < len(leaves))
        items = items[order]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        bits[used[:n]] += 1
        take = 2 * (take - n)
    return bits


class Code(NamedTuple):
    bits: np.ndarray
    codes: np.ndarray
    symbol_at: np.ndarray
    bits_at: np.ndarray


def canonical(bits: np.ndarray, limit: int = MAX_BITS) -> Code:
    """Codes in order of (length, symbol), and the symbol and length for each possible next ``limit`` bits."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    spans = 1 << (limit - bits[order].astype(np.int64))
    starts = np.cumsum(spans) - spans
    codes = np.zeros(len(bits), np.uint32)
    codes[order] = starts >> (limit - bits[order].astype(np.int64))
    symbol_at, bits_at = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    filled = int(spans.sum())
    symbol_at[:filled] = np.repeat(order, spans)
    bits_at[:filled] = np.repeat(bits[order], spans)
    return Code(bits, codes, symbol_at, bits_at)


def encode_block(code: Code, docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs)
    n = code.bits[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    # Each code is put at its place in two 32-bit words from the one it starts in. Codes share no bits, so sums of
    # their parts are exact.
    word = starts >> 5
    placed = code.codes[ids].astype(np.uint64) << (64 - n - (starts & 31)).astype(np.uint64)
    size = (int(ends[-1]) + 31 >> 5) + 1
    stream = np.bincount(word, weights=placed >> np.uint64(32), minlength=size)
    stream[1:] += np.bincount(word, weights=placed & np.uint64(0xFFFFFFFF), minlength=size - 1)[: size - 1]
    body = stream.astype(">u4").tobytes()[: int(ends[-1]) + 7 >> 3]
    points = starts[::CHECKPOINT].astype("<u4")
    head = MAGIC + np.array([len(docs), len(ids), len(points)], "<u4").tobytes()
    return head + np.array([len(d) for d in docs], "<u4").tobytes() + points.tobytes() + body


def decode_block(code: Code, block: bytes, limit: int = MAX_BITS) -> list[np.ndarray]:
    """The ids of each document of the block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of ids")
    n_docs, n_ids, n_points = np.frombuffer(block, "<u4", 3, 4).tolist()
    sizes = np.frombuffer(block, "<u4", n_docs, 16).astype(np.int64)
    at = np.frombuffer(block, "<u4", n_points, 16 + 4 * n_docs).astype(np.int64)
    data = np.concatenate([np.frombuffer(block, np.uint8, offset=16 + 4 * (n_docs + n_points)), np.zeros(4, np.uint8)]).astype(np.uint32)
    # 24 bits from each byte on hold any code whatever bit it starts at (7 + 16 bits).
    ahead = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    out = np.zeros((CHECKPOINT, n_points), np.uint32)
    last = n_ids - (n_points - 1) * CHECKPOINT
    for k in range(CHECKPOINT if n_points > 1 else last):
        if k == last:
            at = at[:-1]
        look = (ahead[at >> 3] >> (24 - limit - (at & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[k, : len(at)] = code.symbol_at[look]
        at = at + code.bits_at[look]
    return np.split(out.T.reshape(-1)[:n_ids], np.cumsum(sizes)[:-1])


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n, ids) from (doc_id, text): ids as unsigned 16-bit integers where they fit, else 32-bit; each document ends with id 2."""
    path = path or tokens_path()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_ids(path)
        kind = "<u2" if tokens.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for a, b in slices(batch["text"]):
                own, n = tokens.encode_all(batch["text"].slice(a, b - a))
                ends = np.cumsum(n + 1)
                all_ids = np.full(len(own) + len(n), END_ID, kind)
                inside = np.ones(len(all_ids), bool)
                inside[ends - 1] = False
                all_ids[inside] = own
                offsets = (np.concatenate([[0], ends]) * all_ids.itemsize).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(all_ids)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(n + 1, pa.int64()), binary], ["doc_id", "n", "ids"])

    return docs.mapInArrow(ids, "doc_id long, n long, ids binary")


def _array(n: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def write_ids(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> None:
    """Tokenizes ``docs`` and writes the format to ``folder`` in ascending order of ``doc_id``, nulls first."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ids = materialize(tokenize(own, path), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for a, b in slices(batch["ids"]):
                n = int(np.sum(batch["n"].slice(a, b - a).to_numpy()))
                c = np.bincount(_array(n, b"".join(batch["ids"].slice(a, b - a).to_pylist())), minlength=len(total))
                c[: len(total)] += total
                total = c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "count"])

    # One row per id of the vocabulary reaches the driver, whatever the corpus.
    counts = ids.select("n", "ids").mapInArrow(count, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    table = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    table[counts["id"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    bits = code_lengths(table)
    book = pd.DataFrame({"id": np.flatnonzero(bits), "bits": bits[bits > 0]}).astype("int32")
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, held, names, size, at = canonical(bits), [], [], 0, 0
        for batch in batches:
            for name, n, b, file in zip(batch["doc_id"].astype("Int64"), batch["n"], batch["ids"], batch["file"]):
                held.append(_array(n, b))
                names.append(None if name is pd.NA else int(name))
                size += n
                if size >= BLOCK_IDS:
                    yield pd.DataFrame({"file": [file], "block": [at], "doc_ids": [names], "payload": [encode_block(code, held)]})
                    held, names, size, at = [], [], 0, at + 1
        if held:
            yield pd.DataFrame({"file": [file], "block": [at], "doc_ids": [names], "payload": [encode_block(code, held)]})

    ordered = ids.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids").withColumn("file", F.spark_partition_id())
    coded = ordered.mapInPandas(blocks, "file int, block int, doc_ids array<long>, payload binary")
    # Parquet would only try in vain to compress the codes once more.
    coded.write.option("compression", "none").parquet(f"{folder}/blocks")
    release(ids)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; ``start`` counts the ids of all documents before it."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    bits = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    bits[book["id"].to_numpy()] = book["bits"].to_numpy()
    blocks = spark.read.parquet(f"{folder}/blocks")
    # The heads tell the ids of a block; a window over one row per block of a file, and one over one row per file.
    head = F.hex(F.substring("payload", 9, 4))
    n_ids = sum(F.conv(F.substring(head, 1 + 2 * k, 2), 16, 10).cast("long") * (1 << 8 * k) for k in range(4))
    sizes = blocks.select("file", "block", n_ids.alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = sizes.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select(F.col("file"), before(Window.orderBy("file")).alias("in_files"))
    inside = sizes.withColumn("in_blocks", before(Window.partitionBy("file").orderBy("block")))
    starts = inside.join(files, "file").select(F.col("file").alias("f"), F.col("block").alias("b"), (F.col("in_files") + F.col("in_blocks")).alias("block_start"))
    # Written first: Spark sees its size and doesn't move the blocks if it is small.
    starts = materialize(starts, "starts")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = canonical(bits)
        for batch in batches:
            for names, payload, start in zip(batch["doc_ids"], batch["payload"], batch["block_start"]):
                docs = decode_block(code, payload)
                sizes = np.array([len(d) for d in docs])
                names = pd.array([None if x is None or x != x else int(x) for x in names], "Int64")
                yield pd.DataFrame({"doc_id": names, "start": start + np.cumsum(sizes) - sizes, "ids": [d.astype("<u4").tobytes() for d in docs]})

    met = blocks.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return met.select("doc_ids", "payload", "block_start").mapInPandas(decode, "doc_id long, start long, ids binary")


def ids_round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all rows of ``docs``, written to the shared folder and read back.

    A null or empty text has the closing id only. Rows of equal ``doc_id`` stand in the order of their ids, repeated rows
    each by itself; null ids come first and stay null. An empty table gives an empty table.
    """
    folder = scratch_path(docs.sparkSession, "huffman")
    write_ids(docs, folder)
    return read_ids(docs.sparkSession, folder)

