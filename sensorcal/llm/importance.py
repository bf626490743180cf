"""Importance resampling towards a target distribution over hashed word features.

A pre-tokenizer of the tokenizers library, a regex split without any training, finds the words of ASCII-lowered texts
with their offsets. Features are the windows of one to three words, as pairs of offsets into the words joined by one
space; a window's CRC-32 follows from the CRCs of the two prefixes that end at its offsets, so all windows of a text are
hashed at once. Buckets of the hashes are counted over all documents and over the target texts; a bucket's gain says how
much more often the target has it, and a document's weight is the sum over its features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from itertools import accumulate, chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.ordering import global_row_number
from ..runtime import materialize

#: What stands between words: ASCII other than digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 3
SEED = 42
#: Blank-separated pieces of texts whose words a Python worker remembers; it starts anew when they are reached.
MEMORY = 500_000
#: Zero bytes that one step of :func:`_shifted` appends at most.
STEP = 255


@cache
def _splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(BETWEEN), "removed")


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_with_offsets(text: str) -> list[tuple[str, tuple[int, int]]]:
    """The words of a lowered text, each with its first character's place and the one after its last."""
    return _splitter().pre_tokenize_str(text) if text else []


@cache
def _shift_tables() -> np.ndarray:
    """``[n, i, v]``: what byte i of a CRC, if it is v, adds to the CRC after n more zero bytes."""
    byte = np.array([crc32(bytes([v])) ^ crc32(b"\0") for v in range(256)], np.uint32)
    tables = np.empty((STEP + 1, 4, 256), np.uint32)
    for i in range(4):
        tables[0, i] = np.arange(256, dtype=np.uint32) << (8 * i)
    for n in range(STEP):
        tables[n + 1] = (tables[n] >> 8) ^ byte[tables[n] & 255]
    return tables


def _shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What ``crc`` contributes after ``zeros`` more bytes: the CRC of a + b is this of a's, exclusive-or b's."""
    tables = _shift_tables()
    left = zeros.copy()
    while True:
        at = np.minimum(left, STEP) << 10
        crc = tables.take(at + (crc & 255)) ^ tables.take(at + 256 + (crc >> 8 & 255)) ^ tables.take(at + 512 + (crc >> 16 & 255)) ^ tables.take(at + 768 + (crc >> 24))
        left -= STEP
        if not (left > 0).any():
            return crc
        left = np.maximum(left, 0)


def window_hashes(words: Sequence[bytes], longest: int = LONGEST) -> np.ndarray:
    """CRC-32 of all windows of 1 to ``longest`` words joined by one space, repeats included; ``words`` bring a space in front."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n))
    starts = np.concatenate([[0], ends[:-1]]) + 1
    # CRCs of the joined words up to each word's end, and one space further than the end before.
    until = np.fromiter(accumulate(words, lambda crc, w: crc32(w, crc), initial=0), np.uint32, n + 1)
    before = _shifted(until[:-1], np.ones(n, np.int64)) ^ np.uint32(crc32(b" "))
    return np.concatenate([until[k + 1 :] ^ _shifted(before[: n - k], ends[k:] - starts[: n - k]) for k in range(min(longest, n))])


class _Words:
    """Words of blank-separated pieces of lowered texts, remembered, each with a space in front. Blanks part words, so pieces can be split alone."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[bytes, ...]] = {}

    def of(self, text: str) -> list[bytes]:
        pieces = ascii_lower(text).split(" ")
        if len(self.known) > MEMORY:
            self.known = {}
        new = list(set(pieces).difference(self.known))
        if new:
            # All new pieces are one text to the splitter; a word belongs to the piece that its offset lies in.
            joined, found = " ".join(new), [[] for _ in new]
            starts = np.cumsum([0] + [len(p) + 1 for p in new])
            words = words_with_offsets(joined)
            at = np.searchsorted(starts, np.array([o[0] for _, o in words], np.int64), "right") - 1
            for k, (_, (a, b)) in zip(at.tolist(), words):
                found[k].append(b" " + joined[a:b].encode("utf-8", "surrogatepass"))
            self.known.update(zip(new, map(tuple, found)))
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))


@cache
def _words() -> _Words:
    return _Words()


def text_buckets(text: str | None, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """Number of words and the bucket of every feature."""
    words = _words().of(text) if text else []
    return len(words), window_hashes(words, longest) % np.uint32(buckets)


def bucketed(df: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``_id, _words, _features`` and ``_buckets``, the features' buckets as unsigned little-endian integers, 16 bits each (32 beyond 65,536 buckets)."""
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = _kind(buckets)
    schema = T.StructType([rows.schema["_id"], *(T.StructField(c, t) for c, t in (("_words", T.LongType()), ("_features", T.LongType()), ("_buckets", T.BinaryType())))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_buckets(t.as_py(), buckets, longest) for t in batch.column(1)]
            raw = [b.astype(kind).tobytes() for _, b in found]
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return rows.mapInArrow(hashed, schema)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of :func:`bucketed`: one histogram per task, summed; as many rows come back as there are buckets."""
    kind = _kind(buckets)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("_buckets").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 · ln of the smoothed share in the target over that in the source) per bucket."""
    top = (target + 1).astype(float) * float(source.sum() + len(source))
    return np.floor(1000 * np.log(top / ((source + 1).astype(float) * float(target.sum() + len(target))))).astype(np.int64)


def weighed(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """``_id, _words, _features`` and ``_weight``, the sum of the gains of a row's features."""
    kind = _kind(len(gains))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("_weight", T.LongType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gains[np.frombuffer(raw.as_buffer(), kind)].sum()) for raw in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], schema.names)

    return rows.mapInArrow(summed, schema)


def gumbel_noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(1000 · a Gumbel variable) that depends on the seed and the id only; a null id counts as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str,
    text_col: str,
    target_text_col: str,
    percent: int = 5,
    least_words: int = 20,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
) -> DataFrame:
    """``_id, _words, _features, _weight, _score`` of every row of ``docs`` and ``_rank`` of the rows drawn.

    Of the N rows with at least ``least_words`` words, floor(percent · N / 100) are drawn: the highest scores (weight
    plus noise), ties to the smaller id, a null id last; equal rows take one rank each. A null text has no words. Other
    columns of both tables are not read, so their names do not matter; an empty target makes gains that only reflect
    how common a bucket is.
    """
    hashed = materialize(bucketed(docs, id_col, text_col, buckets, longest), "buckets")
    gains = bucket_gains(bucket_counts(hashed, buckets), bucket_counts(bucketed(target.withColumn("_none", F.lit(0)), "_none", target_text_col, buckets, longest), buckets))
    scored = materialize(weighed(hashed, gains).withColumn("_score", F.col("_weight") + gumbel_noise(F.col("_id"), seed)), "scores")
    drawn = F.floor(F.lit(percent) * F.col("_at_total") / 100)
    able = scored.where(F.col("_words") >= least_words)
    ranked = global_row_number(able, [F.desc("_score"), F.asc_nulls_last("_id")], "_at")
    ranked = ranked.select(*scored.columns, F.when(F.col("_at") <= drawn, F.col("_at")).cast("long").alias("_rank"))
    return ranked.unionByName(scored.where(F.col("_words") < least_words).withColumn("_rank", F.lit(None).cast("long")))
