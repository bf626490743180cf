"""Encoding and decoding with a SentencePiece vocabulary of the merge type, by a score-ordered agenda of adjacent pairs.

A text starts as its characters. The agenda holds the adjacent pairs whose concatenation is a piece; the pair with the
highest score is merged (the leftmost one on ties), which puts at most two new pairs on the agenda, until none is left.
Characters that are no piece then become bytes.

Merges never cross two neighbouring characters that no piece holds side by side, so a text is cut there first: into
chunks, mostly words, that repeat. A worker remembers the ids of chunks. New chunks of an Arrow batch are merged
together, one step of every chunk's agenda at a time, and held against the sentencepiece library before they are used.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SPACE = "▁"
#: Chunks a Python worker remembers; it starts anew when they are reached.
MEMORY = 500_000
#: Chunks with more characters than this are merged one by one, with a heap.
LONG = 64
#: Characters of texts that are cut into chunks at a time.
AT_ONCE = 2_000_000
#: What an agenda holds for a pair that is no piece.
NEVER = np.iinfo(np.int32).max


def _one_by_one(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("each-byte", _one_by_one)


def piece_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary lies on this machine (each executor has its own installation)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A vocabulary: merge table, encoder and decoder.

    Only vocabularies of the merge type are taken that fall back to bytes, leave texts unchanged but for blanks, put one
    blank before a text, and hold no user-defined or unused pieces; others are refused with a ``ValueError``.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("not a merge vocabulary with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("a vocabulary that changes texts before encoding")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined or unused pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        own = {p.piece.replace(SPACE, " "): (i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.controls = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        unknown = (model.trainer_spec.unk_surface or " ⁇ ").encode()
        self.surface = [
            b"" if p.type == kinds.CONTROL
            else unknown if p.type == kinds.UNKNOWN
            else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE
            else p.piece.replace(SPACE, " ").encode()
            for p in model.pieces
        ]
        self.opens_blank = {i for p, (i, _) in own.items() if p.startswith(" ")}

        # Symbols: the pieces by id, then characters of longer pieces that are no piece themselves.
        self.inner = sorted({c for p in own if len(p) > 1 for c in p})
        self.symbol = {p: i for p, (i, _) in own.items()}
        for c in self.inner:
            self.symbol.setdefault(c, len(model.pieces) + len(self.symbol))
        self.bytes_of = [byte[b] for b in range(256)]
        score_rank = {s: r for r, s in enumerate(sorted({s for _, s in own.values()}, reverse=True))}
        self.wide = 1 + max(self.symbol.values())
        merges = {}
        for p, (i, score) in own.items():
            for k in range(1, len(p)):
                left, right = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if left is not None and right is not None:
                    merges[left * self.wide + right] = (score_rank[score], i)
        self.keys = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([merges[k][1] for k in self.keys.tolist()], np.int64)
        self.merges = merges
        self.chunk = re.compile(self._chunks([p for p in own if len(p) > 1]), re.S)
        self.separator = next(c for c in ("\n", "\t", "", "") if c not in self.inner)
        self._forget()

    def _chunks(self, longer: Sequence[str]) -> str:
        """Pattern of chunks: cuts only where no piece holds the two characters side by side."""
        pairs = {(a, b) for p in longer for a, b in zip(p, p[1:])}
        letters = [c for c in self.inner if c.isalpha()]
        others = [c for c in self.inner if not c.isalpha() and c != " "]
        kind = lambda chars: "[" + "".join(map(re.escape, chars)) + "]" if chars else r"[^\s\S]"
        if any(b == " " and a != " " for a, b in pairs):
            return f"{kind(self.inner)}+|."
        if any(a.isalpha() and not b.isalpha() for a, b in pairs):
            return f" *{kind(letters + others)}+| +|."
        return f" *{kind(others)}*{kind(letters)}+| *{kind(others)}+| +|."

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place on the agenda and the merged symbol of pairs; ``NEVER`` where they make no piece."""
        key = left * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NEVER), self.merged[at]

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The agenda as a heap over one chain of symbols; a negative symbol takes part in no merge."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def put(i: int) -> None:
            j = after[i]
            if j < len(symbols) and symbols[i] >= 0 <= symbols[j]:
                found = self.merges.get(symbols[i] * self.wide + symbols[j])
                if found:
                    heapq.heappush(agenda, (found[0], i, symbols[i], symbols[j], found[1]))

        gone = [False] * len(symbols)
        for i in range(len(symbols)):
            put(i)
        while agenda:
            _, i, left, right, merged = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or j >= len(symbols) or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], gone[j], after[i] = merged, True, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [s for s, g in zip(symbols, gone) if not g]

    def merge_many(self, symbols: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`merge_one` for many short chains at once: each round merges the first entry of every chain's agenda.

        ``symbols`` stand in order of ``chain``, which numbers the chains; the same comes back, merged.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, merged = self._rank(symbols[:-1], symbols[1:])
        rank[chain[:-1] != chain[1:]] = NEVER
        rank, merged = np.append(rank, NEVER), np.append(merged, -1)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
            size = np.diff(np.append(starts, len(chain)))
            best = np.minimum.reduceat(rank, starts)
            going = best != NEVER
            if not going.all():
                keep = np.repeat(going, size)
                done.append((symbols[~keep], chain[~keep]))
                symbols, chain, rank, merged = symbols[keep], chain[keep], rank[keep], merged[keep]
                size, best = size[going], best[going]
                if not len(symbols):
                    break
            # The leftmost pair with the best rank of its chain; every chain left has one.
            hits = np.flatnonzero(rank == np.repeat(best, size))
            at = hits[np.append(True, chain[hits[1:]] != chain[hits[:-1]])]
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, chain, rank, merged = symbols[keep], chain[keep], rank[keep], merged[keep]
            # One symbol has gone for each chain before. Only the pairs that the merged symbol is part of are new.
            at = at - np.arange(len(at))
            changed = np.concatenate([at[at > 0] - 1, at[at < len(symbols) - 1]])
            rank[-1] = NEVER
            new, into = self._rank(symbols[changed], symbols[changed + 1])
            new[chain[changed] != chain[changed + 1]] = NEVER
            rank[changed], merged[changed] = new, into
        if not done:
            return symbols, chain
        symbols, chain = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(chain, kind="stable")
        return symbols[order], chain[order]

    def _ids(self, chunk: str, symbols: Sequence[int]) -> list[int]:
        """Symbols that are pieces as they are; other characters as their bytes."""
        out, at = [], 0
        for s in symbols:
            n = len(self.surface[s].decode()) if 0 <= s < len(self.surface) else 1
            out += [s] if 0 <= s < len(self.surface) else [self.bytes_of[b] for b in chunk[at : at + n].encode()]
            at += n
        return out

    def learn(self, chunks: Sequence[str], check: bool = True) -> None:
        """Ids of new chunks; with ``check`` the library has to give the same."""
        get = self.symbol.get
        short = [c for c in chunks if len(c) <= LONG]
        text = "".join(short)
        lengths = np.fromiter(map(len, short), np.int64, len(short))
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        each, where = np.unique(code, return_inverse=True)
        symbols = np.array([get(chr(c), -1) for c in each.tolist()], np.int64)[where] if len(each) else np.zeros(0, np.int64)
        symbols, chain = self.merge_many(symbols, np.repeat(np.arange(len(short)), lengths))
        strange = set(chain[(symbols < 0) | (symbols >= len(self.surface))].tolist())
        raw = symbols.astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(chain, minlength=len(short)))).tolist()
        found = [raw[a:b] for a, b in zip([0, *ends], ends)]
        for k in strange:
            found[k] = np.array(self._ids(short[k], np.frombuffer(found[k], "<i4").tolist()), "<i4").tobytes()
        for c in chunks:
            if len(c) > LONG:
                short.append(c)
                found.append(np.array(self._ids(c, self.merge_one([get(x, -1) for x in c])), "<i4").tobytes())
        if check:
            self._check(short, found)
        self.known.update(zip(short, found))

    def _check(self, chunks: Sequence[str], found: Sequence[bytes], most: int = 20_000) -> None:
        """Chunks between separators, which no piece joins, are one text to the library."""
        apart = np.array(self._ids(self.separator, [self.symbol.get(self.separator, -1)]), "<i4").tobytes()
        blank = np.array([self.symbol[" "]], "<i4").tobytes()
        start, size = 0, 0
        for k, c in enumerate(chunks):
            size += len(c) + 1
            if size <= most and k < len(chunks) - 1:
                continue
            text = self.separator + self.separator.join(chunks[start : k + 1])
            if np.array(self.library.encode(text), "<i4").tobytes() != blank + apart + apart.join(found[start : k + 1]):
                raise ValueError(f"ids differ from the library's among {chunks[start : k + 1]!r:.2000}")
            start, size = k + 1, 0

    def encode(self, texts: Sequence[str | None], check: bool = True) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; none for a missing or empty text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            cut = [self.chunk.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts[at:end]]
            if len(self.known) > MEMORY:
                self._forget()
            new = set().union(*cut).difference(self.known)
            if new:
                self.learn(list(new), check)
            known = self.known
            out += [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
            at = end
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids, as the library gives it: one blank at the start goes, bytes that are no text are
        replaced one by one, and a control piece parts the bytes around it."""
        surface, runs = self.surface, [[]]
        for i in ids if self.controls.intersection(ids) else ():
            runs.append([]) if i in self.controls else runs[-1].append(i)
        runs = [r for r in runs if r] or [ids]
        raw = [b"".join(map(surface.__getitem__, r)) for r in runs]
        if len(runs[0]) and runs[0][0] in self.opens_blank:
            raw[0] = raw[0][1:]
        return "".join(r.decode("utf-8", "each-byte") for r in raw)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _lists(raw: Sequence[bytes]) -> pa.Array:
    offsets = np.zeros(len(raw) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in raw], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode_pieces(text: Column, name: str = "piece_bpe_32k.model", check: bool = True) -> Column:
    """Ids of whole texts as ``array<int>``; a null or empty text has none. No begin or end ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _lists(pieces(piece_path(name)).encode(texts.to_pylist(), check))

    return encode(text)


def decode_pieces(ids: Column, name: str = "piece_bpe_32k.model") -> Column:
    """The text of ``array<int>``; null and empty arrays give an empty text."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        vocabulary = pieces(piece_path(name))
        return pa.array([vocabulary.decode(i or ()) for i in lists.to_pylist()], pa.string())

    return decode(ids)


def round_trip(text: Column, name: str = "piece_bpe_32k.model", check: bool = True) -> Column:
    """``struct<ids, decoded>``: a text's ids and the text that they decode to, in one pass."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(texts: pa.Array) -> pa.Array:
        vocabulary = pieces(piece_path(name))
        raw = vocabulary.encode(texts.to_pylist(), check)
        decoded = [vocabulary.decode(np.frombuffer(r, "<i4").tolist()) for r in raw]
        return pa.StructArray.from_arrays([_lists(raw), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return both(text)
