"""Token ids of texts with the word tokenizer, inside tasks."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a Python worker remembers, at most; it starts anew when they are reached.
MEMORY = 1_200_000
#: Bytes of text that are cut into pieces at a time, about.
SLICE = 8 << 20
#: A line of its own: a word of Latin letters that normalization leaves as they are but for the case, and perhaps a run of
#: ASCII symbols (but an apostrophe), which is one word to the tokenizer; or anything else.
_PIECES = re.compile(r"^(?:([a-zA-ZÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)|.+)$", re.M)


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit integers.

    The tokenizer never joins characters across a blank or a newline and has no state, so the ids of a text are those of its
    blank-separated pieces in order. Pieces are encoded once and remembered; a worker keeps them between tasks. New plain
    words are encoded many at a time: each is one word to the tokenizer, and the last id of a word is marked in the vocabulary.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # For plain words in lower case only: there is nothing left to normalize, and blanks alone part them.
        self.lower_words = Tokenizer.from_file(path)
        self.lower_words.normalizer = None
        self.lower_words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self._each([".", ","])

    def _each(self, pieces: list[str]) -> None:
        for piece, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            self.known[piece] = np.array(e.ids, "<u4").tobytes()

    def _plain(self, words: list[str]) -> None:
        for k in range(0, len(words), 200):
            part = words[k : k + 200]
            ids = np.array(self.lower_words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) != len(part):
                self._each(part)
                continue
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def learn(self, pieces: list[str]) -> None:
        """Pieces have no newline and are not empty."""
        known, other, composed, words = self.known, [], [], set()
        for piece, (word, tail) in zip(pieces, _PIECES.findall("\n".join(pieces))):
            if word:
                low = word.lower()
                words.add(low)
                if low != piece:
                    composed.append((piece, low, tail))
            else:
                other.append(piece)
        self._plain(list(words.difference(known)))
        self._each(list({tail for _, _, tail in composed}.difference(known)))
        for piece, low, tail in composed:
            known[piece] = known[low] + known[tail]
        self._each(other)

    def encode(self, text: str | None) -> bytes:
        pieces = (text or "").replace("\n", " ").split(" ")
        if len(self.known) > MEMORY:
            self._forget()
        known = self.known
        new = set(pieces).difference(known)
        if new:
            self.learn(list(new))
        return b"".join(map(known.__getitem__, pieces))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's; as :meth:`encode`, but each piece is looked up once."""
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        pieces = lists.flatten().dictionary_encode()
        words = pieces.dictionary.to_pylist()
        if len(self.known) > MEMORY:
            self._forget()
        each = list(map(self.known.get, words))
        new = [i for i, found in enumerate(each) if found is None]
        if new:
            self.learn([words[i] for i in new])
            for i in new:
                each[i] = self.known[words[i]]
        ids = np.frombuffer(b"".join(each), "<u4")
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        at, which = np.cumsum(sizes) - sizes, pieces.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        found = ids[np.repeat(at[which] - (ends - n), n) + np.arange(total)]
        offsets = lists.offsets.to_numpy()
        return found, np.diff(np.concatenate([[0], ends])[offsets - offsets[0]])


def slices(texts: pa.Array, size: int = SLICE) -> list[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text each."""
    if not len(texts):
        return []
    bytes_before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = (np.flatnonzero(np.diff(bytes_before // size)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(texts)]))


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)
