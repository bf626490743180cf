"""Sets of hashed word shingles, made in numpy inside the tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed odd multipliers: one for each place of a word in its shingle, one to finish, one for the places of a word's bytes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
FINISH = 0xFF51AFD7ED558CCD
RADIX = 0x2545F4914F6CDD1D


def _byte_values() -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower(), seed=5) for b in range(256)], np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX to 0 .. n - 1 and to their negatives, modulo 2^64."""
    inverse = pow(RADIX, -1, 1 << 64)
    out = []
    for r in (RADIX, inverse):
        p = np.full(n, r, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Shingler:
    """Distinct ``width``-word shingles of a text as a sorted array of 64-bit hashes.

    Words stand between ASCII white space, A-Z count as a-z. A text with fewer words is one shingle of all its
    words; without words it has none. A word's hash is a polynomial of its bytes' numbers, taken for all words at
    once as differences of running sums.
    """

    def __init__(self, width: int = 5) -> None:
        self.width, self.values = width, _byte_values()
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up, self.down = _powers(1 << 16)

    def word_hashes(self, text: str | None) -> np.ndarray:
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        n = len(b)
        if n > len(self.up):
            self.up, self.down = _powers(2 * n)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~self.space[b]
        turns = np.flatnonzero(np.diff(inside))
        starts, ends = turns[::2], turns[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[b] * self.up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(FINISH)
        return h ^ (h >> np.uint64(29))

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.word_hashes(text)
        if not len(h):
            return h
        if len(h) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
        n = len(h) - self.width + 1
        out = np.zeros(n, np.uint64)
        for k in range(self.width):
            part = h[k : k + n] * np.uint64(MULTIPLIERS[k % len(MULTIPLIERS)] + 2 * (k // len(MULTIPLIERS)))
            out = (out ^ (part ^ (part >> np.uint64(29)))) * np.uint64(FINISH)
        return np.unique(out ^ (out >> np.uint64(32)))
