"""Vectorised words, lines and hashes of a group of documents.

A word is a run of bytes other than space and 09 to 0D (all single bytes in UTF-8).
Hashes are 64-bit polynomials of the bytes, taken from prefix sums and mixed.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U64 = np.uint64
_ODD, _ODD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (multiply and shift twice)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(1 << bits, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(_ODD), series(_ODD_INVERSE)


class Prefix:
    """Hashes of any byte range of one buffer."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(max(1, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


class Documents:
    """Words of documents joined with line feeds: ``start``, ``end``, ``hash`` and ``doc`` per word.

    ``first[d]`` is the index of the first word of document d, ``begin[d]`` its first byte.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.begin = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.finish = self.begin[:-1] + lengths
        inside = ~IS_SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.prefix = Prefix(self.data)
        self.hash = self.prefix.of(self.start, self.end)
        self.first = np.searchsorted(self.start, self.begin)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each document."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.finish] - sums[self.begin[:-1]]
