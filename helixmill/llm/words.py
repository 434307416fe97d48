"""Vectorised hashing of the words of one text, for use inside Spark tasks.

Words are maximal runs of characters other than the six ASCII white-space
characters (``[^\\x20\\x09-\\x0D]+``), unchanged.  All hashes are 64 bits wide,
depend on content only, and are computed with numpy over the UTF-8 bytes of one
text; there is no loop over words in Python.

Null and empty texts have no words.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd multipliers, so that their powers have inverses modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as texts need them."""

    def __init__(self, base: int):
        self.base = base
        self.inverse = pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 15)
            self.up = self._table(self.base, size)
            self.down = self._table(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, U64)
        factors[0] = 1
        return np.cumprod(factors, dtype=U64)


_BYTES = _Powers(BYTE_BASE)
_WORDS = _Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def encode(text: str | None) -> bytes:
    """UTF-8 bytes of a text; a null is empty."""
    return b"" if not text else text.encode("utf-8", "surrogatepass")


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text start and end."""
    b = np.frombuffer(data, np.uint8)
    word = (b != 32) & ((b < 9) | (b > 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a text, in order."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.empty(0, U64)
    up, down = _BYTES.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(0xA24BAED4963EE407)))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words; none for shorter texts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = _WORDS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each span ``[start, end)`` of words."""
    up, down = _WORDS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(U64))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of word shingles; a shorter text that has words is one shingle."""
    if 0 < len(words) < width:
        return window_hashes(words, len(words))
    return np.unique(window_hashes(words, width))
