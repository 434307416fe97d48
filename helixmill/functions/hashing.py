"""Words of a run of bases as numbers, and their seeded hashes, for a whole block of sequences at once.

Codes are A=0, C=1, T=2, G=3, two bits each; numbers are unsigned 64-bit.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: The five primes of XXH64 and the seed of the sketch format.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 1312
#: Fixed value: what counts as zero in a decycling set.
EPS = 1e-6

CODES = np.zeros(256, np.uint8)
CODES[[ord(c) for c in "ACTG"]] = range(4)
#: Whether a byte is a base.
KNOWN = np.isin(np.arange(256), [ord(c) for c in "ACTG"])


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def xxh64(x: np.ndarray) -> np.ndarray:
    """XXH64 (seed 1312) of the eight little-endian bytes of each number."""
    h = _rotated(x * U64(P2), 31) * U64(P1) ^ U64((SEED + P5 + 8) % 2**64)
    h = _rotated(h, 27) * U64(P1) + U64(P4)
    h = (h ^ (h >> U64(33))) * U64(P2)
    h = (h ^ (h >> U64(29))) * U64(P3)
    return h ^ (h >> U64(32))


def ordered(x: np.ndarray) -> np.ndarray:
    """Signed numbers in the order of the unsigned ones."""
    return (x ^ U64(1 << 63)).view(np.int64)


def decycling_class(x: np.ndarray, m: int) -> np.ndarray:
    """Class of each m-mer under a decycling set: 2 if its weighted sum of sines is
    positive and that of its rotation (last base first) isn't, 1 for the mirrored case, else 0."""
    sines = np.sin(2 * np.pi * np.arange(m) / m)
    digits = [(x >> U64(2 * (m - 1 - i)) & U64(3)).astype(np.float64) for i in range(m)]
    here = sum(s * d for s, d in zip(sines, digits))
    turned = sum(s * d for s, d in zip(sines, [digits[-1], *digits[:-1]]))
    return np.where((here > EPS) & (turned < EPS), 2, np.where((here < -EPS) & (turned > -EPS), 1, 0))


def by_class(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hashes of 62 bits below two bits for the class: 2, then 1, then 0."""
    return h & U64((1 << 62) - 1) | np.array([1 << 63, 1 << 62, 0], U64)[classes]


def words(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every word of ``size`` bases (32 at most) and its reverse complement, put together from halves."""
    ahead = back = None
    one, two, width, done, left = codes.astype(U64), (codes ^ 2).astype(U64), 1, 0, size
    n = len(codes) - size + 1
    while left:
        if left & 1:
            if ahead is None:
                ahead, back = one, two
            else:  # what is done, then a part of this width
                reach = len(one) - done
                ahead = (ahead[:reach] << U64(2 * width)) | one[done:]
                back = back[:reach] | (two[done:] << U64(2 * done))
            done += width
        left >>= 1
        if left:
            one = (one[:-width] << U64(2 * width)) | one[width:]
            two = two[:-width] | (two[width:] << U64(2 * width))
            width *= 2
    return ahead[:n], back[:n]


def least_at(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every run of ``width`` values, the leftmost of equals."""
    at, size = np.arange(len(x)), 1

    def pick(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    while 2 * size <= width:
        at = pick(at[:-size], at[size:])
        size *= 2
    return pick(at[: len(at) - (width - size)], at[width - size :]) if size < width else at
