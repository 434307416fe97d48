"""Chains of the k-mers of one minimizer, found on arrays of many (sketch, minimizer) groups at once.

The same links and chains as over rows (see :mod:`.superkmers`), for k-mers that are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.params import SketchParams

U64 = np.uint64
LETTERS = np.frombuffer(b"ACTG", np.uint8)
#: Rank of each base's code among neighbours that are tried: A, T, C, G.
RANK = np.array([0, 2, 1, 3], U64)
#: k-mers that are worked on at once, but for a larger group.
ROWS = 1 << 18
COLUMNS = ("sketch_id", "minimizer", "kmer")


def reverse_complement(x: np.ndarray, k: int) -> np.ndarray:
    turned = np.zeros_like(x)
    for i in range(k):
        turned = turned << U64(2) | (x >> U64(2 * i) & U64(3) ^ U64(2))
    return turned


def _leftmost(x: np.ndarray, own: np.ndarray, p: SketchParams) -> np.ndarray:
    """Leftmost place of each word's own m-mer; ``p.window`` if it has none."""
    at, mask = np.full(len(x), p.window), U64(4**p.m - 1)
    for i in range(p.window - 1, -1, -1):
        at[x >> U64(2 * (p.k - p.m - i)) & mask == own] = i
    return at


def placed(minimizer: np.ndarray, kmer: np.ndarray, p: SketchParams) -> tuple[np.ndarray, np.ndarray]:
    """k-mers read so that their minimizer is in its canonical form, and its leftmost place."""
    own, ahead = minimizer.view(U64), kmer.view(U64)
    back = reverse_complement(ahead, p.k)
    at = _leftmost(ahead, own, p)
    forward = at < p.window
    return np.where(forward, ahead, back), np.where(forward, at, _leftmost(back, own, p))


def followers(group: np.ndarray, x: np.ndarray, at: np.ndarray, p: SketchParams) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of k-mers (their rows) of which one follows the other."""
    k = p.k
    before, behind = np.flatnonzero(at > 0), np.flatnonzero(at < p.window - 1)
    row = np.concatenate((before, behind))
    spot = np.concatenate((at[before], at[behind] + 1)) + group[row] * 64
    # The overlap, then the side, then the rank of the base beyond it: 63 bits at most.
    left = (x[before] & U64(4 ** (k - 1) - 1)) << U64(3) | RANK[x[before] >> U64(2 * (k - 1))]
    right = (x[behind] >> U64(2)) << U64(3) | U64(4) | RANK[x[behind] & U64(3)]
    key = np.concatenate((left, right))
    order = np.lexsort((key, spot))
    row, spot, key = row[order], spot[order], key[order]
    overlap, is_behind = key >> U64(3), (key & U64(4)) > 0
    first = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (overlap[1:] != overlap[:-1])))) if len(row) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(row)))
    n_behind = np.add.reduceat(is_behind.astype(np.int64), first) if len(first) else sizes
    n_before = sizes - n_behind
    inside = np.arange(len(row)) - np.repeat(first, sizes)
    chosen = np.flatnonzero(inside < np.repeat(np.minimum(n_before, n_behind), sizes))
    return row[chosen], row[chosen + np.repeat(n_before, sizes)[chosen]]


def _texts(x: np.ndarray, k: int) -> np.ndarray:
    shifts = np.arange(2 * (k - 1), -1, -2).astype(U64)
    return LETTERS[(x[:, None] >> shifts & U64(3)).astype(np.uint8)]


def chained(sketch_id: np.ndarray, minimizer: np.ndarray, kmer: np.ndarray, p: SketchParams) -> pa.RecordBatch:
    """Super-k-mers of whole groups, which are sorted by sketch and minimizer."""
    new = (sketch_id[1:] != sketch_id[:-1]) | (minimizer[1:] != minimizer[:-1])
    group = np.concatenate(([0], np.cumsum(new)))
    x, at = placed(minimizer, kmer, p)
    one, after = followers(group, x, at, p)
    head = np.arange(len(x))
    head[after] = one
    while (further := head[head] != head).any():
        head = np.where(further, head[head], head)
    order = np.lexsort((-at, head))
    head = head[order]
    first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    sizes = np.diff(np.append(first, len(head)))
    # The head's bases, then the last base of each other member.
    lengths = sizes + (p.k - 1)
    ends = np.cumsum(lengths)
    letters = np.empty(ends[-1], np.uint8)
    begin = ends - lengths
    letters[begin[:, None] + np.arange(p.k)] = _texts(x[head[first]], p.k)
    chain = np.repeat(np.arange(len(first)), sizes)
    inside = np.arange(len(head)) - first[chain]
    letters[begin[chain] + inside + p.k - 1] = LETTERS[(x[order] & U64(3)).astype(np.uint8)]
    seq = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(letters))
    heads = head[first]
    return pa.RecordBatch.from_arrays([pa.array(sketch_id[heads]), pa.array(minimizer[heads]), seq, pa.array(sizes)], ["sketch_id", "minimizer", "seq", "n_kmers"])


def on_groups(batches: Iterator[pa.RecordBatch], p: SketchParams) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of rows that are sorted by sketch and minimizer; a group may go over several batches."""
    held: list[list[np.ndarray]] = []
    size = 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held)]

    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(c).to_numpy() for c in COLUMNS])
        size += b.num_rows
        if size >= ROWS:
            columns = joined()
            # The last group may go on.
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield chained(*(c[:whole] for c in columns), p)
            held, size = [[c[whole:] for c in columns]], 0
    if held and len(held[0][0]):
        yield chained(*joined(), p)
