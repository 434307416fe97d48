"""Length buckets with least padding, and token-budget batches inside them.

The global histogram of lengths is one aggregation.  Dynamic programming over
it chooses the bucket boundaries that minimise padding; a batch then holds as
many documents as its budget allows at the bucket's padded length.

The histogram has a row for each length that occurs.  Different lengths up to
L need texts of L^2 / 2 tokens in all, so it grows at most with the square root
of the corpus.  The boundaries are optimal over all choices of lengths: the cost
of a bucket obeys the quadrangle inequality, so the best last bucket's start
never moves back, and a divide and conquer finds it in n log n steps a bucket.

Null and empty texts have length 0 and are packed like others (padded to one
token at least).  A document longer than the budget is a batch by itself; none
is cut or dropped.  Repeated rows are separate members.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import constant, cut, texts


@dataclass(frozen=True)
class PackParams:
    buckets: int = 16
    token_budget: int = 16_384
    #: Rows aimed at for each piece of a bucket that is numbered by one task.
    rows_per_piece: int = 50_000
    max_pieces: int = 4096


def word_count(text: Column) -> Column:
    """Words between ASCII white space, as a length that needs no model."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def _layer(before: np.ndarray, docs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs with one bucket more, and where the last bucket starts: all middles of a level of the recursion at once."""
    n = len(ends)
    cost, first = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    lo, hi, a, b = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        sizes = np.minimum(mid - 1, b) - a + 1
        at = np.cumsum(sizes) - sizes
        starts = np.arange(sizes.sum()) - np.repeat(at - a, sizes)
        each = np.repeat(mid, sizes)
        sums = before[starts] + (docs[each] - docs[starts]) * ends[each - 1]
        least = np.minimum.reduceat(sums, at)
        hits = np.flatnonzero(sums == np.repeat(least, sizes))
        best = starts[hits[np.searchsorted(hits, at)]]
        cost[mid], first[mid] = least, best
        left, right = lo < mid, mid < hi
        lo, hi, a, b = (np.concatenate(x) for x in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (a[left], best[right]), (best[left], b[right])))
    return cost, first


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets that minimise the sum of padded lengths."""
    n = len(lengths)
    if not n:
        return []
    ends = np.asarray(lengths, np.int64)
    docs = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    cost, back = np.concatenate(([0], docs[1:] * ends)), [np.zeros(n + 1, np.int64)]
    for _ in range(min(buckets, n) - 1):
        cost, first = _layer(cost, docs, ends)
        back.append(first)
    found, j = [], n
    for first in reversed(back):
        if j <= 0:
            break
        found.append(int(lengths[j - 1]))
        j = int(first[j])
    return found[::-1]


def pack_lengths(rows: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Deal rows of (doc_id, n_tokens) to buckets and batches.

    Returns doc_id, n_tokens, bucket, pad_to, batch (numbered inside the
    bucket) and slot (place inside the batch).
    """
    held = cut(
        rows.select(
            "doc_id",
            "n_tokens",
            F.greatest(F.col("n_tokens"), F.lit(1)).alias("bin"),
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("u"),
        )
    )
    histogram = sorted((x["bin"], x["n"]) for x in held.groupBy("bin").agg(F.count("*").alias("n")).collect())
    ends = best_boundaries([b for b, _ in histogram], [n for _, n in histogram], params.buckets)
    total = sum(n for _, n in histogram)
    pieces = min(params.max_pieces, max(64, total // params.rows_per_piece))
    bucket = F.size(F.filter(constant(ends, "array<bigint>"), lambda e: e < F.col("bin")))
    dealt = held.select(
        "doc_id",
        "n_tokens",
        bucket.alias("bucket"),
        F.pmod("u", F.lit(pieces)).cast("int").alias("piece"),
    )
    counts = dealt.groupBy("bucket", "piece").agg(F.count("*").alias("n")).collect()
    before: dict[int, int] = {}
    offset = [[0] * pieces for _ in ends]
    for b, p, n in sorted((x["bucket"], x["piece"], x["n"]) for x in counts):
        offset[b][p] = before.get(b, 0)
        before[b] = before.get(b, 0) + n
    place = (
        F.element_at(F.element_at(constant(offset, "array<array<bigint>>"), F.col("bucket") + 1), F.col("piece") + 1)
        + F.row_number().over(Window.partitionBy("bucket", "piece").orderBy("doc_id", "n_tokens"))
        - 1
    )
    room = [max(1, params.token_budget // e) for e in ends]
    return (
        dealt.withColumn("place", place)
        .withColumn("room", F.element_at(constant(room, "array<bigint>"), F.col("bucket") + 1))
        .select(
            "doc_id",
            "n_tokens",
            "bucket",
            F.element_at(constant(ends, "array<bigint>"), F.col("bucket") + 1).alias("pad_to"),
            F.floor(F.col("place") / F.col("room")).cast("bigint").alias("batch"),
            (F.col("place") % F.col("room")).alias("slot"),
        )
    )


def pack_documents(docs: DataFrame, params: PackParams = PackParams(), length: Column | None = None) -> DataFrame:
    """:func:`pack_lengths` over the word counts of texts, or another length of each document (such as its token ids'); a null length is 0."""
    if length is None:
        return pack_lengths(texts(docs).select("doc_id", word_count(F.col("text")).alias("n_tokens")), params)
    return pack_lengths(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(length.cast("bigint"), F.lit(0)).alias("n_tokens")), params)
