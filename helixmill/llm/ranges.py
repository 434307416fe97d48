"""Ranges of a composite key (h, d, s) with sampled splitters.

Keys are drawn as often as their weights demand, quantiles of the draw are the
lower ends of ranges, and a column tells each row's range.  The driver sees the
sample and one row for each range; both are bounded by the number of ranges.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import constant

LOWEST = -(2**63)
Key = tuple[int, int, int]


def draw(records: DataFrame, size: int, weight: Column, seed: int) -> list[tuple[int, int, int, int]]:
    """About ``size`` keys, each drawn as often as its weight demands (weights add up to 1): (h, d, s, times), in key order."""
    due = F.lit(float(size)) * weight
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("bigint"), "h", "d", "s"), 11) * F.lit(2.0**-53)
    times = (F.floor(due) + (u < due - F.floor(due)).cast("bigint")).alias("times")
    rows = records.select("h", "d", "s", times).where("times > 0").collect()
    return sorted((r.h, r.d, r.s, r.times) for r in rows)


def quantiles(sample: list[tuple[int, int, int, int]], ranges: int) -> list[Key]:
    """Keys that cut a sample into about as many ranges."""
    drawn = sum(x[3] for x in sample)
    if not drawn:
        return []
    step, seen, bounds = max(1.0, drawn / ranges), 0, set()
    at = step
    for h, d, s, times in sample:
        seen += times
        if seen > at:
            bounds.add((h, d, s))
            at = (seen // step + 1) * step
    return sorted(bounds)


def range_of(bounds: list[Key]) -> Column:
    """Number of the range that holds the key (h, d, s), by two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    width = isqrt(len(bounds)) + 1
    blocks = [[{"h": h, "d": d, "s": s} for h, d, s in bounds[k : k + width]] for k in range(0, len(bounds), width)]
    kind = "array<struct<h:bigint,d:bigint,s:bigint>>"
    below = lambda b: (b["h"] < F.col("h")) | ((b["h"] == F.col("h")) & ((b["d"] < F.col("d")) | ((b["d"] == F.col("d")) & (b["s"] <= F.col("s")))))
    block = F.size(F.filter(constant([b[0] for b in blocks], kind), below))
    inside = F.size(F.filter(F.element_at(constant(blocks, f"array<{kind}>"), F.greatest(block, F.lit(1))), below))
    return F.when(block == 0, 0).otherwise((block - 1) * width + inside).cast("int")
