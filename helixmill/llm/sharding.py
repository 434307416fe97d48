"""Range sharding with sampled splitters.

Records are ordered by the composite key (hash of the text, doc_id, row number),
which tells repeated rows apart.  Keys are drawn by weight (bytes, and rows for
the sake of many short texts) and their quantiles cut the key range into many
ranges of about equal weight; exact bytes and rows of each range follow from one
aggregation.  Ranges far over the mean are cut again by a second sample drawn
from them alone.  Whole ranges are dealt to shards, the heaviest first and each
to the shard with least bytes so far, and a record's slot is its range's offset
in the shard plus its row number in the range.

Equal texts have equal hashes and so are neighbours.  No range begins inside a
group of equal texts, but for groups of more than a share of all bytes or rows
(at most 2 / share such groups, found by an exact aggregation): these have
ranges of their own, so that no task numbers a whole group, and all ranges of a
group go to one shard.  Only a group that is larger than a shard by itself, which
the law of equal bytes can't hold together, is divided among shards.

Only built-in functions run on the executors.  The driver sees the samples, the
heavy groups and one row for each range, all bounded whatever the input.

Null texts count as empty (size 1), null ids sort first; repeated rows are
separate records with separate slots; an empty table gives no rows.  Other
columns of the input play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heapreplace
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import constant, cut, texts
from .ranges import LOWEST, Key, draw, quantiles, range_of

LAW = "bytes"
HIGHEST = 2**63 - 1


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    #: Ranges made first: at least, and at most, and rows aimed at for each.
    min_ranges: int = 1024
    max_ranges: int = 65536
    rows_per_range: int = 100_000
    #: Sampled keys for each range.
    oversampling: int = 8
    #: Share of all bytes or rows from which a group of equal texts has ranges of its own.
    heavy: float = 1 / 1024
    #: A range over so many times the mean is cut again.
    overfull: float = 4.0


def slim_records(docs: DataFrame) -> DataFrame:
    """doc_id, size, CRC-32 and key of each record; texts are read once and left behind."""
    t = texts(docs)
    return t.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("bigint").alias("text_crc32"),
        F.xxhash64("text").alias("h"),
        F.coalesce("doc_id", F.lit(LOWEST)).alias("d"),
        # Fixed by the checkpoint that follows.
        F.monotonically_increasing_id().alias("s"),
    )


def heavy_groups(records: DataFrame, total: int, rows: int, params: ShardParams) -> dict[int, int]:
    """Exact bytes of the groups of equal texts with a large share of bytes or rows."""
    sums = records.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = sums.where((F.col("size") > params.heavy * total) | (F.col("n") > params.heavy * rows)).select("h", "size").collect()
    return {r["h"]: r["size"] for r in found}


def bounds_of(keys: list[Key], heavy: dict[int, int]) -> set[Key]:
    """Lower ends of ranges: inside heavy groups as they are, else moved to the start of their group."""
    found = {k if k[0] in heavy else (k[0], LOWEST, LOWEST) for k in keys}
    for h in heavy:
        found.add((h, LOWEST, LOWEST))
        if h < HIGHEST:
            found.add((h + 1, LOWEST, LOWEST))
    return found


def tally(records: DataFrame, bounds: list[Key]) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows of each range."""
    rows = records.groupBy(range_of(bounds).alias("r")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    return {x["r"]: (x["size"], x["n"]) for x in rows}


def deal(held: dict[int, tuple[int, int]], bounds: list[Key], heavy: dict[int, int], total: int, shards: int) -> dict[int, int]:
    """The shard of each range: items of ranges that stay together, heaviest first, each to the shard with least bytes."""
    items: dict[tuple, list[int]] = {}
    for r in sorted(held):
        h = bounds[r - 1][0] if r else None
        whole = h in heavy and heavy[h] * shards <= total
        items.setdefault(("group", h) if whole else ("range", r), []).append(r)
    weights = sorted(((sum(held[r][0] for r in rs), rs) for rs in items.values()), key=lambda x: (-x[0], x[1]))
    load, found = [(0, k) for k in range(shards)], {}
    heapify(load)
    for weight, rs in weights:
        bytes_so_far, shard = load[0]
        heapreplace(load, (bytes_so_far + weight, shard))
        found |= dict.fromkeys(rs, shard)
    return found


def shard_documents(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """Deal records to shards of near-equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot and grown_shard (null
    under the law of equal bytes).
    """
    records = cut(slim_records(docs))
    whole = records.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    total, rows = whole["size"] or 0, whole["n"]
    ranges = min(params.max_ranges, max(params.min_ranges, ceil(rows / params.rows_per_range)))
    heavy = heavy_groups(records, total, rows, params) if rows else {}
    weight = lambda size, n: (F.col("size") / max(size, 1) + F.lit(1.0 / max(n, 1))) / 2
    bounds = sorted(bounds_of(quantiles(draw(records, ranges * params.oversampling, weight(total, rows), 1), ranges), heavy))
    held = tally(records, bounds)
    mean_bytes, mean_rows = total / ranges, rows / ranges
    again = sorted(r for r, (b, n) in held.items() if b > params.overfull * mean_bytes or n > params.overfull * mean_rows)
    if again:
        size, n = (sum(held[r][k] for r in again) for k in (0, 1))
        inner = draw(records.where(range_of(bounds).isin(again)), ranges * params.oversampling, weight(size, n), 2)
        bounds = sorted(set(bounds) | bounds_of(quantiles(inner, ranges), heavy))
        held = tally(records, bounds)

    dealt = deal(held, bounds, heavy, total, params.shards)
    shard_of, offset, filled = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1), [0] * params.shards
    for r in sorted(held):
        shard_of[r], offset[r] = dealt[r], filled[dealt[r]]
        filled[dealt[r]] += held[r][1]
    order = Window.partitionBy("r").orderBy("h", "d", "s")
    return (
        records.withColumn("r", range_of(bounds))
        .withColumn("nth", F.row_number().over(order))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            F.element_at(constant(shard_of, "array<int>"), F.col("r") + 1).alias("shard"),
            (F.element_at(constant(offset, "array<bigint>"), F.col("r") + 1) + F.col("nth") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
