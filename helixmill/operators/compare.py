"""Comparison of sketches: shared k-mers, containment and Jaccard index.

Everything is long-format and sparse: pairs without a shared k-mer have no row
and stand for 0; a sketch against itself is 1.  Ratios are of counts, so they
are exact to the last bit and never divide by zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import tasks, written


def cardinality(sketch: DataFrame, marks: dict[str, Column] | None = None) -> DataFrame:
    """Distinct k-mers of each sketch: sketch_id and n, or a count of those with each mark.

    Keys are never null; saying so gives the same plan as a join on them, which
    Spark then computes once for both.
    """
    counts = _counts(marks or {"n": F.lit(True)})
    return sketch.where("minimizer is not null and kmer is not null").groupBy("sketch_id").agg(*counts)


def _counts(marks: dict[str, Column]) -> list[Column]:
    return [F.count(F.when(mark, 1)).alias(name) for name, mark in marks.items()]


def color_map(sketch: DataFrame) -> DataFrame:
    """k-mers of several sketches, one row for each sketch that holds them: minimizer, kmer, sketch_id and n_sketches.

    Long rows, so a k-mer of any number of sketches is no single large value.
    """
    held = sketch.groupBy("minimizer", "kmer").agg(F.count("*").alias("n_sketches")).where("n_sketches > 1")
    return sketch.select("minimizer", "kmer", "sketch_id").join(held, ["minimizer", "kmer"])


#: Sketches of a block when the holders of a k-mer are paired, pairs that a task makes, and pairs that it adds up at once.
HOLDERS, PAIRS, AT_ONCE = 256, 1 << 23, 1 << 21


def spread(sketch: DataFrame) -> DataFrame:
    """A sketch dealt by the keys of a comparison, to tasks in proportion to what it is read from.

    Keys are never null; joins on them say so, and with that said Spark deals rows once.
    """
    return sketch.where("minimizer is not null and kmer is not null").repartition(tasks(sketch), "minimizer", "kmer")


def shared(sketch: DataFrame, marks: dict[str, Column] | None = None, fresh: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """Shared k-mers of each pair i < j that has any: i, j and n_shared.

    With marks (conditions on a k-mer's minimizer and key under names), there is
    a count of the k-mers with each mark instead, all from one pass: exact scores
    and those of several rates.  With ``fresh``, the sketch has a column of that
    name, and a k-mer counts for pairs only where one of both rows that hold it
    is fresh.  With sizes (:func:`cardinality`), pairs have n_i and n_j too.

    Pairs are made in as many tasks as their number demands, so what a task holds
    doesn't grow with it.  K-mers held by the same sketches are counted together first (the set of
    holders is told by a digest of 128 bits and its size), so a set of d
    sketches makes its pairs once, however many k-mers its members share.  The
    pairs of large sets are made block by block.  Sets that are alike mostly have
    the same sketch of least hash and meet in a task, which adds up their pairs
    before these are shuffled.  Tables bucketed by minimizer and k-mer are grouped without an exchange.
    """
    own = ["sketch_id", "fresh"] if fresh else ["sketch_id"]
    digest = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), *own))
    told = [F.count("*").alias("d"), digest(1).alias("x"), digest(2).alias("y"), F.min(F.xxhash64("sketch_id")).alias("near")]
    kmers = sketch.groupBy("minimizer", "kmer").agg(*told, *([F.max("fresh").alias("met")] if fresh else [])).where("d > 1 and met" if fresh else "d > 1")
    marks = marks or {"n_shared": F.lit(True)}
    key = ["d", "x", "y", "near"]
    sets = kmers.groupBy(*key).agg(*_counts(marks), F.min(F.struct("minimizer", "kmer")).alias("one"))
    ones = sets.select(*key, *marks, "one.*")
    if fresh:
        ones = ones.hint("shuffle_hash")  # so that the rows aren't sorted; such rows are dealt to tasks in proportion to the input
    holders = sketch.select("minimizer", "kmer", *own).join(ones, ["minimizer", "kmer"])
    if sizes is not None:
        holders = holders.join(sizes.select("sketch_id", F.col("n").alias("size")), "sketch_id")
    # Powers of two, so that sets that are alike have the same blocks.
    blocks = F.greatest(F.lit(1), F.pow(2.0, F.ceil(F.log2(F.col("d") / HOLDERS)))).cast("int")
    kept = ["size"] if sizes is not None else []
    return _paired(written(holders.select(*key, *marks, *own, *kept, blocks.alias("blocks"))), list(marks), fresh, kept)


def _paired(holders: DataFrame, marks: list[str], fresh: bool, kept: list[str]) -> DataFrame:
    """Pairs of each set's sketches, added up over sets."""
    n = max(holders.sparkSession.sparkContext.defaultParallelism, -(-(holders.agg(F.sum("d")).first()[0] or 0) // (2 * PAIRS)))
    # Cells that would be more than a task's pairs are dealt by set as well; they are fewer than the tasks.
    parts = F.ceil(F.sum("d") / (F.col("blocks") * F.col("blocks")) / (2 * PAIRS))
    crowded = holders.groupBy("near", "blocks").agg(parts.cast("int").alias("parts")).where("parts > 1")
    own = F.pmod(F.xxhash64("sketch_id", F.lit(3)), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("low"), F.greatest(k, own).alias("high")))
    part = F.pmod("x", F.coalesce("parts", F.lit(1)))
    dealt = holders.join(F.broadcast(crowded), ["near", "blocks"], "left").select(
        *("near", "blocks", "x", "y", part.alias("part"), "sketch_id", own.alias("own"), F.ceil(F.col("d") / F.col("blocks")).alias("partners")),
        *(*marks, *kept, (~F.col("fresh") if fresh else F.lit(False)).alias("old"), F.inline(cells)),
    )
    cell = ["near", "blocks", "part", "low", "high"]
    rows = dealt.withColumn("side", F.when(F.col("low") < F.col("high"), (F.col("own") == F.col("high")).cast("int")).otherwise(-1))
    rows = rows.repartition(n, *cell).sortWithinPartitions(*cell, "x", "y", "side", "old").select("x", "y", "low", "high", "side", "old", "sketch_id", "partners", *marks, *kept)
    ends = ", ".join(f"{c} bigint" for c in ("i", "j", *marks, *(["n_i", "n_j"] if kept else [])))
    sums = [F.sum(name).alias(name) for name in marks] + [F.max(name).alias(name) for name in (("n_i", "n_j") if kept else ())]
    return rows.mapInArrow(_pairing(marks, bool(kept)), ends).groupBy("i", "j").agg(*sums)


def _pairing(marks: list[str], sized: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of rows that are sorted by set and cell, added up over a bounded number of pairs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        due = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append({name: b.column(name).to_numpy(zero_copy_only=False) for name in b.schema.names})
            due += int(held[-1]["partners"].sum())
            if due >= AT_ONCE:
                rows = {name: np.concatenate([h[name] for h in held]) for name in held[0]}
                last = _firsts(rows)[-1]  # more rows of it may follow
                yield from _pairs({name: c[:last] for name, c in rows.items()}, marks, sized)
                held = [{name: c[last:] for name, c in rows.items()}]
                due = int(held[0]["partners"].sum())
        if held:
            yield from _pairs({name: np.concatenate([h[name] for h in held]) for name in held[0]}, marks, sized)

    return run


def _firsts(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Where the rows of each set's cells begin."""
    changes = np.ones(len(rows["x"]), bool)
    changes[1:] = False
    for c in ("x", "y", "low", "high"):
        changes[1:] |= rows[c][1:] != rows[c][:-1]
    return np.flatnonzero(changes)


def _pairs(rows: dict[str, np.ndarray], marks: list[str], sized: bool) -> Iterator[pa.RecordBatch]:
    """i, j and sums of the marks (and both sizes) of the pairs in some whole cells: inside a block (side -1), or between one (0) and another (1)."""
    n = len(rows["x"])
    if not n:
        return
    first = _firsts(rows)
    cell = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    end = np.append(first[1:], n)[cell]
    side, new = rows["side"], ~rows["old"]
    # New rows come first in a block: in it they meet all that follow, and old ones none; between blocks, old ones meet new ones.
    middle = (first + np.add.reduceat((side == 0).astype(np.int64), first))[cell]
    fresh = middle + np.add.reduceat(((side == 1) & new).astype(np.int64), first)[cell]
    low = np.where(side == 0, middle, np.arange(1, n + 1))
    high = np.where(side == 0, np.where(new, end, fresh), np.where((side == -1) & new, end, low))
    counts = high - low
    left = np.repeat(np.arange(n), counts)
    right = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts - low, counts)
    ids, at, place = np.unique(rows["sketch_id"], return_index=True, return_inverse=True)
    weights, weight = np.unique(np.stack([rows[name] for name in marks], axis=1), axis=0, return_inverse=True)
    a, b = place[left], place[right]
    # The weight's number beside the pair's, so that one sort of numbers brings equal pairs together.
    keys = (np.minimum(a, b) * len(ids) + np.maximum(a, b)) * len(weights) + weight.reshape(-1)[left]
    keys.sort()
    pair, which = np.divmod(keys, len(weights))
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    i, j = np.divmod(pair[starts], len(ids))
    columns = [ids[i], ids[j], *(np.add.reduceat(weights[which, m], starts) if len(starts) else starts for m in range(len(marks)))]
    if sized:
        columns += [rows["size"][at[i]], rows["size"][at[j]]]
    for k in range(0, len(starts), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in columns], ["i", "j", *marks, *(["n_i", "n_j"] if sized else [])])


#: Most sketches whose holders of a k-mer are bits of its row.
PLACES = 512


def together(found: DataFrame, n: int, levels: int) -> DataFrame:
    """k-mers that each two of n sketches share, by level: level, i <= j (places from 0) and n_shared; i = j counts a sketch's own.

    ``found`` has place, kmer and level (below ``levels``, the same wherever the
    k-mer is) of occurrences.  A k-mer becomes one row, with a bit for each
    sketch that holds it, and moves once; a task adds up products of bit
    matrices, so nothing is paired over rows.  For up to ``PLACES`` sketches.
    """
    words = range((n + 63) // 64)
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    bits = [F.bit_or(F.when(F.floor(F.col("place") / 64) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"h{w}") for w in words]
    held = found.groupBy("kmer").agg(F.min("level").alias("level"), *bits).drop("kmer")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((levels, n, n), np.int64)
        for b in batches:
            level = b.column("level").to_numpy()
            rows = np.stack([b.column(f"h{w}").to_numpy() for w in words], axis=1).astype("<i8")
            for one in np.unique(level):
                own, counts = np.unique(rows[level == one], axis=0, return_counts=True)
                here = np.unpackbits(own.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(np.float64)
                sums[one] += np.rint((here * counts[:, None]).T @ here).astype(np.int64)
        at = np.nonzero(np.triu(sums))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*(x.astype(np.int64) for x in at), sums[at])], ["level", "i", "j", "n_shared"])

    each = held.mapInArrow(products, "level bigint, i bigint, j bigint, n_shared bigint")
    return each.groupBy("level", "i", "j").agg(F.sum("n_shared").alias("n_shared"))


def scored(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs with both sizes, both containments and the Jaccard index."""
    return ratios(sized(pairs, sizes))


def sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs with the sizes of both sketches, n_i and n_j."""
    n_i = sizes.select(F.col("sketch_id").alias("i"), F.col("n").alias("n_i"))
    n_j = sizes.select(F.col("sketch_id").alias("j"), F.col("n").alias("n_j"))
    return pairs.join(n_i, "i").join(n_j, "j")


def ratios(pairs: DataFrame) -> DataFrame:
    """Both containments and the Jaccard index of pairs with sizes."""
    both = F.col("n_shared").cast("double")
    return pairs.select(
        "i",
        "j",
        "n_shared",
        "n_i",
        "n_j",
        (both / F.col("n_i")).alias("containment_ij"),
        (both / F.col("n_j")).alias("containment_ji"),
        (both / (F.col("n_i") + F.col("n_j") - F.col("n_shared"))).alias("jaccard"),
    )


def all_pairs(sketch: DataFrame) -> DataFrame:
    """Every pair of sketches with a shared k-mer, scored; sizes go along with the sketches, so pairs aren't joined with them."""
    return ratios(shared(sketch, sizes=cardinality(sketch)))


def nearest(pairs: DataFrame, column: str, k: int) -> DataFrame:
    """The k best partners of each sketch by a score that has no direction: i, rank, j and the score; ties go to the smaller j.

    The rank's limit is applied in each task before rows are shuffled, so no more
    than k rows of a sketch leave a task.
    """
    both = pairs.select("i", "j", column).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), column))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc(column), "j"))
    return both.select("i", rank.alias("rank"), "j", column).where(F.col("rank") <= k)


def at_least(pairs: DataFrame, column: str, least: float, sparse: bool = True) -> DataFrame:
    """Scores under the least value dropped, or shown as 0 where rows are to stay."""
    if sparse:
        return pairs.where(F.col(column) >= least)
    return pairs.withColumn(column, F.when(F.col(column) < least, 0.0).otherwise(F.col(column)))


def against_bank(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """Queries against all sketches, the queries themselves included.

    ``sketch_id`` numbers queries first, then the bank, so ids must not clash.
    Buckets without a query are left out by a semi-join on the minimizer.
    Returns i (a query), j, n_shared, containment and jaccard for i <> j.
    """
    everything = queries.unionByName(bank)
    hit = everything.join(queries.select("minimizer").distinct(), "minimizer", "left_semi")
    a = queries.select("minimizer", "kmer", F.col("sketch_id").alias("i"))
    b = hit.select("minimizer", "kmer", F.col("sketch_id").alias("j"))
    pairs = a.join(b, ["minimizer", "kmer"]).where("i <> j").groupBy("i", "j").agg(F.count("*").alias("n_shared"))
    return scored(pairs, cardinality(everything)).select("i", "j", "n_shared", F.col("containment_ij").alias("containment"), "jaccard")
