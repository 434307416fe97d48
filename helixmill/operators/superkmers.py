"""Super-k-mers: maximal runs of k-mers that share one occurrence of a minimizer.

The leftmost occurrence of a sliding minimum never moves back, so runs are the
groups of equal (sequence, occurrence); they are found inside chunks and put
together by one aggregation, not a lag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.params import MAX_INT_K, SketchParams
from ..sources.shared import written
from . import chains
from .minimizers import is_selected, kmers, runs


def super_kmers(records: DataFrame, p: SketchParams, with_seq: bool = False) -> DataFrame:
    """sketch_id, rec_id, start, len, n_kmers, minimizer, ho, is_rev, is_maximal, selected and, if wanted, seq (the bases).

    Runs that the ends of chunks cut are joined again.
    """
    pieces = runs(records, p, with_seq)
    seq = [F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("parts")] if with_seq else []
    joined = pieces.groupBy("sketch_id", "rec_id", "mpos").agg(
        F.min("start").alias("start"),
        F.sum("n_kmers").alias("n_kmers"),
        F.first("minimizer").alias("minimizer"),
        F.first("ho").alias("ho"),
        F.first("is_rev").alias("is_rev"),
        *seq,
    )
    # A run has at most as many k-mers as a window has m-mers, so two parts at most; parts overlap by k-1 bases.
    whole = F.concat(F.col("parts")[0]["seq"], F.coalesce(F.substring(F.try_element_at("parts", F.lit(2))["seq"], p.k, p.longest), F.lit(""))).alias("seq")
    return joined.select(
        "sketch_id",
        "rec_id",
        "start",
        (F.col("n_kmers") + p.k - 1).alias("len"),
        "n_kmers",
        "minimizer",
        "ho",
        "is_rev",
        (F.col("n_kmers") == p.window).alias("is_maximal"),
        is_selected(p).alias("selected"),
        *([whole] if with_seq else []),
    )


def oriented(segments: DataFrame) -> DataFrame:
    """Segments with seq read so that the minimizer is in its canonical form."""
    return segments.withColumn("seq", F.when(F.col("is_rev"), dna.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))


def flanks(segments: DataFrame, p: SketchParams) -> DataFrame:
    """Maximal super-k-mers (with seq) as the minimizer and the k-m bases on both of its sides, which is how they are stored."""
    side = p.k - p.m
    return oriented(segments.where("is_maximal")).select(
        "sketch_id", "rec_id", "start", "minimizer", F.substring("seq", 1, side).alias("left"), F.substring("seq", side + p.m + 1, side).alias("right")
    )


def kmers_of(sequences: DataFrame, p: SketchParams) -> DataFrame:
    """Distinct canonical k-mers of a table of super-k-mers (sketch_id, seq): sketch_id and kmer."""
    numbered = sequences.select("sketch_id", F.monotonically_increasing_id().alias("rec_id"), "seq")
    return kmers(numbered, p, deal=False).select("sketch_id", "kmer").distinct()


def covered_mmers(segments: DataFrame, p: SketchParams) -> DataFrame:
    """m-mers that the selected super-k-mers of each sketch cover, each counted once: sketch_id and n_mmers."""
    order = Window.partitionBy("sketch_id", "rec_id").orderBy("start")
    ends = F.lag(F.col("start") + F.col("len") - p.m + 1).over(order)
    fresh = F.col("len") - p.m + 1 - F.greatest(F.lit(0), F.coalesce(ends, F.col("start")) - F.col("start"))
    return segments.where("selected").withColumn("fresh", fresh).groupBy("sketch_id").agg(F.sum("fresh").alias("n_mmers"))


def placed(sketch: DataFrame, p: SketchParams) -> DataFrame:
    """The k-mers of a sketch read so that their minimizer is in its canonical form: sketch_id, minimizer, x (bases) and at (its leftmost place)."""
    own = dna.text_of(F.col("minimizer"), p.m)
    told = sketch.select("sketch_id", "minimizer", dna.kmer_text(F.col("kmer"), p.k).alias("x"), own.alias("own"))
    turned = told.select("sketch_id", "minimizer", "own", F.when(F.contains("x", "own"), F.col("x")).otherwise(dna.reverse_complement(F.col("x"))).alias("x"))
    return turned.select("sketch_id", "minimizer", "x", (F.instr(F.col("x"), F.col("own")) - 1).alias("at"))


#: Order in which neighbours are tried.
TRIED = "ATCG"


def links(nodes: DataFrame, p: SketchParams) -> DataFrame:
    """Which k-mer follows which: sketch_id, minimizer, x and after.

    A k-mer may be followed by one that overlaps it in k-1 bases and has the
    minimizer a place further left.  The k-mers on both sides of an overlap, four
    at most, are paired in order of their bases, so a k-mer has one follower
    and follows one at most, and as many are linked as can be.
    """
    side = lambda left, overlap, base, at: F.struct(
        F.lit(left).alias("left"), overlap.alias("overlap"), at.alias("spot"), F.struct(F.instr(F.lit(TRIED), base).alias("rank"), F.col("x").alias("x")).alias("one")
    )
    x, at = F.col("x"), F.col("at")
    ends = F.array(
        F.when(at > 0, side(True, F.substring(x, 2, p.k - 1), F.substring(x, 1, 1), at)),
        F.when(at < p.k - p.m, side(False, F.substring(x, 1, p.k - 1), F.substring(x, p.k, 1), at + 1)),
    )
    halves = nodes.select("sketch_id", "minimizer", F.inline(F.filter(ends, lambda e: e.isNotNull())))
    members = lambda left: F.array_sort(F.collect_list(F.when(F.col("left") == left, F.col("one"))))
    met = halves.groupBy("sketch_id", "minimizer", "spot", "overlap").agg(members(True).alias("before"), members(False).alias("behind"))
    pairs = F.slice(F.arrays_zip("before", "behind"), F.lit(1), F.least(F.size("before"), F.size("behind")))
    return met.select("sketch_id", "minimizer", F.inline(pairs)).select("sketch_id", "minimizer", F.col("before.x").alias("x"), F.col("behind.x").alias("after"))


#: k-mers of a (sketch, minimizer) that one task may hold; chains of larger groups are put together over rows.
GROUP = 1 << 20


def rebuild(sketch: DataFrame, p: SketchParams) -> DataFrame:
    """Pack the distinct k-mers of each (sketch, minimizer) into as few super-k-mers as can be: sketch_id, minimizer, seq and n_kmers.

    k-mers reach as far to the left and right as their minimizer's place lets
    them, so no super-k-mer is longer than a maximal one; every k-mer is in
    exactly one.  The groups of up to ``GROUP`` k-mers move once and are chained on
    arrays; those with more, and k-mers of more than 31 bases, are spread over
    tasks row by row.
    """
    if p.k > MAX_INT_K:
        return over_rows(sketch, p)
    key = ["sketch_id", "minimizer"]
    held = written(sketch.select(*key, "kmer"))
    # Few, as each has more than GROUP rows.
    large = written(held.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select(*key))
    some = large.limit(1).count() > 0
    small = held.join(F.broadcast(large), key, "left_anti") if some else held
    schema = "sketch_id bigint, minimizer bigint, seq string, n_kmers bigint"
    packed = small.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: chains.on_groups(batches, p), schema)
    return packed.unionByName(over_rows(held.join(F.broadcast(large), key, "left_semi"), p)) if some else packed


def over_rows(sketch: DataFrame, p: SketchParams) -> DataFrame:
    """The same as :func:`rebuild`, over rows: groups of any size, spread over tasks.

    Chains are put together by doubling steps: a k-mer knows the first of as many
    as 1, 2, 4, ... before it, until it knows its chain's head.  A group is one
    overlap or one chain.
    """
    key = ["sketch_id", "minimizer"]
    nodes = written(placed(sketch, p))
    before = links(nodes, p).select(*key, F.col("after").alias("x"), F.col("x").alias("head"))
    known = written(nodes.join(before, [*key, "x"], "left").select(*key, "x", "at", F.coalesce("head", "x").alias("head")))
    reach = 1
    while reach < p.window - 1:
        further = known.where("x <> head").select(*key, F.col("x").alias("head"), F.col("head").alias("first"))
        known = written(known.join(further, [*key, "head"], "left").select(*key, "x", "at", F.coalesce("first", "head").alias("head")))
        reach *= 2
    # A chain has as many k-mers as a window has places at most.
    chains = known.groupBy(*key, "head").agg(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("place"), F.substring("x", p.k, 1).alias("base")))).alias("members"))
    rest = F.array_join(F.transform(F.slice("members", 2, p.window), lambda r: r["base"]), "")
    return chains.select(*key, F.concat("head", rest).alias("seq"), F.size("members").cast("bigint").alias("n_kmers"))
