"""Sketches: the k-mers whose minimizer's hash is under the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.params import SketchParams
from ..sources.shared import written
from . import compare
from .minimizers import kmers, leveled, minimizers, most_selected
from .superkmers import covered_mmers, rebuild, super_kmers


def selected_kmers(records: DataFrame, p: SketchParams) -> DataFrame:
    """Occurrences of selected k-mers: sketch_id, minimizer, canonical kmer, pos_min (the minimizer's offset)."""
    return minimizers(records, p, most_selected(p)).select("sketch_id", "minimizer", "kmer", (F.col("mpos") - F.col("pos")).alias("pos_min"))


def build(records: DataFrame, p: SketchParams) -> DataFrame:
    """sketch_id, minimizer, kmer, cnt and pos_min of the distinct selected k-mers that are abundant enough."""
    counted = selected_kmers(records, p).groupBy("sketch_id", "minimizer", "kmer").agg(F.count("*").alias("cnt"), F.min("pos_min").alias("pos_min"))
    return counted.where(F.col("cnt") >= p.abundance) if p.abundance > 1 else counted


def shared_at(records: DataFrame, rates: dict[str, SketchParams]) -> tuple[DataFrame, DataFrame]:
    """k-mers that sketches of several rates share (i < j) and their sizes, a column for each rate, from one pass over the sequences.

    The parameters differ in their rates only.  Up to ``compare.PLACES`` sketches
    are counted as bits of a row, more of them by rows.
    """
    p = max(rates.values(), key=most_selected)
    # One column of the records, at most one row more than there are places.
    ids = sorted(r[0] for r in records.select("sketch_id").distinct().limit(compare.PLACES + 1).collect())
    if len(ids) > compare.PLACES:
        if p.order != "hash":
            raise ValueError("marks of k-mers are made for the order of hashes")
        every = written(build(records, p).select("sketch_id", "minimizer", "kmer"))
        marks = {name: dna.hash_order(F.col("minimizer")) <= F.lit(most_selected(own)).cast("bigint") for name, own in rates.items()}
        return written(compare.shared(every, marks)), written(compare.cardinality(every, marks))
    spark = records.sparkSession
    places = spark.createDataFrame(list(enumerate(ids)), "place bigint, sketch_id bigint")
    limits = sorted(most_selected(own) for own in rates.values())
    placed = records.join(F.broadcast(places), "sketch_id").drop("sketch_id").withColumnRenamed("place", "sketch_id")
    found = leveled(placed, p, limits).withColumnRenamed("sketch_id", "place")
    counts = compare.together(found, len(ids), len(limits))
    # A k-mer of a level is in the sketches of the rates from there on.
    told = [F.sum(F.when(F.col("level") <= limits.index(most_selected(own)), F.col("n_shared")).otherwise(0)).alias(name) for name, own in rates.items()]
    cells = counts.groupBy("i", "j").agg(*told)
    for c in "ij":
        cells = cells.join(F.broadcast(places.withColumnRenamed("place", c)), c).drop(c).withColumnRenamed("sketch_id", c)
    cells = written(cells)
    return cells.where("i < j").select("i", "j", *rates), cells.where("i = j").select(F.col("i").alias("sketch_id"), *rates)


def spectrum(records: DataFrame, p: SketchParams) -> DataFrame:
    """All distinct canonical k-mers with counts, without selection: sketch_id, kmer and cnt."""
    return kmers(records, p).groupBy("sketch_id", "kmer").agg(F.count("*").alias("cnt"))


def total_kmers(records: DataFrame, p: SketchParams) -> DataFrame:
    """k-mer occurrences of each sketch before selection, from lengths alone."""
    long_enough = records.where(F.length("seq") >= p.k)
    return long_enough.groupBy("sketch_id").agg(F.sum(F.length("seq") - p.k + 1).cast("bigint").alias("total_kmers"))


def metrics(records: DataFrame, p: SketchParams) -> DataFrame:
    """One row for each sketch with a k-mer: totals, selections, rates and super-k-mer statistics.

    Ratios are null where their denominator is zero.
    """
    segments = super_kmers(records, p)
    chosen = F.col("selected")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    by_segment = segments.groupBy("sketch_id").agg(
        F.sum("n_kmers").cast("bigint").alias("total_kmers"),
        F.count("*").alias("total_superkmers"),
        count(F.col("is_maximal")).alias("maximal_superkmers"),
        F.sum(F.when(chosen, F.col("n_kmers")).otherwise(0)).cast("bigint").alias("selected_kmers"),
        count(chosen).alias("selected_superkmers"),
        count(chosen & F.col("is_maximal")).alias("selected_maximal"),
    )
    kept = build(records, p.counting)
    by_kmer = kept.groupBy("sketch_id").agg(F.count("*").alias("distinct_kmers"), F.countDistinct("minimizer").alias("minimizers"), count(F.col("cnt") >= p.abundance).alias("kept_kmers"))
    joined = by_segment.join(by_kmer, "sketch_id", "left").join(covered_mmers(segments, p), "sketch_id", "left").na.fill(0, ["distinct_kmers", "minimizers", "kept_kmers", "n_mmers"])
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a).cast("double") / F.col(b))
    return joined.select(
        *(c for c in joined.columns),
        ratio("total_kmers", "selected_kmers").alias("rate_with_duplicates"),
        ratio("total_kmers", "distinct_kmers").alias("rate_distinct"),
        ratio("total_superkmers", "selected_superkmers").alias("superkmer_rate"),
        ratio("total_kmers", "total_superkmers").alias("kmers_per_superkmer"),
        ratio("selected_kmers", "selected_superkmers").alias("kmers_per_selected"),
        F.when(F.col("n_mmers") != 0, F.col("selected_superkmers").cast("double") / F.col("n_mmers") * (p.window + 1)).alias("density"),
    )


def output_metrics(records: DataFrame, p: SketchParams) -> DataFrame:
    """What packing a sketch's k-mers into super-k-mers gives, one row a sketch.

    Columns: sketch_id, rebuilt (super-k-mers), rebuilt_maximal, kmers_per_rebuilt,
    maximal_percent, output_kb, bits_per_kmer, minimizers, superkmers_per_minimizer.
    """
    rebuilt = rebuild(build(records, p), p)
    maximal = F.length("seq") == p.longest
    # A maximal super-k-mer is stored without its minimizer, at two bits a base after a byte for the length.
    size = 1 + F.ceil(F.when(maximal, F.length("seq") - p.m).otherwise(F.length("seq")) / 4)
    sums = rebuilt.groupBy("sketch_id").agg(
        F.count("*").alias("rebuilt"),
        F.count(F.when(maximal, 1)).alias("rebuilt_maximal"),
        F.sum("n_kmers").alias("kmers"),
        F.sum(size).alias("bytes"),
        F.countDistinct("minimizer").alias("minimizers"),
    )
    return sums.select(
        "sketch_id",
        "rebuilt",
        "rebuilt_maximal",
        (F.col("kmers") / F.col("rebuilt")).alias("kmers_per_rebuilt"),
        (F.col("rebuilt_maximal") * 100 / F.col("rebuilt")).alias("maximal_percent"),
        (F.col("bytes") / 1000).alias("output_kb"),
        (F.col("bytes") * 8 / F.col("kmers")).alias("bits_per_kmer"),
        "minimizers",
        F.floor(F.col("rebuilt") / F.col("minimizers")).alias("superkmers_per_minimizer"),
    )


def write_sketches(sketch: DataFrame, meta: DataFrame, table: str, buckets: int = 64, folder: str | None = None) -> None:
    """Save sketches as a table bucketed and sorted by the keys of comparisons, which then join without an exchange, and their parameters beside it (in the warehouse, or in a folder)."""
    place = lambda name: {"path": f"{folder}/{name}"} if folder else {}
    sketch.write.mode("overwrite").options(**place("sketch")).bucketBy(buckets, "minimizer", "kmer").sortBy("minimizer", "kmer").saveAsTable(table)
    meta.write.mode("overwrite").options(**place("meta")).saveAsTable(f"{table}_meta")


def meta_rows(names: DataFrame, p: SketchParams) -> DataFrame:
    """sketch_id and name with the parameters that a sketch was made with."""
    return names.select("sketch_id", "name", F.lit(p.k).alias("k"), F.lit(p.m).alias("m"), F.lit(float(p.s)).alias("s"), F.lit(p.abundance).alias("abundance"))


def agreed(meta: DataFrame) -> SketchParams:
    """The parameters of a set of sketches; an error if they differ, as such sketches can't be compared."""
    rows = meta.select("k", "m", "s").distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"sketches were made with {'no' if not rows else 'different'} parameters")
    return SketchParams(rows[0]["k"], rows[0]["m"], rows[0]["s"])
