"""Whole jobs on files: sketch collections, compare sketches, sort matrices, tabulate errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import SketchParams
from ..operators import compare, evaluate, matrix, sketch, superkmers
from ..sources import exchange, fasta
from ..sources.shared import written


def sketch_files(spark: SparkSession, paths: list[str], p: SketchParams, table: str, prefix: str = "subsampled_", hidden: bool = False) -> DataFrame:
    """Sketch FASTA files into a bucketed table and return what was made: sketch_id, name and parameters, in the order of the paths.

    ``hidden`` reads files whose names don't tell that they are compressed.
    """
    p = p.normalised()
    records = (fasta.read_any_fasta if hidden else fasta.read_fasta)(spark, paths)
    named = spark.createDataFrame(list(enumerate(paths)), "sketch_id bigint, path string")
    names = named.select("sketch_id", fasta.output_name(F.col("path"), prefix).alias("name"))
    sketch.write_sketches(sketch.build(records, p), sketch.meta_rows(names, p), table)
    return spark.table(f"{table}_meta").orderBy("sketch_id")


def write_sketch_files(counted: DataFrame, names: DataFrame, p: SketchParams, folder: str, listed: str, overwrite: bool = False) -> None:
    """Write sketches, counted without a least abundance, as files of the exchange format.

    ``names`` has the sketch_id and file name of every sketch, those without
    k-mers included; the headers tell all selected occurrences, the files hold
    the k-mers that are abundant enough.
    """
    selected = counted.groupBy("sketch_id").agg(F.sum("cnt").alias("selected"))
    told = names.join(selected, "sketch_id", "left").na.fill(0, ["selected"])
    exchange.write_sketches(superkmers.rebuild(counted.where(F.col("cnt") >= p.abundance), p), told, p, folder, listed, overwrite)


def sketch_to_files(spark: SparkSession, paths: list[str], p: SketchParams, folder: str, listed: str = "sketches.txt", prefix: str = "subsampled_", hidden: bool = False, overwrite: bool = False) -> list[str]:
    """Sketch FASTA files, each into a file of the exchange format; the files' paths, which ``folder/listed`` lists too, in the order of the inputs."""
    p = p.normalised()
    records = fasta.read_any_fasta(spark, paths, k=p.k) if hidden else fasta.read_fasta(spark, paths)
    named = spark.createDataFrame(list(enumerate(paths)), "sketch_id bigint, path string")
    names = named.select("sketch_id", fasta.output_name(F.col("path"), prefix).alias("name"))
    counted = written(sketch.build(records, p.counting))
    write_sketch_files(counted, names, p, folder, listed, overwrite)
    return listed_paths(spark, f"{folder}/{listed}")


def listed_paths(spark: SparkSession, path: str, shortest: int = fasta.COMPARE) -> list[str]:
    """The paths in a list, in their order (the list is the caller's own, so it fits the driver)."""
    return [r["path"] for r in fasta.read_paths(spark, path, shortest).orderBy("ord").collect()]


def compare_files(spark: SparkSession, bank: list[str], queries: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Score sketch files with each other, or query files with all: (i, j, containment, jaccard) for i <> j, and (sketch_id, name).

    Queries are numbered first and the bank after them; a file may be in both.
    Files made with different parameters are an error.
    """
    first, paths = len(queries or []), [*(queries or []), *bank]
    made = sketch.agreed(exchange.read_headers(spark, paths).withColumnRenamed("rate", "s"))
    held = written(exchange.read_sketches(spark, paths, made))
    names = spark.createDataFrame([(i, p.rsplit("/", 1)[-1]) for i, p in enumerate(paths)], "sketch_id bigint, name string")
    if queries is None:
        return _directed(compare.all_pairs(held)), names
    return compare.against_bank(held.where(F.col("sketch_id") < first), held.where(F.col("sketch_id") >= first)).drop("n_shared"), names


def _directed(pairs: DataFrame) -> DataFrame:
    there = pairs.select("i", "j", F.col("containment_ij").alias("containment"), "jaccard")
    back = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("containment_ji").alias("containment"), "jaccard")
    return there.unionByName(back)


def compare_tables(spark: SparkSession, bank: str, queries: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Score the sketches of a table with each other, or those of another table with all: (i, j, containment, jaccard) for i <> j, and (sketch_id, name).

    With queries, they are numbered first and the bank's sketches after them.
    """
    meta = spark.table(f"{bank}_meta")
    if queries is None:
        sketch.agreed(meta)
        return _directed(compare.all_pairs(spark.table(bank))), meta.select("sketch_id", "name")
    own = spark.table(f"{queries}_meta")
    sketch.agreed(own.unionByName(meta))
    first = own.agg(F.max("sketch_id")).first()[0] + 1
    moved = lambda t: t.withColumn("sketch_id", F.col("sketch_id") + first)
    scores = compare.against_bank(spark.table(queries), moved(spark.table(bank)))
    return scores.drop("n_shared"), own.select("sketch_id", "name").unionByName(moved(meta).select("sketch_id", "name"))


def matrix_cells(scores: DataFrame, names: DataFrame, column: str, least: float = 0.0, rows: DataFrame | None = None) -> DataFrame:
    """All cells of a matrix of directed scores; scores under the least value show as 0, rows can be held to some ids."""
    cells = matrix.dense(compare.at_least(scores, column, least, sparse=False), names, column, symmetric=False)
    return cells if rows is None else cells.join(rows.select(F.col("sketch_id").alias("i")), "i", "left_semi")


def write_matrix(cells: DataFrame, names: DataFrame, path: str, digits: int = 6) -> None:
    """Write a matrix as gzipped CSV; part files hold consecutive lines."""
    lines = matrix.csv_lines(cells, names, digits)
    lines.orderBy("line").select("text").write.mode("overwrite").option("compression", "gzip").text(path)


def sort_matrix(cells: DataFrame, names: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A matrix in the order of a list of paths (ord, path): cells (i, j, value) and names.

    A sketch is looked up by its name; one that the list lacks is an error.
    """
    base = F.regexp_extract("path", "([^/]*)$", 1)
    # Places without gaps; one row a sketch of a dense matrix.
    ranked = order.select(base.alias("name"), (F.dense_rank().over(_by("ord")).cast("bigint") - 1).alias("place"))
    placed = names.join(ranked, "name", "left")
    if placed.where("place is null").limit(1).count():
        raise ValueError("the list doesn't name every sketch of the matrix")
    moved = matrix.reorder(cells, placed).select(F.col("row").alias("i"), F.col("column").alias("j"), "value")
    return moved, placed.select(F.col("place").alias("sketch_id"), "name")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def error_table(truth: DataFrame, estimates: dict[int, DataFrame], metric: str, values: dict[int, float], tool: str) -> DataFrame:
    """Plot-ready errors of a tool at several rates: value, type, threshold, the metric and tool.

    ``estimates`` has a matrix for each rate, ``values`` what the metric (memory,
    time, size) was at that rate.
    """
    found = None
    for rate, cells in estimates.items():
        one = evaluate.mean_error(truth, cells).select("diff", F.lit(rate).cast("bigint").alias("threshold"), F.lit(float(values[rate])).alias(metric))
        found = one if found is None else found.unionByName(one)
    return evaluate.benchmark_rows(found, metric, tool)


def write_table(rows: DataFrame, path: str) -> None:
    """Write a small result as CSV with a header."""
    rows.write.mode("overwrite").csv(path, header=True)
