"""Readers of sequence collections, path lists and result files."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna
from .shared import written
from .streams import FastaStreams

#: Shortest lines that count as paths: where sketches are built, and where they are compared.
BUILD, COMPARE = 4, 3
#: Most rows (a file or a piece of one each) of a table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1 << 17


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines that aren't blank with their number (from 0) in their file: file, line and value.

    Lines are numbered inside the pieces that a file is read in; the offsets of
    the pieces (one row each) are sums of counts, so a file of any size is read
    by many tasks.
    """
    rows = spark.read.text(paths).where(F.length(F.trim("value")) > 0)
    rows = rows.select(_file().alias("file"), F.col("_metadata.file_block_start").alias("at"), F.regexp_replace("value", r"\r$", "").alias("value"))
    rows = rows.withColumn("n", F.monotonically_increasing_id())
    pieces = rows.groupBy("file", "at").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    told = written(pieces.select("file", "at", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")))
    return looked_up(rows, told, ["file", "at"], told.count()).select("file", (F.col("n") + F.col("shift")).alias("line"), "value")


def looked_up(rows: DataFrame, told: DataFrame, key: str | list[str], n: int) -> DataFrame:
    """Rows joined with a table of n rows, which is broadcast if n is at most ``BROADCAST_ROWS``."""
    return rows.join(F.broadcast(told) if n <= BROADCAST_ROWS else told, key)


def read_paths(spark: SparkSession, path: str, shortest: int) -> DataFrame:
    """A list of paths, one a line: ord and path, in the order of the lines.  Lines shorter than ``shortest`` (``BUILD`` or ``COMPARE``) are skipped."""
    return numbered_lines(spark, path).where(F.length("value") >= shortest).select(F.col("line").alias("ord"), F.col("value").alias("path"))


def _plain(file: str) -> str:
    """A file's address with one slash after a scheme that names no host (``file:///x`` and ``file:/x`` are the same)."""
    return re.sub("^([a-z0-9.+-]+):///", r"\1:/", file)


def _file() -> Column:
    """The same of the file that a row comes from."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9.+-]+):///", "$1:/")


def located(spark: SparkSession, paths: list[str], ids: list[int] | None = None) -> DataFrame:
    """sketch_id, path and file (the path as Spark names it) of each listed file; an error if one doesn't exist.

    A path may be listed several times; ids are places in the list unless given.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for sketch_id, path in zip(range(len(paths)) if ids is None else ids, paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(conf)
        if not system.exists(at):
            raise FileNotFoundError(path)
        rows.append((int(sketch_id), path, _plain(system.makeQualified(at).toUri().toString())))
    return spark.createDataFrame(rows, "sketch_id bigint, path string, file string")


def _escaped(paths: list[str]) -> list[str]:
    """Each path once, with what readers take for patterns told apart."""
    marks = str.maketrans({c: f"\\{c}" for c in "*?[]{}"})
    return sorted({p.translate(marks) for p in paths})


def read_fasta(spark: SparkSession, paths: list[str], ids: list[int] | None = None) -> DataFrame:
    """Records of FASTA files that are plain or compressed as their names say: sketch_id, rec_id and seq.

    Files are split at ``\\n>``, so a record is a row however large the file
    is.  A record's first line is its header and dropped whatever it is.  The
    sketch_id is the file's place in ``paths`` (or its number in ``ids``, so that
    several files can be one sketch); a file listed twice is read for both.
    Files are matched by their whole paths; one that doesn't exist is an error.
    """
    listed = located(spark, paths, ids).drop("path")
    rows = spark.read.option("lineSep", "\n>").text(_escaped(paths)).select("value", _file().alias("file"))
    return _records(looked_up(rows, listed, "file", len(paths)).select("sketch_id", "value"))


def read_any_fasta(spark: SparkSession, paths: list[str], ids: list[int] | None = None, k: int | None = None) -> DataFrame:
    """Like :func:`read_fasta` for files whose names hide that they are gzip or zlib streams.

    Each file is inflated piece by piece in one task, so it may be of any size.
    With ``k``, long records come as rows that overlap by k-1 bases (and have
    their offset in ``base``), which is what sketching k-mers of that size takes:
    then no row holds more than about a million bases.
    """
    located(spark, paths, ids)  # an error if a file doesn't exist
    spark.dataSource.register(FastaStreams)
    told = spark.createDataFrame([(i, int(own)) for i, own in enumerate(range(len(paths)) if ids is None else ids)], "place bigint, sketch_id bigint")
    cut = {} if k is None else {"overlap": k - 1}
    rows = looked_up(spark.read.format("fasta_streams").options(paths=json.dumps(paths), **cut).load(), told, "place", len(paths))
    # Records of several files can belong to one sketch.
    numbered = F.col("place") * (1 << 40) + F.col("record")
    return rows.select("sketch_id", numbered.alias("rec_id"), *([] if k is None else ["base"]), "seq")


def _records(rows: DataFrame) -> DataFrame:
    """sketch_id, rec_id and seq of raw records, each with its header line."""
    body = F.regexp_replace("value", r"^[^\n]*(\n|$)", "")
    return rows.select("sketch_id", F.monotonically_increasing_id().alias("rec_id"), dna.clean(body).alias("seq"))


def read_fastq(spark: SparkSession, paths: list[str], ids: list[int] | None = None) -> DataFrame:
    """Records of FASTQ files of four lines each: the second of every four is the sequence, whatever quality lines begin with."""
    listed = located(spark, paths, ids).drop("path")
    rows = looked_up(numbered_lines(spark, _escaped(paths)).where("line % 4 = 1"), listed, "file", len(paths))
    return rows.select("sketch_id", F.floor(F.col("line") / 4).alias("rec_id"), dna.clean(F.col("value")).alias("seq"))


def records_of(documents: DataFrame, sketch: str | None = None, gaps: bool = False) -> DataFrame:
    """Texts as sequences: a sketch for each document, or for each value of a column of whole numbers; rows without one belong to no sketch.

    Letters other than ACGT are deleted; with ``gaps`` they stay as gaps that no
    k-mer spans, so offsets are those of the text.
    """
    seq = (dna.with_gaps if gaps else dna.clean)(F.coalesce("text", F.lit("")))
    rows = documents.select(F.col(sketch or "doc_id").cast("bigint").alias("sketch_id"), F.col("doc_id").alias("rec_id"), seq.alias("seq"))
    return rows.where("sketch_id is not null")


def fasta_lines(documents: DataFrame, width: int = 60) -> DataFrame:
    """Documents as FASTA records (doc_id and value): a header, then the text's letters in lines of bounded length; anything else is N."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "N"), f"(.{{{width}}})(?=.)", "$1\n")
    return documents.select("doc_id", F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), body).alias("value"))


def _table_of(lines: DataFrame, separator: str, skip: int) -> DataFrame:
    """Cells (i, j, value as text) of lines of separated fields, the header and the first ``skip`` fields left out; part files follow each other."""
    cells = lines.where("line > 0").select((F.col("line") - 1).alias("i"), F.posexplode(F.slice(F.split("value", separator), skip + 1, 1 << 30)).alias("j", "value"))
    return cells.where("value <> ''").select("i", F.col("j").cast("bigint").alias("j"), F.col("value").cast("double").alias("value"))


def _one_file(lines: DataFrame) -> DataFrame:
    """Lines numbered over all files of a folder, in order of their names (a count for each file comes to the driver)."""
    counts = lines.groupBy("file").agg(F.count("*").alias("rows")).orderBy("file").collect()
    shift, rows = 0, []
    for c in counts:
        rows.append((c["file"], shift))
        shift += c["rows"]
    told = lines.sparkSession.createDataFrame(rows, "file string, shift bigint")
    return looked_up(lines, told, "file", len(rows)).select((F.col("line") + F.col("shift")).alias("line"), "value")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix of scores in CSV (header of names, then rows), a file or a folder of parts: i, j and value; compressed files by their names."""
    return _table_of(_one_file(numbered_lines(spark, path)), ",", 0)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """The names in a matrix's header: sketch_id (place) and name."""
    header = _one_file(numbered_lines(spark, path)).where("line = 0")
    return header.select(F.posexplode(F.split("value", ",")).alias("sketch_id", "name")).select(F.col("sketch_id").cast("bigint").alias("sketch_id"), "name")


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """A table of distances (``;``, first column a name) as similarities: i, j and value = 1 - distance."""
    return _table_of(_one_file(numbered_lines(spark, path)), ";", 1).withColumn("value", 1 - F.col("value"))


def read_benchmarks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Resource tables (a header, then a line; third field memory, last one time): name, key (first number of the file's name), ram and time."""
    rows = numbered_lines(spark, paths).where("line = 1").select(F.regexp_extract("file", "([^/]*)$", 1).alias("name"), F.split("value", "\t").alias("f"))
    return rows.select("name", F.regexp_extract("name", r"(\d+)", 1).try_cast("bigint").alias("key"), F.get("f", F.lit(2)).cast("double").alias("ram"), F.element_at("f", -1).cast("double").alias("time"))


def read_sizes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sizes of files in MiB: path, name and mib."""
    return spark.read.format("binaryFile").load(paths).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), (F.col("length") / 1048576).alias("mib"))


def output_name(path: Column, prefix: str) -> Column:
    """Name of a sketch: a prefix, the file's name up to its first dot, and ``.gz``."""
    return F.concat(F.lit(prefix), F.substring_index(F.regexp_extract(path, "([^/]*)$", 1), ".", 1), F.lit(".gz"))
