"""Registered queries over files: the documents, sketches and matrices are written in the formats that the readers take, and read again.

Everything is written below the shared folder of the session.
"""

from __future__ import annotations

import atexit
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import SketchParams
from ..operators import compare, matrix, sketch
from ..sources import exchange, fasta
from ..sources.shared import scratch
from . import sql, tools
from .catalog import EXACTLY, MAIN, SMALL, by_source, cells_at, documents, jaccard_cells, number, query, source_cells, source_sketch

#: Digits that bring a double back as it was.
EXACT = 17


def of_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("number", number()).where("number is not null")


def fasta_files(spark: SparkSession, sf_dir: str, compression: str) -> tuple[list[str], list[int]]:
    """Write each source as a collection of FASTA files; their paths and the numbers of the collections that they belong to."""
    folder = scratch(spark)
    docs = of_collections(spark, sf_dir)
    lines = fasta.fasta_lines(docs).join(docs.select("doc_id", "number").distinct(), "doc_id").select("number", "value")
    lines.write.partitionBy("number").option("compression", compression).text(folder)
    paths = sorted(spark.read.text(folder).inputFiles())
    return paths, [int(p.rsplit("number=", 1)[1].split("/")[0]) for p in paths]


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)} SELECT * FROM sk")
def fasta_file_sketch(spark, sf_dir):
    """Sketches of plain FASTA files, several of which make a collection."""
    return sketch.build(fasta.read_fasta(spark, *fasta_files(spark, sf_dir, "none")), MAIN)


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS} SELECT i, j, n_shared, jaccard FROM scores")
def fasta_file_jaccard(spark, sf_dir):
    """Similarities of compressed FASTA files."""
    held = sketch.build(fasta.read_fasta(spark, *fasta_files(spark, sf_dir, "gzip")), MAIN)
    return compare.all_pairs(held).select("i", "j", "n_shared", "jaccard")


@query(f"WITH {sql.sketch(SMALL, sql.SOURCE)} SELECT * FROM sk")
def hidden_fasta_sketch(spark, sf_dir):
    """Sketches of files that are taken for what their first bytes say."""
    return sketch.build(fasta.read_any_fasta(spark, *fasta_files(spark, sf_dir, "gzip"), SMALL.k), SMALL)


@query(f"WITH {sql.records()} SELECT seq, CAST(count(*) AS BIGINT) AS n FROM recs WHERE seq <> '' GROUP BY seq")
def fastq_records(spark, sf_dir):
    """Sequences of FASTQ files whose quality lines begin with the mark of a header."""
    folder = scratch(spark)
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "N")
    rows = documents(spark, sf_dir).where("doc_id is not null").select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("doc_id").cast("string")), F.concat(body, F.lit("N")), F.lit("+"), F.concat(F.lit("@"), F.repeat(F.lit("I"), F.length(body)))).alias("value"))
    rows.write.text(folder)
    return fasta.read_fastq(spark, spark.read.text(folder).inputFiles()).where("seq <> ''").groupBy("seq").agg(F.count("*").alias("n"))


def path_list(spark: SparkSession, sf_dir: str) -> str:
    """A file with a line for each collection: its number, cut to between two and four characters."""
    folder = scratch(spark)
    lines = of_collections(spark, sf_dir).select("number").distinct().select("number", F.expr("substr(concat(number, 'xyz'), 1, 2 + cast(number % 3 as int))").alias("value"))
    # One line a collection, as few as a matrix has rows.
    lines.orderBy("number").coalesce(1).select("value").write.text(folder)
    return folder


def _paths_sql(shortest: int) -> str:
    return f"""WITH n AS (SELECT DISTINCT {sql.SOURCE} AS number FROM documents WHERE {sql.SOURCE} IS NOT NULL),
l AS (SELECT CAST(row_number() OVER (ORDER BY number) - 1 AS BIGINT) AS ord, substr(number || 'xyz', 1, CAST(2 + number % 3 AS INT)) AS path FROM n)
SELECT ord, path FROM l WHERE length(path) >= {shortest}"""


@query(_paths_sql(fasta.BUILD))
def build_paths(spark, sf_dir):
    """A list of paths as sketching reads it: lines longer than three characters."""
    return fasta.read_paths(spark, path_list(spark, sf_dir), fasta.BUILD)


@query(_paths_sql(fasta.COMPARE))
def compare_paths(spark, sf_dir):
    """The same list as comparing reads it: lines longer than two characters."""
    return fasta.read_paths(spark, path_list(spark, sf_dir), fasta.COMPARE)


@query("SELECT doc_id, 'subsampled_' || split_part(source || '-' || doc_id, '.', 1) || '.gz' AS name FROM documents")
def output_names(spark, sf_dir):
    path = F.concat(F.lit("/data.d/"), "lang", F.lit("/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".v1.fa.gz"))
    return documents(spark, sf_dir).select("doc_id", fasta.output_name(path, "subsampled_").alias("name"))


def saved(spark: SparkSession, held: DataFrame, p: SketchParams = MAIN) -> str:
    """Save sketches and their parameters as a bucketed table in the shared folder, dropped when the driver ends; its name."""
    folder = scratch(spark)
    table = f"sketch_{folder.rsplit('-', 1)[1]}"
    names = held.select("sketch_id").distinct().withColumn("name", F.concat(F.lit("src"), F.col("sketch_id").cast("string")))
    sketch.write_sketches(held, sketch.meta_rows(names, p), table, 8, folder)
    atexit.register(_forget, spark, table)
    return table


def _forget(spark: SparkSession, table: str) -> None:
    with suppress(Exception):  # the session may be gone by then
        for name in (table, f"{table}_meta"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)} SELECT * FROM sk")
def sketch_table(spark, sf_dir):
    """Sketches saved and read again."""
    return spark.table(saved(spark, source_sketch(spark, sf_dir)))


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)} SELECT sketch_id, 'src' || sketch_id AS name, {MAIN.k} AS k, {MAIN.m} AS m, {float(MAIN.s)}::DOUBLE AS s, 1 AS abundance FROM sizes")
def sketch_headers(spark, sf_dir):
    """The parameters that sketches were saved with, once they are known to agree."""
    meta = spark.table(f"{saved(spark, source_sketch(spark, sf_dir))}_meta")
    agreed = sketch.agreed(meta)
    return meta.where((F.col("k") == agreed.k) & (F.col("m") == agreed.m) & (F.col("s") == agreed.s))


@query(f"""WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS}
SELECT i, j, containment_ij AS containment, jaccard FROM scores UNION ALL SELECT j, i, containment_ji, jaccard FROM scores""")
def compared_tables(spark, sf_dir):
    """Saved sketches compared with each other."""
    return tools.compare_tables(spark, saved(spark, source_sketch(spark, sf_dir)))[0]


def sketch_collection(spark: SparkSession, sf_dir: str) -> list[str]:
    """Write each source's sketch as a file; the files' paths as their list has them."""
    folder = scratch(spark)
    held = source_sketch(spark, sf_dir)
    name = F.concat(F.lit("src"), F.col("sketch_id").cast("string"), F.lit(".gz"))
    tools.write_sketch_files(held, held.select("sketch_id", name.alias("name")).distinct(), MAIN, folder, "made.txt")
    return tools.listed_paths(spark, f"{folder}/made.txt")


def numbers_of(paths: list[str]) -> list[int]:
    return [int(p.rsplit("src", 1)[1].split(".")[0]) for p in paths]


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)} SELECT sketch_id, minimizer, kmer FROM sk")
def sketch_file_kmers(spark, sf_dir):
    """Sketches written in the exchange format and read again."""
    paths = sketch_collection(spark, sf_dir)
    return exchange.read_sketches(spark, paths, MAIN, numbers_of(paths))


@query(f"WITH RECURSIVE {sql.rebuilt(MAIN, sql.SOURCE)} SELECT sketch_id, minimizer, seq FROM chains")
def sketch_file_superkmers(spark, sf_dir):
    """The super-k-mers that sketch files hold."""
    paths = sketch_collection(spark, sf_dir)
    return exchange.read_super_kmers(spark, paths, numbers_of(paths))


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)} SELECT sketch_id, {MAIN.k} AS k, {MAIN.m} AS m, CAST(sum(cnt) AS BIGINT) AS selected, {float(MAIN.s)}::DOUBLE AS rate FROM sk GROUP BY sketch_id")
def sketch_file_headers(spark, sf_dir):
    paths = sketch_collection(spark, sf_dir)
    return exchange.read_headers(spark, paths, numbers_of(paths))


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)} SELECT CAST(row_number() OVER (ORDER BY sketch_id) - 1 AS BIGINT) AS ord, 'src' || sketch_id || '.gz' AS name FROM sizes")
def sketch_file_list(spark, sf_dir):
    """The list of written sketches, in the order of the sketches."""
    return spark.createDataFrame([(i, p.rsplit("/", 1)[1]) for i, p in enumerate(sketch_collection(spark, sf_dir))], "ord bigint, name string")


@query(f"""WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS}
SELECT i, j, containment_ij AS containment, jaccard FROM scores UNION ALL SELECT j, i, containment_ji, jaccard FROM scores""")
def compared_files(spark, sf_dir):
    """Sketch files compared with each other."""
    paths = sketch_collection(spark, sf_dir)
    number = F.regexp_extract("name", "src([0-9]+)", 1).cast("bigint")
    scores, names = tools.compare_files(spark, paths)
    row, column = (names.select(F.col("sketch_id").alias(c), number.alias(f"{c}_")) for c in "ij")
    return scores.join(row, "i").join(column, "j").select(F.col("i_").alias("i"), F.col("j_").alias("j"), "containment", "jaccard")


def names_of(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("i").alias("sketch_id")).distinct().withColumn("name", F.concat(F.lit("src"), F.col("sketch_id").cast("string")))


def matrix_file(spark: SparkSession, cells: DataFrame) -> str:
    folder = scratch(spark)
    tools.write_matrix(cells, names_of(cells), folder, EXACT)
    return folder


PLACES = "o AS (SELECT sketch_id, CAST(row_number() OVER (ORDER BY sketch_id) - 1 AS BIGINT) AS place FROM sizes)"
CONTAINMENT = """dir AS (SELECT i, j, containment_ij AS c FROM scores UNION ALL SELECT j, i, containment_ji FROM scores),
cells AS (SELECT a.sketch_id AS i, b.sketch_id AS j, CASE WHEN a.sketch_id = b.sketch_id THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS value
FROM sizes a CROSS JOIN sizes b LEFT JOIN dir ON dir.i = a.sketch_id AND dir.j = b.sketch_id)"""
BY_PLACE = "SELECT r.place AS i, c.place AS j, value FROM cells JOIN o r ON i = r.sketch_id JOIN o c ON j = c.sketch_id"


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS},{sql.dense('jaccard')},{PLACES} {BY_PLACE}")
def jaccard_matrix_file(spark, sf_dir):
    """The Jaccard matrix written as text and read again, cells by their places."""
    return fasta.read_matrix(spark, matrix_file(spark, source_cells(spark, sf_dir)))


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS},{CONTAINMENT},{PLACES} {BY_PLACE}")
def containment_matrix_file(spark, sf_dir):
    return fasta.read_matrix(spark, matrix_file(spark, source_cells(spark, sf_dir, "containment")))


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS},{CONTAINMENT} SELECT j AS i, i AS j, value FROM cells")
def matrix_transposed(spark, sf_dir):
    return matrix.transpose(source_cells(spark, sf_dir, "containment"))


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS},{sql.dense('jaccard')}, o AS (SELECT sketch_id, CAST(row_number() OVER (ORDER BY n DESC, sketch_id) - 1 AS BIGINT) AS place FROM sizes) {BY_PLACE}")
def matrix_file_sorted(spark, sf_dir):
    """A matrix file put into the order of a list of paths."""
    held = source_sketch(spark, sf_dir)
    cells = jaccard_cells(held)
    read = fasta.read_matrix(spark, where := matrix_file(spark, cells))
    folder = scratch(spark)
    listed = compare.cardinality(held).orderBy(F.desc("n"), "sketch_id").select(F.concat(F.lit("x/y/src"), F.col("sketch_id").cast("string")).alias("value"))
    listed.coalesce(1).write.text(folder)
    return tools.sort_matrix(read, fasta.read_names(spark, where), fasta.read_paths(spark, folder, fasta.COMPARE))[0]


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS},{sql.dense('jaccard')},{PLACES} SELECT r.place AS i, c.place AS j, round(value, 12) AS value FROM cells JOIN o r ON i = r.sketch_id JOIN o c ON j = c.sketch_id")
def distance_file(spark, sf_dir):
    """A table of distances read as similarities."""
    cells, folder = source_cells(spark, sf_dir), scratch(spark)
    away = cells.withColumn("value", 1 - F.col("value"))
    lines = matrix.csv_lines(away, names_of(cells), EXACT).withColumn("text", F.concat(F.concat(F.lit("n"), F.col("line").cast("string")), F.lit(";"), F.regexp_replace("text", ",", ";")))
    lines.orderBy("line").select("text").write.text(folder)
    return fasta.read_distances(spark, folder).withColumn("value", F.round("value", 12))


@query(f"SELECT {sql.SOURCE} AS key, CAST(count(*) AS DOUBLE) AS ram, CAST(sum(length(coalesce(text, ''))) / 4 AS DOUBLE) AS time FROM documents WHERE {sql.SOURCE} IS NOT NULL GROUP BY ALL")
def benchmark_files(spark, sf_dir):
    """Resource tables, one file for each collection, whose number is in the file's name."""
    folder = scratch(spark)
    sums = of_collections(spark, sf_dir).groupBy("number").agg(F.count("*").alias("ram"), (F.sum(F.length(F.coalesce("text", F.lit("")))) / 4).alias("time"))
    line = F.concat_ws("\t", F.lit("x"), F.lit("y"), F.col("ram").cast("double").cast("string"), F.lit("z"), F.col("time").cast("string"))
    sums.select("number", F.concat(F.lit("a\tb\tmemory\tc\ttime\n"), line).alias("value")).repartition("number").write.partitionBy("number").text(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    system = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    paths = []
    for p in spark.read.text(folder).inputFiles():  # one for each collection
        paths.append(f"{folder}/run_{p.rsplit('number=', 1)[1].split('/')[0]}_of.tsv")
        system.rename(jvm.org.apache.hadoop.fs.Path(p), jvm.org.apache.hadoop.fs.Path(paths[-1]))
    return fasta.read_benchmarks(spark, paths).drop("name")


@query(f"""WITH b AS (SELECT {sql.SOURCE} AS number, doc_id, length(coalesce(text, '')) AS n FROM documents WHERE {sql.SOURCE} IS NOT NULL)
SELECT number, sum(length(CAST(doc_id AS VARCHAR)) + n + CASE WHEN n > 0 THEN (n - 1) // 60 ELSE 0 END + 3) / 1048576.0::DOUBLE AS mib FROM b GROUP BY number""")
def fasta_sizes(spark, sf_dir):
    """Sizes of the collections' FASTA files."""
    paths, _ = fasta_files(spark, sf_dir, "none")
    of = F.regexp_extract("path", "number=([0-9]+)", 1).cast("bigint")
    return fasta.read_sizes(spark, paths).groupBy(of.alias("number")).agg((F.sum((F.col("mib") * 1048576).cast("bigint")) / 1048576.0).alias("mib"))


ERROR_RATES = (2, 8)


def _errors_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT round(abs((SELECT avg(value) FROM exact) - avg(value)), 9) AS value, 'error' AS type, CAST({s} AS BIGINT) AS threshold, CAST((SELECT sum(n) FROM sizes{s}) AS DOUBLE) AS size, 'sketch' AS tool FROM cells{s}" for s in ERROR_RATES
    )
    parts = ",".join(
        f"""k{s} AS (SELECT * FROM all_k WHERE minimizer IN (SELECT minimizer FROM mins WHERE ho <= {sql.ordered(SketchParams(MAIN.k, MAIN.m, s).threshold())})),
sizes{s} AS (SELECT sketch_id, CAST(count(*) AS BIGINT) AS n FROM k{s} GROUP BY sketch_id),
pairs{s} AS (SELECT a.sketch_id AS i, b.sketch_id AS j, count(*) AS n_shared FROM k{s} a JOIN k{s} b ON a.kmer = b.kmer AND a.sketch_id < b.sketch_id GROUP BY ALL),
scores{s} AS (SELECT i, j, n_shared::DOUBLE / (x.n + y.n - n_shared) AS jaccard FROM pairs{s} JOIN sizes{s} x ON i = x.sketch_id JOIN sizes{s} y ON j = y.sketch_id),{sql.dense('jaccard', f'scores{s}', f'sizes{s}', f'cells{s}')}"""
        for s in ERROR_RATES
    )
    return f"WITH {sql.both(MAIN, sql.SOURCE)},{parts} {rows}"


@query(_errors_sql())
def error_table_file(spark, sf_dir):
    """Errors at several rates, all from one pass over the sequences, written as a table and read again."""
    cells, counts = cells_at(by_source(spark, sf_dir), {"exact": EXACTLY, **{f"s{s}": SketchParams(MAIN.k, MAIN.m, s) for s in ERROR_RATES}})
    sizes = counts.agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in ERROR_RATES)).first()
    table = tools.error_table(cells["exact"], {s: cells[f"s{s}"] for s in ERROR_RATES}, "size", {s: sizes[f"s{s}"] for s in ERROR_RATES}, "sketch")
    folder = scratch(spark)
    tools.write_table(table, folder)
    kind = "value double, type string, threshold bigint, size double, tool string"
    return spark.read.schema(kind).csv(folder, header=True).withColumn("value", F.round("value", 9))

