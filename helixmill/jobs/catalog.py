"""Registered queries: each operator applied to the whole of its table.

Texts of ``documents`` serve as sequences: only the letters ACGT count.  A
sketch is made for each document, or, for dense matrices and accuracy, for each
source (20 collections of many records).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, packing, tables
from ..functions.params import SketchParams, ordered
from ..operators import compare, evaluate, matrix, minimizers, segments, sketch, superkmers
from ..sources.fasta import records_of
from ..sources.shared import written
from ..streaming.comparison import compare_once
from ..streaming.folder import sketch_once
from . import sql

SMALL = SketchParams(15, 5, 4)
MAIN = SketchParams(21, 7, 4)
WIDE = SketchParams(31, 11, 10)
LONG = SketchParams(33, 11, 10)
CLASSED = SketchParams(21, 7, 4, order="decycling")
RATES = (2, 4, 8, 16, 1000)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def number() -> Column:
    """A source's number; documents whose source has none belong to no collection."""
    return F.regexp_extract("source", "([0-9]+)", 1).try_cast("bigint")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(documents(spark, sf_dir))


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(documents(spark, sf_dir).withColumn("number", number()), "number")


def by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as queries, numbered below every source."""
    numbered = documents(spark, sf_dir).withColumn("number", -F.ascii("lang").cast("bigint") * 256 - F.ascii(F.substring("lang", 2, 1)))
    return records_of(numbered, "number")


LANGUAGE = "-CAST(ascii(lang) AS BIGINT) * 256 - ascii(substr(lang, 2, 1))"


def query(text: str | None) -> Callable[[Query], Query]:
    """Register a query, with SQL for the same result if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def of_seq(column: Column, name: str) -> Query:
    return lambda spark, sf_dir: by_document(spark, sf_dir).select(F.col("sketch_id").alias("doc_id"), column.alias(name))


# Scalars.


@query(f"WITH {sql.records()} SELECT sketch_id AS doc_id, seq FROM recs")
def clean_dna(spark, sf_dir):
    return of_seq(F.col("seq"), "seq")(spark, sf_dir)


@query(f"WITH {sql.records()} SELECT sketch_id AS doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM recs")
def reverse_complement(spark, sf_dir):
    return of_seq(dna.reverse_complement(F.col("seq")), "rc")(spark, sf_dir)


@query(f"WITH {sql.records()} SELECT sketch_id AS doc_id, translate(seq, 'ACTG', '0123') AS digits FROM recs")
def nuc_encode(spark, sf_dir):
    return of_seq(dna.digits(F.col("seq")), "digits")(spark, sf_dir)


def positions_sql(size: int) -> str:
    """CTEs up to ``spot`` (doc_id, pos, word): every word of so many bases."""
    return f"{sql.records()}, spot AS (SELECT sketch_id AS doc_id, pos, substr(seq, CAST(pos + 1 AS INT), {size}) AS word FROM (SELECT sketch_id, seq, unnest(generate_series(0, length(seq) - {size})) AS pos FROM recs WHERE length(seq) >= {size}))"


@query(f"WITH {positions_sql(31)} SELECT doc_id, CAST(pos AS BIGINT) AS pos, word, {sql.fold("translate(word, 'ACTG', '0123')")} AS code FROM spot")
def num_decode(spark, sf_dir):
    """Every word of 31 bases as a number, and the bases that the number stands for."""
    found = minimizers.mmers(by_document(spark, sf_dir), 31)
    return found.select(F.col("sketch_id").alias("doc_id"), "pos", dna.text_of(F.col("code"), 31).alias("word"), "code")


@query(f"WITH {positions_sql(31)}, d AS (SELECT doc_id, pos, translate(word, 'ACTG', '0123') AS x FROM spot) SELECT doc_id, CAST(pos AS BIGINT) AS pos, {sql.kmer(WIDE, 'x')} AS kmer FROM d")
def canonical_kmer(spark, sf_dir):
    return minimizers.kmers(by_document(spark, sf_dir), WIDE).select(F.col("sketch_id").alias("doc_id"), "pos", "kmer")


@query(f"WITH {positions_sql(11)}, dd AS (SELECT doc_id, pos, translate(word, 'ACTG', '0123') AS x FROM spot), dc AS (SELECT doc_id, pos, least(x, {sql.turned('x')}) AS cd FROM dd), u AS (SELECT DISTINCT cd FROM dc),{sql.hashes('u')} SELECT doc_id, CAST(pos AS BIGINT) AS pos, cm AS mmer, ho FROM dc JOIN hashed USING (cd)")
def mmer_hash(spark, sf_dir):
    return minimizers.mmers(by_document(spark, sf_dir), 11).select(F.col("sketch_id").alias("doc_id"), "pos", "mmer", "ho")


def _rates_sql(p: SketchParams) -> str:
    rows = ", ".join(f"({s}, {ordered(SketchParams(p.k, p.m, s).threshold())})" for s in RATES)
    return f"WITH {sql.minimizers(p)}, r(s, t) AS (VALUES {rows}) SELECT CAST(s AS BIGINT) AS s, CAST(t AS BIGINT) AS threshold, CAST(count(ho) AS BIGINT) AS n_selected FROM r LEFT JOIN mins ON ho <= t GROUP BY s, t"


@query(_rates_sql(MAIN))
def selection_threshold(spark, sf_dir):
    """k-mers that the threshold of each rate selects: one pass over all minimizers."""
    limits = {s: ordered(SketchParams(MAIN.k, MAIN.m, s).threshold()) for s in RATES}
    counts = [F.count(F.when(F.col("ho") <= F.lit(t).cast("bigint"), 1)).alias(f"s{s}") for s, t in limits.items()]
    one = minimizers.minimizers(by_document(spark, sf_dir), MAIN).agg(*counts)
    rows = F.explode(F.array(*[F.struct(F.lit(s).cast("bigint").alias("s"), F.lit(t).cast("bigint").alias("threshold"), F.col(f"s{s}").alias("n_selected")) for s, t in limits.items()]))
    return one.select(rows.alias("r")).select("r.*")


# Records and k-mers.


@query(f"WITH {sql.records()} SELECT sketch_id, rec_id, CAST(length(seq) AS BIGINT) AS n_bases FROM recs")
def fasta_records(spark, sf_dir):
    return by_document(spark, sf_dir).select("sketch_id", "rec_id", F.length("seq").cast("bigint").alias("n_bases"))


@query(f"WITH {sql.records()} SELECT sketch_id, CAST(length(seq) - 30 AS BIGINT) AS n_kmers FROM recs WHERE length(seq) >= 31")
def short_record_filter(spark, sf_dir):
    return sketch.total_kmers(by_document(spark, sf_dir), WIDE).withColumnRenamed("total_kmers", "n_kmers")


@query(f"WITH {sql.records()}, d AS (SELECT sketch_id, translate(seq, 'ACTG', '0123') AS d FROM recs WHERE length(seq) >= 21), x AS (SELECT sketch_id, d, unnest(generate_series(0, length(d) - 21)) AS pos FROM d) SELECT sketch_id, CAST(pos AS BIGINT) AS pos, {sql.kmer(MAIN, 'substr(d, pos + 1, 21)')} AS kmer FROM x")
def kmer_explode(spark, sf_dir):
    return minimizers.kmers(by_document(spark, sf_dir), MAIN).select("sketch_id", "pos", "kmer")


SPECTRUM = f"WITH {sql.records()}, d AS (SELECT sketch_id, translate(seq, 'ACTG', '0123') AS d FROM recs WHERE length(seq) >= 21), x AS (SELECT sketch_id, d, unnest(generate_series(0, length(d) - 21)) AS pos FROM d), y AS (SELECT sketch_id, {sql.kmer(MAIN, 'substr(d, pos + 1, 21)')} AS kmer FROM x) SELECT sketch_id, kmer, CAST(count(*) AS BIGINT) AS cnt FROM y GROUP BY ALL"


@query(SPECTRUM)
def kmer_spectrum(spark, sf_dir):
    return sketch.spectrum(by_document(spark, sf_dir), MAIN)


@query(SPECTRUM + " HAVING count(*) >= 2")
def kmer_abundance_filter(spark, sf_dir):
    return sketch.spectrum(by_document(spark, sf_dir), MAIN).where("cnt >= 2")


# Minimizers and super-k-mers.


@query(f"WITH {sql.minimizers(MAIN)} SELECT sketch_id, CAST(pos AS BIGINT) AS pos, minimizer, ho, CAST(mpos AS BIGINT) AS mpos, is_rev FROM mins")
def minimizer_per_kmer(spark, sf_dir):
    return minimizers.minimizers(by_document(spark, sf_dir), MAIN).select("sketch_id", "pos", "minimizer", "ho", "mpos", "is_rev")


@query(f"WITH {sql.minimizers(MAIN)} SELECT minimizer, CAST(count(*) AS BIGINT) AS n_kmers, CAST(count(DISTINCT sketch_id) AS BIGINT) AS n_sketches FROM mins GROUP BY minimizer")
def minimizer_frequency(spark, sf_dir):
    # Counted by sketch first, so no shuffled row stands for less than a sketch's k-mers of a minimizer.
    each = minimizers.minimizers(by_document(spark, sf_dir), MAIN).groupBy("minimizer", "sketch_id").agg(F.count("*").alias("n"))
    return each.groupBy("minimizer").agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_sketches"))


SEGMENT = "sketch_id, start, len, n_kmers, minimizer, ho, is_rev, is_maximal, selected"


@query(f"WITH {sql.segments(MAIN)} SELECT {SEGMENT} FROM seg")
def super_kmers(spark, sf_dir):
    return superkmers.super_kmers(by_document(spark, sf_dir), MAIN).drop("rec_id")


@query(f"WITH RECURSIVE {sql.tracked(MAIN)} SELECT {SEGMENT} FROM cut")
def superkmers_compat(spark, sf_dir):
    """Super-k-mers as a scan cuts them that remembers one position."""
    return segments.tracked_super_kmers(by_document(spark, sf_dir), MAIN).drop("rec_id")


@query(f"WITH {sql.segments(MAIN)} SELECT sketch_id, CAST(count(*) AS BIGINT) AS n_superkmers, CAST(sum(is_maximal::INT) AS BIGINT) AS n_maximal, CAST(sum((is_maximal AND selected)::INT) AS BIGINT) AS n_selected_maximal FROM seg GROUP BY sketch_id")
def maximal_super_kmers(spark, sf_dir):
    count = lambda c: F.count(F.when(c, 1))
    return superkmers.super_kmers(by_document(spark, sf_dir), MAIN).groupBy("sketch_id").agg(
        F.count("*").alias("n_superkmers"),
        count(F.col("is_maximal")).alias("n_maximal"),
        count(F.col("is_maximal") & F.col("selected")).alias("n_selected_maximal"),
    )


DENSITY = f"""cov AS (SELECT *, lag(start + len - {MAIN.m} + 1) OVER (PARTITION BY sketch_id, rec_id ORDER BY start) AS pe FROM seg WHERE selected),
n AS (SELECT sketch_id, CAST(sum(len - {MAIN.m} + 1 - greatest(0, coalesce(pe, start) - start)) AS BIGINT) AS n_mmers, CAST(count(*) AS BIGINT) AS n_selected FROM cov GROUP BY sketch_id)"""


def density_query(p: SketchParams) -> tuple[str, Query]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        segments = superkmers.super_kmers(by_document(spark, sf_dir), p)
        chosen = segments.where("selected").groupBy("sketch_id").agg(F.count("*").alias("n_selected"))
        joined = superkmers.covered_mmers(segments, p).join(chosen, "sketch_id")
        return joined.select("sketch_id", "n_mmers", "n_selected", (F.col("n_selected").cast("double") / F.col("n_mmers") * (p.window + 1)).alias("density"))

    return f"WITH {sql.segments(p)}, {DENSITY} SELECT sketch_id, n_mmers, n_selected, n_selected::DOUBLE / n_mmers * {p.window + 1} AS density FROM n", run


for _name, _p in {"superkmer_density": MAIN, "density_decycling": CLASSED}.items():
    SQL[_name], QUERIES[_name] = density_query(_p)


@query(f"WITH RECURSIVE {sql.rebuilt(MAIN)} SELECT * FROM chains")
def superkmer_rebuild(spark, sf_dir):
    """Each document's sketch packed into as few super-k-mers as can be."""
    return superkmers.rebuild(sketch.build(by_document(spark, sf_dir), MAIN), MAIN)


@query(f"WITH {sql.sketch(MAIN)} SELECT sketch_id, kmer FROM sk")
def rebuilt_kmers(spark, sf_dir):
    """The k-mers that rebuilt super-k-mers hold: those of the sketch."""
    return superkmers.kmers_of(superkmer_rebuild(spark, sf_dir), MAIN)


SEQUENCES = f"{sql.segments(MAIN)}, long AS (SELECT seg.*, CASE WHEN is_rev THEN translate(reverse(substr(seq, CAST(start + 1 AS INT), CAST(len AS INT))), 'ACGT', 'TGCA') ELSE substr(seq, CAST(start + 1 AS INT), CAST(len AS INT)) END AS word FROM seg JOIN recs USING (sketch_id, rec_id) WHERE selected)"


def selected_sequences(spark, sf_dir) -> DataFrame:
    return superkmers.super_kmers(by_document(spark, sf_dir), MAIN, with_seq=True).where("selected")


@query(f"WITH {SEQUENCES} SELECT sketch_id, start, word AS seq FROM long")
def superkmer_sequences(spark, sf_dir):
    """Selected super-k-mers, read so that the minimizer is in its canonical form."""
    return superkmers.oriented(selected_sequences(spark, sf_dir)).select("sketch_id", "start", "seq")


@query(f"WITH {SEQUENCES} SELECT sketch_id, start, minimizer, substr(word, 1, 14) AS \"left\", substr(word, 22, 14) AS \"right\", word AS seq FROM long WHERE is_maximal")
def maximal_flanks(spark, sf_dir):
    """Maximal super-k-mers as stored (minimizer and flanks), and put together again."""
    parts = superkmers.flanks(selected_sequences(spark, sf_dir), MAIN).drop("rec_id")
    return parts.withColumn("seq", dna.with_minimizer(F.col("left"), dna.text_of(F.col("minimizer"), MAIN.m), F.col("right")))


@query(f"WITH {sql.sketch(MAIN)} SELECT sketch_id, kmer FROM sk")
def superkmer_kmers(spark, sf_dir):
    """Sketches decoded from their super-k-mers."""
    return superkmers.kmers_of(selected_sequences(spark, sf_dir), MAIN)


DECYCLING = f"""WITH {positions_sql(MAIN.m)}, w AS (SELECT translate(word, 'ACTG', '0123') AS md, count(*) AS n FROM spot GROUP BY ALL)
SELECT CAST({sql.decycling("md", MAIN.m)} AS INTEGER) AS "class", CAST(sum(n) AS BIGINT) AS n_mmers, CAST(count(*) AS BIGINT) AS n_distinct FROM w GROUP BY ALL"""


@query(DECYCLING)
def decycling_class(spark, sf_dir):
    """How many m-mers of all documents are in each class of the decycling set."""
    each = minimizers.mmers(by_document(spark, sf_dir), MAIN.m).groupBy("code").agg(F.count("*").alias("n"))
    digits = F.lpad(F.conv(F.col("code").cast("string"), 10, 4), MAIN.m, "0")
    return each.groupBy(dna.decycling_class(digits, MAIN.m).alias("class")).agg(F.sum("n").alias("n_mmers"), F.count("*").alias("n_distinct"))


# Sketches.


def main_sketch(spark, sf_dir, p: SketchParams = MAIN) -> DataFrame:
    return sketch.build(by_document(spark, sf_dir), p)


def paired(spark, sf_dir, p: SketchParams = MAIN) -> DataFrame:
    """Sketches as a comparison reads them, made once."""
    return compare.spread(written(main_sketch(spark, sf_dir, p).select("sketch_id", "minimizer", "kmer")))


def all_pairs(spark, sf_dir, p: SketchParams = MAIN) -> DataFrame:
    return compare.all_pairs(paired(spark, sf_dir, p))


def pairs_sql(p: SketchParams, columns: str, where: str = "", of: str = "doc_id") -> str:
    return f"WITH {sql.sketch(p, of)},{sql.PAIRS} SELECT {columns} FROM scores {where}"


def sketch_query(p: SketchParams) -> tuple[str, Query]:
    return f"WITH {sql.sketch(p)} SELECT * FROM sk", lambda spark, sf_dir: sketch.build(by_document(spark, sf_dir), p)


for _name, _p in {
    "sketch_kmers": MAIN,
    "sketch_abundance2": SketchParams(MAIN.k, MAIN.m, MAIN.s, 2),
    "sketch_fracminhash": SketchParams(MAIN.k, MAIN.m, MAIN.s, 1, "fracminhash"),
    "sketch_k31": WIDE,
    "sketch_decycling": CLASSED,
}.items():
    SQL[_name], QUERIES[_name] = sketch_query(_p)


@query(f"WITH {sql.sketch(LONG)} SELECT sketch_id, minimizer, kmer.hi AS kmer_hi, kmer.lo AS kmer_lo, cnt, pos_min FROM sk")
def sketch_k33(spark, sf_dir):
    """k-mers of 66 bits, their keys in two parts."""
    found = sketch.build(by_document(spark, sf_dir), LONG)
    return found.select("sketch_id", "minimizer", F.col("kmer.hi").alias("kmer_hi"), F.col("kmer.lo").alias("kmer_lo"), "cnt", "pos_min")


@query(pairs_sql(LONG, "i, j, n_shared, jaccard"))
def jaccard_pairs_k33(spark, sf_dir):
    return all_pairs(spark, sf_dir, LONG).select("i", "j", "n_shared", "jaccard")


METRICS = f"""WITH {sql.sketch(MAIN)}, seg AS (SELECT sketch_id, rec_id, min(pos) AS start, count(*) + {MAIN.k - 1} AS len, count(*) AS n_kmers, count(*) = {MAIN.window} AS is_maximal, any_value(ho) <= {ordered(MAIN.threshold())} AS selected FROM mins GROUP BY sketch_id, rec_id, mpos),
{DENSITY},
s AS (SELECT sketch_id, CAST(sum(n_kmers) AS BIGINT) AS total_kmers, CAST(count(*) AS BIGINT) AS total_superkmers, CAST(sum(is_maximal::INT) AS BIGINT) AS maximal_superkmers,
      CAST(sum(CASE WHEN selected THEN n_kmers ELSE 0 END) AS BIGINT) AS selected_kmers, CAST(sum(selected::INT) AS BIGINT) AS selected_superkmers, CAST(sum((selected AND is_maximal)::INT) AS BIGINT) AS selected_maximal FROM seg GROUP BY sketch_id),
k AS (SELECT sketch_id, CAST(count(*) AS BIGINT) AS distinct_kmers, CAST(count(DISTINCT minimizer) AS BIGINT) AS minimizers, CAST(count(*) AS BIGINT) AS kept_kmers FROM sk GROUP BY sketch_id),
j AS (SELECT s.*, coalesce(distinct_kmers, 0) AS distinct_kmers, coalesce(minimizers, 0) AS minimizers, coalesce(kept_kmers, 0) AS kept_kmers, coalesce(n_mmers, 0) AS n_mmers FROM s LEFT JOIN k USING (sketch_id) LEFT JOIN n USING (sketch_id))
SELECT *, total_kmers::DOUBLE / nullif(selected_kmers, 0) AS rate_with_duplicates, total_kmers::DOUBLE / nullif(distinct_kmers, 0) AS rate_distinct,
  total_superkmers::DOUBLE / nullif(selected_superkmers, 0) AS superkmer_rate, total_kmers::DOUBLE / nullif(total_superkmers, 0) AS kmers_per_superkmer,
  selected_kmers::DOUBLE / nullif(selected_superkmers, 0) AS kmers_per_selected, selected_superkmers::DOUBLE / nullif(n_mmers, 0) * {MAIN.window + 1} AS density FROM j"""


@query(METRICS)
def sketch_metrics(spark, sf_dir):
    return sketch.metrics(by_document(spark, sf_dir), MAIN)


@query(f"WITH {sql.sketch(MAIN)} SELECT minimizer, CAST(count(DISTINCT kmer) AS BIGINT) AS n_kmers, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT sketch_id) AS BIGINT) AS n_sketches FROM sk GROUP BY minimizer")
def bucket_sizes(spark, sf_dir):
    return sketch.build(by_document(spark, sf_dir), MAIN).groupBy("minimizer").agg(F.countDistinct("kmer").alias("n_kmers"), F.count("*").alias("n_rows"), F.countDistinct("sketch_id").alias("n_sketches"))


_BYTE = " + ".join(f"{4 ** (3 - i)} * (instr('ACTG', substr(padded, CAST(i4 + {i + 1} AS INT), 1)) - 1)" for i in range(4))


@query(f"""WITH {SEQUENCES}, pad AS (SELECT sketch_id, start, len, word, rpad(word, CAST((len + 3) // 4 * 4 AS INT), 'A') AS padded FROM long)
SELECT sketch_id, start, printf('%02X', CAST(len % 4 AS INT)) || array_to_string(list_transform(generate_series(0, CAST(length(padded) - 1 AS BIGINT), 4), lambda i4: printf('%02X', CAST({_BYTE} AS INT))), '') AS packed_hex, word AS unpacked FROM pad""")
def sketch_pack(spark, sf_dir):
    """Selected super-k-mers at two bits a base, and back."""
    found = superkmers.oriented(selected_sequences(spark, sf_dir)).select("sketch_id", "start", packing.pack(F.col("seq")).alias("packed"))
    return found.select("sketch_id", "start", F.hex("packed").alias("packed_hex"), packing.unpack(F.col("packed")).alias("unpacked"))


_OUTPUT = f"""WITH RECURSIVE {sql.rebuilt(MAIN)},
sized AS (SELECT *, length(seq) = {MAIN.longest} AS maximal, 1 + ceil(CASE WHEN length(seq) = {MAIN.longest} THEN length(seq) - {MAIN.m} ELSE length(seq) END / 4.0) AS bytes FROM chains),
sums AS (SELECT sketch_id, CAST(count(*) AS BIGINT) AS rebuilt, CAST(sum(maximal::INT) AS BIGINT) AS rebuilt_maximal, CAST(sum(n_kmers) AS BIGINT) AS kmers, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(count(DISTINCT minimizer) AS BIGINT) AS minimizers FROM sized GROUP BY sketch_id)
SELECT sketch_id, rebuilt, rebuilt_maximal, kmers::DOUBLE / rebuilt AS kmers_per_rebuilt, (rebuilt_maximal * 100)::DOUBLE / rebuilt AS maximal_percent, bytes::DOUBLE / 1000 AS output_kb,
  (bytes * 8)::DOUBLE / kmers AS bits_per_kmer, minimizers, rebuilt // minimizers AS superkmers_per_minimizer FROM sums"""


@query(_OUTPUT)
def output_metrics(spark, sf_dir):
    """What packing each sketch into super-k-mers gives."""
    return sketch.output_metrics(by_document(spark, sf_dir), MAIN)


@query(f"WITH {sql.records()} SELECT sketch_id, format('{{:,}}', CAST(sum(length(seq) - 20) AS BIGINT)) AS n_kmers FROM recs WHERE length(seq) >= 21 GROUP BY sketch_id")
def formatted_counts(spark, sf_dir):
    return sketch.total_kmers(by_document(spark, sf_dir), MAIN).select("sketch_id", dna.thousands(F.col("total_kmers")).alias("n_kmers"))


@query(f"WITH {sql.sketch(MAIN)} SELECT * FROM sk")
def stream_sketch(spark, sf_dir):
    """The sketch of all documents, made file by file by a stream."""
    table = documents(spark, sf_dir)
    arriving = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parque[t]")
    return sketch_once(records_of(arriving), MAIN)


GAPPED = SketchParams(5, 3, 1)


@query(f"WITH {sql.sketch(GAPPED, gaps=True)} SELECT * FROM sk")
def sketch_split_on_gaps(spark, sf_dir):
    """Sketches whose k-mers don't span letters other than ACGT."""
    return sketch.build(records_of(documents(spark, sf_dir), gaps=True), GAPPED)


@query(f"WITH {sql.minimizers(GAPPED, gaps=True)} SELECT sketch_id, CAST(pos AS BIGINT) AS pos, CAST(mpos AS BIGINT) AS mpos, minimizer FROM mins")
def minimizers_split_on_gaps(spark, sf_dir):
    """Their offsets are those of the texts."""
    return minimizers.minimizers(records_of(documents(spark, sf_dir), gaps=True), GAPPED).select("sketch_id", "pos", "mpos", "minimizer")


def sequences_in_sql(sf_dir: str) -> str:
    return f"TABLE(SELECT doc_id AS sketch_id, doc_id AS rec_id, text AS seq FROM parquet.`{sf_dir}/documents.parquet`)"


@query(f"WITH {sql.sketch(MAIN)} SELECT * FROM sk")
def sketch_in_sql(spark, sf_dir):
    """Sketches of a table, from one SQL text."""
    tables.register(spark)
    return spark.sql(
        f"""SELECT sketch_id, minimizer, kmer, count(*) AS cnt, min(pos_min) AS pos_min
        FROM selected_kmers({sequences_in_sql(sf_dir)} PARTITION BY (rec_id), {MAIN.k}, {MAIN.m}, {float(MAIN.s)}D) GROUP BY sketch_id, minimizer, kmer"""
    )


@query(SPECTRUM)
def spectrum_in_sql(spark, sf_dir):
    """All k-mers of a table with their counts, from one SQL text."""
    tables.register(spark)
    return spark.sql(f"SELECT sketch_id, kmer, count(*) AS cnt FROM sequence_kmers({sequences_in_sql(sf_dir)}, {MAIN.k}) GROUP BY sketch_id, kmer")


# Comparison.


@query(f"WITH {sql.sketch(MAIN)} SELECT * FROM sizes")
def cardinality(spark, sf_dir):
    return compare.cardinality(main_sketch(spark, sf_dir))


@query(f"WITH {sql.sketch(MAIN)} SELECT minimizer, kmer, sketch_id, n_sketches FROM (SELECT *, CAST(count(*) OVER (PARTITION BY minimizer, kmer) AS BIGINT) AS n_sketches FROM sk) WHERE n_sketches > 1")
def color_map(spark, sf_dir):
    return compare.color_map(main_sketch(spark, sf_dir))


@query(pairs_sql(MAIN, "i, j, n_shared"))
def pair_intersection(spark, sf_dir):
    return compare.shared(paired(spark, sf_dir))


@query(pairs_sql(MAIN, "i, j, n_shared, n_i, n_j, containment_ij, containment_ji"))
def containment_pairs(spark, sf_dir):
    return all_pairs(spark, sf_dir).drop("jaccard")


@query(pairs_sql(MAIN, "i, j, n_shared, n_i, n_j, jaccard"))
def jaccard_pairs(spark, sf_dir):
    return all_pairs(spark, sf_dir).drop("containment_ij", "containment_ji")


NEAREST = "sides AS (SELECT i, j, jaccard FROM scores UNION ALL SELECT j, i, jaccard FROM scores), ranked AS (SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY jaccard DESC, j) AS INTEGER) AS rank, j, jaccard FROM sides)"


@query(f"WITH {sql.sketch(MAIN)},{sql.PAIRS},{NEAREST} SELECT i, rank, j, jaccard FROM ranked WHERE rank <= 3")
def nearest_sketches(spark, sf_dir):
    """The three most similar documents of each."""
    return compare.nearest(all_pairs(spark, sf_dir), "jaccard", 3)


@query(pairs_sql(MAIN, "i, j, n_shared, n_i, n_j, jaccard"))
def stream_jaccard(spark, sf_dir):
    """Similarities of all documents, kept up by a stream."""
    table = documents(spark, sf_dir)
    arriving = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parque[t]")
    return compare_once(records_of(arriving), MAIN).drop("containment_ij", "containment_ji")


@query(pairs_sql(WIDE, "i, j, n_shared, n_i, n_j, jaccard"))
def jaccard_pairs_k31(spark, sf_dir):
    return all_pairs(spark, sf_dir, WIDE).drop("containment_ij", "containment_ji")


@query(pairs_sql(MAIN, "i, j, jaccard", "WHERE jaccard >= 0.5"))
def jaccard_min_threshold(spark, sf_dir):
    return compare.at_least(all_pairs(spark, sf_dir), "jaccard", 0.5).select("i", "j", "jaccard")


def _bank_sql(p: SketchParams) -> str:
    bank = sql.sketch(p, f"unnest([{LANGUAGE}, {sql.SOURCE}])")
    return f"""WITH {bank},
p AS (SELECT a.sketch_id AS i, b.sketch_id AS j, CAST(count(*) AS BIGINT) AS n_shared FROM sk a JOIN sk b ON a.minimizer = b.minimizer AND a.kmer = b.kmer AND a.sketch_id <> b.sketch_id WHERE a.sketch_id < 0 GROUP BY ALL)
SELECT i, j, n_shared, n_shared::DOUBLE / x.n AS containment, n_shared::DOUBLE / (x.n + y.n - n_shared) AS jaccard FROM p JOIN sizes x ON i = x.sketch_id JOIN sizes y ON j = y.sketch_id"""


@query(_bank_sql(MAIN))
def query_vs_bank(spark, sf_dir):
    """The languages' sketches against those of all sources and of each other."""
    return compare.against_bank(sketch.build(by_language(spark, sf_dir), MAIN), sketch.build(by_source(spark, sf_dir), MAIN))


def jaccard_cells(held: DataFrame) -> DataFrame:
    sizes = compare.cardinality(held)
    return matrix.dense(compare.scored(compare.shared(held), sizes), sizes, "jaccard")


def source_sketch(spark, sf_dir) -> DataFrame:
    return written(sketch.build(by_source(spark, sf_dir), MAIN))


def source_cells(spark, sf_dir, column: str = "jaccard") -> DataFrame:
    held = source_sketch(spark, sf_dir)
    if column == "jaccard":
        return jaccard_cells(held)
    sizes = compare.cardinality(held)
    pairs = compare.scored(compare.shared(held), sizes)
    back = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("containment_ji").alias("containment"))
    return matrix.dense(pairs.select("i", "j", F.col("containment_ij").alias("containment")).unionByName(back), sizes, "containment", symmetric=False)


def cells_at(records: DataFrame, rates: dict[str, SketchParams]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The matrices of sketches of several rates, all from one pass over the sequences, and the sizes of the sketches (a column each)."""
    pairs, sizes = sketch.shared_at(records, rates)
    cells = {}
    for name in rates:
        n = sizes.select("sketch_id", F.col(name).alias("n")).where("n > 0")
        cells[name] = matrix.dense(compare.scored(pairs.select("i", "j", F.col(name).alias("n_shared")).where("n_shared > 0"), n), n, "jaccard")
    return cells, sizes


EXACTLY = SketchParams(MAIN.k, MAIN.m, 1)


def exact_and_estimate(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cells, _ = cells_at(by_source(spark, sf_dir), {"exact": EXACTLY, "estimate": MAIN})
    return cells["exact"], cells["estimate"]


@query(f"WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS},{sql.dense('jaccard')} SELECT * FROM cells")
def jaccard_dense_matrix(spark, sf_dir):
    return source_cells(spark, sf_dir)


@query(f"""WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS},
dir AS (SELECT i, j, containment_ij AS c FROM scores UNION ALL SELECT j, i, containment_ji FROM scores)
SELECT a.sketch_id AS i, b.sketch_id AS j, CASE WHEN a.sketch_id = b.sketch_id THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS value
FROM sizes a CROSS JOIN sizes b LEFT JOIN dir ON dir.i = a.sketch_id AND dir.j = b.sketch_id""")
def containment_dense_matrix(spark, sf_dir):
    return source_cells(spark, sf_dir, "containment")


@query(f"""WITH {sql.sketch(MAIN, sql.SOURCE)},{sql.PAIRS},{sql.dense('jaccard')},
o AS (SELECT sketch_id, CAST(row_number() OVER (ORDER BY n DESC, sketch_id) - 1 AS BIGINT) AS place FROM sizes)
SELECT r.place AS "row", c.place AS "column", value FROM cells JOIN o r ON i = r.sketch_id JOIN o c ON j = c.sketch_id""")
def matrix_reorder(spark, sf_dir):
    """The matrix with its axes in order of falling sketch size."""
    from pyspark.sql import Window

    held = source_sketch(spark, sf_dir)
    # One row a sketch of a dense matrix: few by nature.
    place = F.row_number().over(Window.orderBy(F.desc("n"), "sketch_id")).cast("bigint") - 1
    return matrix.reorder(jaccard_cells(held), compare.cardinality(held).select("sketch_id", place.alias("place")))


# Evaluation.


@query(f"WITH {sql.both(MAIN, sql.SOURCE)} SELECT * FROM exact")
def exact_jaccard(spark, sf_dir):
    return cells_at(by_source(spark, sf_dir), {"exact": EXACTLY})[0]["exact"]


@query(f"WITH {sql.both(MAIN, sql.SOURCE)} SELECT round(t, 9) AS mean_truth, round(e, 9) AS mean_estimate, round(abs(t - e), 9) AS diff FROM (SELECT avg(value) AS t FROM exact), (SELECT avg(value) AS e FROM cells)")
def error_mean_abs(spark, sf_dir):
    found = evaluate.mean_error(*exact_and_estimate(spark, sf_dir))
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


def source_triangle(spark, sf_dir) -> DataFrame:
    return evaluate.triangle(*exact_and_estimate(spark, sf_dir))


@query(f"WITH {sql.both(MAIN, sql.SOURCE)} SELECT round(avg(estimate), 9) AS mean, round(stddev_pop(estimate), 9) AS std, round(median(estimate), 9) AS median, round(max(estimate), 9) AS max, round(min(estimate), 9) AS min FROM tri")
def triangle_stats(spark, sf_dir):
    found = evaluate.summary(source_triangle(spark, sf_dir), "estimate")
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query(f"WITH {sql.both(MAIN, sql.SOURCE)} SELECT round(sum(abs(d)), 9) AS l1, round(sqrt(sum(d * d)), 9) AS l2 FROM tri")
def norms_l1_l2(spark, sf_dir):
    return evaluate.norms(source_triangle(spark, sf_dir)).select(F.round("l1", 9).alias("l1"), F.round("l2", 9).alias("l2"))


@query(f"WITH {sql.both(MAIN, sql.SOURCE)} SELECT CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(pow(abs(d), -2.0)) / 2, 15) AS as_written, round(pow(count(*) / sum(pow(abs(d), -2.0)), 0.5), 9) AS intended FROM tri WHERE d <> 0")
def harmonic_mean(spark, sf_dir):
    found = evaluate.harmonic(source_triangle(spark, sf_dir), 2)
    return found.select("n", F.round("as_written", 15).alias("as_written"), F.round("intended", 9).alias("intended"))


@query(f"WITH {sql.both(MAIN, sql.SOURCE)}, z AS (SELECT CAST(sum(n) AS DOUBLE) AS size FROM sizes), d AS (SELECT abs((SELECT avg(value) FROM exact) - (SELECT avg(value) FROM cells)) AS diff) SELECT round(diff, 9) AS value, 'error' AS type, CAST({MAIN.s} AS BIGINT) AS threshold, size, 'sketch' AS tool FROM d, z")
def benchmark_table(spark, sf_dir):
    """Error of the sketch's rate beside its size in k-mers."""
    cells, sizes = cells_at(by_source(spark, sf_dir), {"exact": EXACTLY, "estimate": MAIN})
    size = sizes.agg(F.sum("estimate").alias("size"))
    error = evaluate.mean_error(cells["exact"], cells["estimate"]).select(F.round("diff", 9).alias("diff"))
    diffs = error.join(size, F.lit(True)).select("diff", "size", F.lit(MAIN.s).cast("bigint").alias("threshold"))
    return evaluate.benchmark_rows(diffs, "size", "sketch")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(spark, sf_dir, SMALL)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
