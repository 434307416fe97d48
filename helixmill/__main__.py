"""Command lines: ``python -m helixmill sketch|compare|sort|errors``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.params import SketchParams
from .jobs import tools
from .operators import evaluate
from .sources import fasta


def _sketch(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = [a.input] if a.input else tools.listed_paths(spark, a.list, fasta.BUILD)
    name = a.list.rsplit("/", 1)[-1] if a.list and not a.input else "sketches"
    p = SketchParams(a.kmer, a.minimizer, a.rate, a.abundance)
    for path in tools.sketch_to_files(spark, paths, p, a.output, f"{a.prefix}{name}.txt", a.prefix, hidden=a.hidden, overwrite=a.overwrite):
        print(path)


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    queries = tools.listed_paths(spark, a.queries) if a.queries else None
    scores, names = tools.compare_files(spark, tools.listed_paths(spark, a.list), queries)
    rows = names.where(F.col("sketch_id") < len(queries)) if queries else None
    for column in ("containment", "jaccard"):
        tools.write_matrix(tools.matrix_cells(scores, names, column, a.least, rows), names, f"{a.output}_{column}.csv.gz", a.digits)


def _sort(spark: SparkSession, a: argparse.Namespace) -> None:
    moved, names = tools.sort_matrix(fasta.read_matrix(spark, a.matrix), fasta.read_names(spark, a.matrix), fasta.read_paths(spark, a.list, fasta.COMPARE))
    tools.write_matrix(moved, names, a.output, a.digits)


def _errors(spark: SparkSession, a: argparse.Namespace) -> None:
    truth = fasta.read_distances(spark, a.truth)
    at = {int(rate): (path, float(value)) for rate, value, path in (x.split(":", 2) for x in a.matrices)}
    cells = {rate: fasta.read_matrix(spark, path) for rate, (path, _) in at.items()}
    tools.write_table(tools.error_table(truth, cells, a.metric, {rate: value for rate, (_, value) in at.items()}, a.tool), a.output)
    if a.triangle:
        for rate, found in cells.items():
            below = evaluate.triangle(truth, found)
            print(rate, evaluate.summary(below, "estimate").first().asDict(), evaluate.norms(below).first().asDict())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("helixmill", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("sketch", help="sketch FASTA files, each into a file")
    a.add_argument("-i", "--input", help="one FASTA file (taken before a list)")
    a.add_argument("-f", "--list", help="a file with a path a line")
    a.add_argument("-k", "--kmer", type=int, default=31)
    a.add_argument("-m", "--minimizer", type=int, default=11)
    a.add_argument("-s", "--rate", type=float, default=1000)
    a.add_argument("-a", "--abundance", type=int, default=1)
    a.add_argument("-p", "--prefix", default="subsampled_")
    a.add_argument("-o", "--output", default=".", help="folder of the sketches")
    a.add_argument("--hidden", action="store_true", help="take files for what their first bytes say")
    a.add_argument("--overwrite", action="store_true")
    a.set_defaults(run=_sketch)
    a = jobs.add_parser("compare", help="containment and Jaccard matrices of sketch files")
    a.add_argument("-f", "--list", required=True)
    a.add_argument("-q", "--queries", help="a list of sketches that alone are rows")
    a.add_argument("-p", "--digits", type=int, default=6)
    a.add_argument("-m", "--least", type=float, default=0.0)
    a.add_argument("-o", "--output", default="results")
    a.set_defaults(run=_compare)
    a = jobs.add_parser("sort", help="put a matrix into the order of a list")
    a.add_argument("matrix")
    a.add_argument("output")
    a.add_argument("list")
    a.add_argument("-p", "--digits", type=int, default=6)
    a.set_defaults(run=_sort)
    a = jobs.add_parser("errors", help="tabulate the errors of matrices against distances")
    a.add_argument("truth")
    a.add_argument("matrices", nargs="+", help="rate:value:path, the value being the metric's")
    a.add_argument("-t", "--metric", choices=("size", "ram", "time"), default="size")
    a.add_argument("--tool", default="sketch")
    a.add_argument("--triangle", action="store_true", help="print statistics of the lower triangle too")
    a.add_argument("-o", "--output", required=True)
    a.set_defaults(run=_errors)
    return top


def main(given: list[str] | None = None) -> None:
    a = parser().parse_args(given)
    if a.job == "sketch" and not (a.input or a.list):
        sys.exit("sketch needs -i or -f")
    a.run(SparkSession.builder.appName("helixmill").getOrCreate(), a)


if __name__ == "__main__":
    main()
