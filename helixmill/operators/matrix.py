"""Matrices of scores: dense long form, reordering, transposition, text output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense(scores: DataFrame, ids: DataFrame, column: str, symmetric: bool = True) -> DataFrame:
    """All cells (i, j, value) over a set of ids: 1 on the diagonal, 0 where there is no score.

    ``scores`` has a row for each i < j (mirrored if symmetric) or for each
    i <> j.  The number of cells is the square of that of ids, as the output's
    nature is; keep large comparisons sparse.
    """
    given = scores.select("i", "j", F.col(column).alias("value"))
    if symmetric:
        given = given.unionByName(given.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    rows, columns = ids.select(F.col("sketch_id").alias("i")), ids.select(F.col("sketch_id").alias("j"))
    cells = rows.join(columns, F.lit(True))
    filled = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce("value", F.lit(0.0)))
    return cells.join(given, ["i", "j"], "left").select("i", "j", filled.alias("value"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def reorder(cells: DataFrame, order: DataFrame) -> DataFrame:
    """Cells with both axes renumbered by a table (sketch_id, place); ids that it lacks are left out."""
    row = order.select(F.col("sketch_id").alias("i"), F.col("place").alias("row"))
    column = order.select(F.col("sketch_id").alias("j"), F.col("place").alias("column"))
    return cells.join(row, "i").join(column, "j").select("row", "column", "value")


def unknown(cells: DataFrame, order: DataFrame) -> DataFrame:
    """Ids of a matrix that an order doesn't name."""
    return cells.select(F.col("i").alias("sketch_id")).distinct().join(order, "sketch_id", "left_anti")


def csv_lines(cells: DataFrame, names: DataFrame, digits: int = 6) -> DataFrame:
    """The matrix as lines of text (line, text): a header of names, then a row a line, with C's ``%g``.

    Each row is put together in a task of its own; ``names`` has sketch_id and name.
    """
    # One line of a matrix grows with the number of sketches, as the format demands.
    @F.pandas_udf("string")
    def formatted(rows: pd.Series) -> pd.Series:
        return rows.map(lambda values: ",".join(f"{v:.{digits}g}" for v in values))

    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("cells"))
    body = rows.select((F.col("i") + 1).alias("line"), formatted(F.col("cells.value")).alias("text"))
    header = names.agg(F.array_sort(F.collect_list(F.struct("sketch_id", "name"))).alias("x")).select(F.lit(0).cast("bigint").alias("line"), F.array_join("x.name", ",").alias("text"))
    return header.unionByName(body.select(F.col("line").cast("bigint").alias("line"), "text"))
