"""Accuracy of sketch scores against exact ones, and benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_error(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Absolute difference of the means of two matrices, diagonals included: one row, mean_truth, mean_estimate, diff."""
    a = truth.agg(F.avg("value").alias("mean_truth"))
    b = estimate.agg(F.avg("value").alias("mean_estimate"))
    return a.join(b, F.lit(True)).select("mean_truth", "mean_estimate", F.abs(F.col("mean_truth") - F.col("mean_estimate")).alias("diff"))


def triangle(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Cells under the diagonal (i > j) of both matrices: i, j, truth, estimate and their difference d."""
    a = truth.where("i > j").select("i", "j", F.col("value").alias("truth"))
    b = estimate.where("i > j").select("i", "j", F.col("value").alias("estimate"))
    return a.join(b, ["i", "j"]).withColumn("d", F.col("truth") - F.col("estimate"))


def summary(cells: DataFrame, column: str) -> DataFrame:
    """Mean, population standard deviation, median, maximum and minimum of a column."""
    c = F.col(column)
    return cells.agg(
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std"),
        F.percentile(c, 0.5).alias("median"),
        F.max(c).alias("max"),
        F.min(c).alias("min"),
    )


def norms(cells: DataFrame) -> DataFrame:
    """L1 and L2 norms of the differences under the diagonal."""
    return cells.agg(F.sum(F.abs("d")).alias("l1"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("l2"))


def harmonic(cells: DataFrame, exponent: int = 1) -> DataFrame:
    """Generalised harmonic means of the differences that aren't 0, with the exponent applied in two ways.

    ``as_written`` divides the ratio by the exponent; ``intended`` takes its
    root.  Both are null if the sum of inverse powers is 0 or there are none.
    """
    inverse = F.sum(F.pow(F.abs("d"), F.lit(-float(exponent)))).alias("inverse")
    found = cells.where("d <> 0").agg(F.count("*").alias("n"), inverse)
    ratio: Column = F.when(F.col("inverse") != 0, F.col("n") / F.abs("inverse"))
    return found.select("n", (ratio / exponent).alias("as_written"), F.pow(ratio, F.lit(1.0 / exponent)).alias("intended"))


def benchmark_rows(diffs: DataFrame, metric: str, tool: str) -> DataFrame:
    """Plot-ready rows from (threshold, <metric value>, diff): value, type, threshold, metric and tool."""
    return diffs.select(F.col("diff").alias("value"), F.lit("error").alias("type"), "threshold", F.col(metric).cast("double").alias(metric), F.lit(tool).alias("tool"))
