"""Connected components of a table of links, by alternating large and small stars.

Each round joins links with the least neighbour of their ends; links only move
towards smaller nodes, so the rounds needed grow with the logarithm of the
longest chain.  A node with very many links (the centre of a star) meets its
least neighbour by a broadcast of such nodes, whose number is bounded, so it
fills no single task.  Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parallelism, spread_join

#: Links for each partition of a round's intermediate results.
LINKS = 20_000


def _with_least(links: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) with the least b of their a as m."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return spread_join(links, least, ["a"], "n", rows).drop("n")


def _large(links: DataFrame, rows: int, parts: int) -> DataFrame:
    """Link each node's larger neighbours to its least neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * rows).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).coalesce(parts)


def _small(links: DataFrame, rows: int, parts: int) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them.  Here b < a."""
    moved = _with_least(links, rows).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = links.groupBy("a").agg(F.min("b").alias("b"))
    return moved.unionByName(least).coalesce(parts)


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of a table of links (a, b); root is the least node of its component.

    Self-links count as nothing; nodes without a link don't appear.  Rounds use
    no more partitions than their links need, so that a small graph doesn't
    leave many tiny shuffle files behind.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
    for _ in range(rounds):
        parts = max(1, min(parallelism(links), state[0] // LINKS))
        links = cut(_small(_large(links.coalesce(parts), state[0], parts), state[0], parts).distinct().coalesce(parts))
        seen, state = state, tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if state == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
