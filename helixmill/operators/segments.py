"""Super-k-mers cut as a sequential scan cuts them that tracks one position.

The scan remembers where it found its minimizer.  A smaller m-mer that comes in
takes over; when the remembered place is left behind, the k-mer is searched anew
and a new super-k-mer begins, whatever is found.  A search goes from right to
left, and remembers a place that can lie before the minimizer: 0 if the last
m-mer is the minimizer and reversed, and the distance from the right for an
earlier reversed occurrence.  So super-k-mers are cut earlier than where the
leftmost occurrence changes; the k-mers that are selected are the same.

Where a super-k-mer ends follows from where it starts, so a chunk of a record
needs one thing from what is before it: how far the super-k-mer that reaches into
it may go.  A task works out all the answers (as many as a window has places),
which mostly meet at the next smaller m-mer.  A fold over a record's chunks in
their order picks the answer that holds, and only pieces that depend on it
wait for that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.params import SketchParams
from ..sources.shared import written
from . import minimizers
from .minimizers import KEY, is_selected

PIECES = "sketch_id bigint, rec_id bigint, base bigint, entry int, start bigint, first bigint, stop bigint, minimizer bigint, ho bigint, is_rev boolean, reach int"
TAKEN = "sketch_id bigint, rec_id bigint, base bigint, entry int, came bigint"


def searched(ho: np.ndarray, turned: np.ndarray, least: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a search of the k-mers at some places remembers their minimizer (from the k-mer's start), and whether it is reversed."""
    none = np.int64(window)
    right = np.full(len(at), none)
    rev = np.zeros(len(at), bool)
    after, last = np.full(len(at), none), np.zeros(len(at), np.int64)
    for i in range(window):
        here = at + (window - 1 - i)
        met = ho[here] == least
        first = met & (right == none)
        alike = met & ~first & (turned[here] == rev)
        right[first], rev[first], last[first] = i, turned[here[first]], i
        after[alike & (after == none)] = i
        last[alike] = i
    place = np.where(rev & (right == 0), 0, window - 1 - right)
    return np.where(rev, np.minimum(place, after), window - 1 - last), rev


def _chunk_pieces(follow: list[int], ends: list[int], nearest: int, own: int, more: bool, window: int, is_first: bool) -> list[tuple]:
    """Pieces of super-k-mers in a chunk of ``own`` k-mers: entry, start (None: before the chunk), first, stop, the k-mer that tells the rest, and how far past the chunk the last may go.

    ``follow`` says where the super-k-mer after each start begins, ``ends`` where
    it has to, if nothing smaller comes in before.  Entry 0 holds whatever was before,
    entry e if the super-k-mer at hand ends after e k-mers at most.  A
    super-k-mer that begins right behind the chunk is decided here, as an empty piece.
    """
    rows = []

    def path(s: int) -> list[int]:
        found = []
        while s < own or more and s == own:
            found.append(s)
            if s == own:
                break
            s = follow[s]
        return found

    def add(starts: list[int], entry: int) -> None:
        for s in starts:
            reach = ends[s] - own if more and (s == own or follow[s] > own) else None
            rows.append((entry, s, s, min(own, follow[s]) if s < own else own, s, reach))

    if is_first:
        add(path(0), 0)
        return rows
    heads = [min(nearest, entry) for entry in range(1, window + 1)]
    paths = {head: path(head) for head in set(heads)}
    common = set.intersection(*map(set, paths.values()))
    for entry, head in enumerate(heads, 1):
        rows.append((entry, None, 0, min(head, own), 0, entry - own if more and head > own else None))
        add([s for s in paths[head] if s not in common], entry)
    add(sorted(common), 0)
    return rows


def _pieces(x: minimizers.Block, p: SketchParams, chunk: int) -> list:
    canonical, turned, ho, mins = minimizers._minima(x, p)
    least, w = ho[mins], p.window
    remembered, rev = searched(ho, turned, least, x.at, w)
    # A k-mer with a smaller minimizer than the one before it has that at its end.
    smaller = np.concatenate(([False], (least[1:] < least[:-1]) & (x.row[1:] == x.row[:-1]))) if len(least) else np.empty(0, bool)
    limit = np.where(smaller, w, remembered + 1)
    rev = np.where(smaller, turned[np.minimum(x.at + w - 1, len(turned) - 1)], rev) if len(least) else rev
    bases = x.rows.column("base").to_numpy()
    edges = np.searchsorted(x.row, np.arange(x.rows.num_rows + 1))
    rows: list[tuple] = []  # chunk, entry, start (None: before the chunk), first, stop, place of the k-mer that tells the rest, reach
    for c in range(x.rows.num_rows):
        low, n = int(edges[c]), int(edges[c + 1] - edges[c])
        if n:
            own = min(n, chunk)
            at = np.arange(n)
            # The next place with a smaller minimizer, after each place.
            smaller_at = np.where(smaller[low : low + n], at, n + w)
            nearest = np.append(np.minimum.accumulate(smaller_at[::-1])[::-1][1:], n + w)
            ends = at + limit[low : low + n]
            rows += [(c, *r[:4], low + r[4], r[5]) for r in _chunk_pieces(np.minimum(nearest, ends).tolist(), ends.tolist(), int(nearest[0]), own, n > own, w, bases[c] == 0)]
    if not rows:
        chunk_of, entry, start, first, stop, place, reach = ([] for _ in range(7))
    else:
        chunk_of, entry, start, first, stop, place, reach = zip(*rows)
    chunk_of, place = np.array(chunk_of, np.int64), np.array(place, np.int64)
    moved = bases[chunk_of] if len(chunk_of) else np.empty(0, np.int64)
    known = np.array([s is not None for s in start], bool)
    begin = pa.array(moved + np.array([s or 0 for s in start], np.int64), mask=~known)
    ids = [x.rows.column(k).take(pa.array(chunk_of)) for k in KEY]
    return [
        *ids, moved, pa.array(entry, pa.int32()), begin, moved + np.array(first, np.int64), moved + np.array(stop, np.int64),
        canonical[mins[place]], least[place], pa.array(rev[place], mask=~known), pa.array(reach, pa.int32()),
    ]


def _fold(rows: pd.DataFrame, chunk: int) -> pd.DataFrame:
    """For each chunk of a record but the first: the entry that holds, and where the super-k-mer that reaches into it starts."""
    out, entry, came = [], 0, 0
    for base, told in rows.sort_values("base", kind="stable").groupby("base", sort=True):
        one = told[told["entry"].isin((0, entry))].iloc[0]
        came = came if pd.isna(one["start"]) else int(one["start"])
        entry = int(one["reach"])
        out.append((base + chunk, entry, came))
    found = pd.DataFrame(out, columns=["base", "entry", "came"])
    return found.assign(sketch_id=rows["sketch_id"].iloc[0], rec_id=rows["rec_id"].iloc[0])[["sketch_id", "rec_id", "base", "entry", "came"]]


def tracked_super_kmers(records: DataFrame, p: SketchParams, chunk: int = minimizers.CHUNK) -> DataFrame:
    """sketch_id, rec_id, start, len, n_kmers, minimizer, ho, is_rev, is_maximal and selected of super-k-mers as the scan cuts them.

    A record's chunks meet in the fold as one row each, mostly, without their
    bases.  Records must be whole and without gaps.
    """
    if "base" in records.columns:
        raise ValueError("records must be whole")
    cut = minimizers.chunks(records, p.k, chunk, 1).repartition(*KEY, "base")
    pieces = written(minimizers.on_blocks(cut, p.k, lambda x: _pieces(x, p, chunk), PIECES))
    # Only records of several chunks have anything to tell from one to the next.
    told = pieces.where("reach is not null").select(*KEY, "base", "entry", "start", "reach")
    taken = told.groupBy(*KEY).applyInPandas(lambda rows: _fold(rows, chunk), TAKEN)
    sure = pieces.where("entry = 0").drop("entry", "reach", "base")
    held = pieces.where("entry <> 0").join(taken, [*KEY, "base", "entry"]).withColumn("start", F.coalesce("start", "came"))
    whole = sure.unionByName(held.select(sure.columns))
    joined = whole.groupBy(*KEY, "start").agg(F.sum(F.col("stop") - F.col("first")).alias("n_kmers"), F.first("minimizer").alias("minimizer"), F.first("ho").alias("ho"), F.first("is_rev", ignorenulls=True).alias("is_rev"))
    return joined.select(*KEY, "start", (F.col("n_kmers") + p.k - 1).alias("len"), "n_kmers", "minimizer", "ho", "is_rev", (F.col("n_kmers") == p.window).alias("is_maximal"), is_selected(p).alias("selected"))
