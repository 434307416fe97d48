"""Hard negatives: the nearest rows of other labels just below each positive's score.

Vectors become whole numbers, floor(scale * x); scores are their inner products.
An anchor's positives are its best rows of its own label.  Each positive opens a
window of scores, from a share of the positive's score up to it, and the best
rows of other labels inside a window are its negatives.

Candidates are dealt to blocks by a hash of their ids, anchors to groups; each
(block, group) cell is one bounded unit of work.  In a cell every dimension is a
list of the candidates sorted by value.  For one anchor the lists are read in
step from their good end (top for a positive component, bottom for a negative
one; a zero component's list isn't read).  Each candidate that shows up for the
first time is scored at once, by random access to its vector.  What the lists
have reached bounds the score of everything unseen: the threshold.  Reading stops
when, for every window, the threshold is strictly below its k-th best score, or
below the window itself; a tie could still go to an unseen smaller id.  Positives
are found the same way, over lists of the anchor's label, with one open window.

Windows are needed everywhere before negatives are searched, so there are two
passes, each followed by a merge of the blocks' best.  The work is that of a
stated set of anchors against all rows: each vector is sent once to each group
of anchors.  Sums are whole numbers below 2**53 in float64, so exact; cells with
a vector too wide for that compute in whole numbers of any size.  A score beyond
the range of a long shows, and counts, as its end.

Rows with a null id, label or vector, or a null or non-finite component take no
part.  Shorter vectors count as padded with zeros.  An id given several times is
as many candidates, but one anchor (its least label and vector), to which none
of them is a candidate.  A positive with a negative score has an empty window.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, stash
from .topk import LEAST, MOST, whole


@dataclass(frozen=True)
class NegativeParams:
    #: Positives of an anchor, and negatives of each positive.
    positives: int = 5
    negatives: int = 5
    scale: int = 256
    every: int = 100
    #: Ids divisible by this have the next of so many labels.
    shifted: int = 7
    labels: int = 10
    #: A negative's score in hundredths of its positive's, at least.
    least_percent: int = 80
    #: Candidates of a block, and components that they have together at most; anchors of a group.
    block: int = 8192
    components: int = 1 << 22
    group: int = 512
    #: Entries of each list that are read before the threshold is looked at, doubled each time.
    step: int = 8


def _within(scores: np.ndarray) -> np.ndarray:
    """Scores of any size held to the range of a long (others have none beyond it)."""
    return np.array([max(LEAST, min(MOST, s)) for s in scores], object) if scores.dtype == object else scores


class Lists:
    """Candidates of a cell as one sorted list for each dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable")
        #: Candidates scored, and entries read of a list, for each search.
        self.scored, self.read = [], []

    def search(self, q: np.ndarray, windows: list[tuple], k: int, step: int, allowed: np.ndarray) -> list[list[tuple[int, int]]]:
        """The k best allowed candidates (place, score) with a score in each window (low, high), by the threshold algorithm.

        More may be returned, in no order; an end that is None is open.
        """
        n, x = len(self.x), self.x
        high, low = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen, depth, scored = np.zeros(n, bool), 0, 0
        places, scores = [], []
        kept: list[list[tuple[int, int]]] = [[] for _ in windows]
        still = [w for w, (least, most) in enumerate(windows) if least is None or most is None or least <= most]
        if not len(high) and not len(low):  # all scores are 0, so nothing is read in order
            seen[:] = True
            places, scores = [np.flatnonzero(allowed)], [np.zeros(int(allowed.sum()), x.dtype)]
            depth = n
        while still:
            if depth < n:
                to = min(n, max(step, 2 * depth))
                met = np.concatenate((self.order[n - to : n - depth, high].ravel(), self.order[depth:to, low].ravel()))
                new = np.zeros(n, bool)
                new[met] = True
                fresh = np.flatnonzero(new & ~seen & allowed)
                seen |= new
                depth = to
                places.append(fresh)
                scores.append(_within(x[fresh] @ q))
                scored += len(fresh)
            at, got = np.concatenate(places), np.concatenate(scores)
            over = depth >= n or bool(seen.all())
            threshold = None if over else x[self.order[n - depth, high], high] @ q[high] + x[self.order[depth - 1, low], low] @ q[low]
            closed = []
            for w in still:
                least, most = windows[w]
                inside = np.ones(len(got), bool)
                if least is not None:
                    inside &= got >= least
                if most is not None:
                    inside &= got <= most
                own = got[inside]
                kth = np.sort(own)[-k] if len(own) >= k else None
                if over or (kth is not None and threshold < kth) or (least is not None and threshold < least):
                    keep = inside if kth is None else inside & (got >= kth)
                    kept[w] = list(zip(at[keep].tolist(), got[keep].tolist()))
                    closed.append(w)
            still = [w for w in still if w not in closed]
        self.scored.append(scored)
        self.read.append(depth)
        return kept


def vectors_of(cell: pd.DataFrame, scale: int) -> np.ndarray:
    """A cell's vectors as whole numbers: in float64 where all inner products are exact, else as Python's."""
    width = max(map(len, cell["x"]))
    x = np.zeros((len(cell), width))
    for i, row in enumerate(cell["x"]):
        x[i, : len(row)] = row
    if not width or np.abs(x).max() < np.sqrt(2.0**53 / width) / scale - 1:
        return np.floor(x * scale)
    return np.array([[whole(float(v), scale) for v in row] for row in x], object)


def _best(found: list[tuple[int, int]], ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best of (place, score) as (id, score), ties to the smaller id."""
    return sorted(((int(ids[p]), int(s)) for p, s in found), key=lambda r: (-r[1], r[0]))[:k]


def positive_cell(cell: pd.DataFrame, params: NegativeParams) -> list[tuple]:
    """The best rows of its own label for each anchor of a cell: anchor_id, vec_id, score."""
    z, asks = vectors_of(cell, params.scale), cell["asks"].to_numpy(bool)
    ids, labels = cell["vec_id"].to_numpy(np.int64), cell["label"].to_numpy(np.int64)
    out = []
    for label in np.unique(labels[asks]):
        members = np.flatnonzero(~asks & (labels == label))
        if not len(members):
            continue
        lists = Lists(z[members])
        for a in np.flatnonzero(asks & (labels == label)):
            found = lists.search(z[a], [(None, None)], params.positives, params.step, ids[members] != ids[a])[0]
            out += [(int(ids[a]), *r) for r in _best(found, ids[members], params.positives)]
    return out


def negative_cell(cell: pd.DataFrame, params: NegativeParams) -> list[tuple]:
    """The best rows of other labels in each window of each anchor of a cell: anchor_id, place (of the positive), vec_id, score."""
    z, asks = vectors_of(cell, params.scale), cell["asks"].to_numpy(bool)
    ids, labels = cell["vec_id"].to_numpy(np.int64), cell["label"].to_numpy(np.int64)
    members, out = np.flatnonzero(~asks), []
    if not len(members):
        return out
    lists = Lists(z[members])
    for a in np.flatnonzero(asks):
        # The lower bound is the least whole score whose hundredfold reaches the share.
        windows = [(-(-params.least_percent * int(s) // 100), int(s)) for s in cell["windows"].iat[a]]
        allowed = (labels[members] != labels[a]) & (ids[members] != ids[a])
        for place, found in enumerate(lists.search(z[a], windows, params.negatives, params.step, allowed)):
            out += [(int(ids[a]), place, *r) for r in _best(found, ids[members], params.negatives)]
    return out


def relabelled(label: Column, vec_id: Column, params: NegativeParams) -> Column:
    return F.when(F.pmod(vec_id, F.lit(params.shifted)) == 0, F.pmod(label + 1, F.lit(params.labels))).otherwise(label)


def hard_negatives(vectors: DataFrame, params: NegativeParams = NegativeParams(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor (id divisible by ``every``)."""
    v = (
        vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
        .where("vec_id is not null and label is not null and x is not null")
        .where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
        .withColumn("label", relabelled(F.col("label"), F.col("vec_id"), params))
    )
    is_anchor = F.pmod("vec_id", F.lit(params.every)) == 0
    n, n_anchors, width = v.agg(F.count("*"), F.countDistinct(F.when(is_anchor, F.col("vec_id"))), F.max(F.size("x"))).first()
    block = max(64, min(params.block, params.components // max(1, width or 1)))
    blocks, groups = max(1, ceil(n / min(block, params.block))), max(1, ceil(n_anchors / params.group))
    held = stash(v.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("grp")
    anchors = held.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.*", group)
    no_windows = F.lit(None).cast("array<bigint>").alias("windows")
    candidates = held.select("vec_id", "label", "x", no_windows, "block", numbers(groups).alias("grp"), F.lit(False).alias("asks"))

    def search(asked: DataFrame, work, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def run(cell: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(work(cell, params), columns=names).astype("int64")

        cells = candidates.unionByName(asked.select("vec_id", "label", "x", "windows", numbers(blocks).alias("block"), "grp", F.lit(True).alias("asks")))
        return cells.repartition(max(parallelism(vectors), 1), "block", "grp").groupBy("block", "grp").applyInPandas(run, schema)

    near = search(anchors.withColumn("windows", no_windows), positive_cell, "anchor_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")) - 1
    positives = stash(near.select("anchor_id", place.alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).where(F.col("place") < params.positives))
    # At most so many positives each.
    windows = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("windows"))
    found = search(anchors.join(windows, "vec_id"), negative_cell, "anchor_id bigint, place bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    best = found.select("anchor_id", "place", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).where(F.col("rank") <= params.negatives)
    return positives.join(best, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
