"""Approximate nearest neighbours by cosine: a layered graph for each shard, shard results merged.

Rows are dealt to shards of bounded size by a hash of their ids.  A shard's
distinct vectors become a hierarchical navigable small-world graph: each layer
holds a leading part of the vectors in a shuffled order, the lowest all of them,
and a vector's links are the rows of one flat array of places a layer.  Vectors
are added in batches: a batch is searched for in the graph so far, all its
vectors in step, together with each other; links go to near vectors that aren't
nearer to one another (then to the nearest left), and back, pruned by the same
rule.  A search goes down the layers greedily and keeps a beam in the lowest.

The beam's vectors are scored anew in double precision from the original
vectors, so a returned score is exactly the cosine; merging shards takes the best
scores.  Shuffling depends on nothing but the shard's size, so a task that runs
again builds the same graph.

Copies of a vector are one vertex that knows its least ids, so ties go to
smaller ids and copies can't crowd a beam.  Vectors that are null, zero or hold a
null or non-finite component take no part, nor do null ids.  Shorter vectors
count as padded with zeros.  An id given several times is as many candidates and
one query (its least vector), to which none of them is a candidate.  An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, stash


@dataclass(frozen=True)
class GraphParams:
    k: int = 5
    every: int = 50
    #: Links of a vector above the lowest layer; there it has twice as many.
    links: int = 16
    #: Beam widths while building and while searching.
    build_beam: int = 64
    beam: int = 96
    #: Vectors that are added, or searched for, in step, and components that they have together at most.
    step: int = 256
    components: int = 1 << 15
    #: Beam members whose links are followed at once.
    expand: int = 4
    shard: int = 4096

    def in_step(self, width: int) -> int:
        """Vectors of some width that are worked on in step, so that memory doesn't grow with it."""
        return max(8, min(self.step, self.components // max(width, 1)))


class Graph:
    """Links of unit vectors, one flat array of places for each layer (-1: none)."""

    def __init__(self, x: np.ndarray, params: GraphParams):
        self.x, self.params, self.step = x, params, params.in_step(x.shape[1])
        sizes = [len(x)]
        while sizes[-1] > 4 * params.links:
            sizes.append(ceil(sizes[-1] / params.links))
        self.layers = [np.full((n, params.links * (2 if level == 0 else 1)), -1, np.int32) for level, n in enumerate(sizes)]
        for level in range(len(sizes) - 1, -1, -1):
            self._fill(level)

    def _fill(self, level: int) -> None:
        x, links = self.x, self.layers[level]
        done, n = 0, len(links)
        while done < n:
            # Early batches are small, so that later ones find a graph worth searching.
            end = min(n, done + max(min(4 * self.params.links, self.step), min(self.step, done)))
            new = np.arange(done, end)
            among = x[done:end] @ x[done:end].T
            np.fill_diagonal(among, -np.inf)
            m = min(len(new) - 1, self.params.build_beam) if len(new) > 1 else 0
            near = np.argsort(-among, axis=1, kind="stable")[:, :m]
            places, sims = new[near], np.take_along_axis(among, near, 1)
            if done:
                ids, found = self._beam(x[done:end], self._entries(x[done:end], level, done), level, self.params.build_beam, done)
                places, sims = np.concatenate((places, ids), 1), np.concatenate((sims, found), 1)
            width = self.params.links
            chosen = self._diverse(places, sims, width)
            links[done:end, :width] = chosen
            self._link_back(links, np.repeat(new, width), chosen.ravel())
            done = end

    def _link_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Give targets a link to their sources; what is too much is pruned."""
        x, width = self.x, links.shape[1]
        kept = target >= 0
        source, target = source[kept], target[kept]
        # A link that is there already isn't added again.
        fresh = ~(links[target] == source[:, None]).any(axis=1)
        source, target = source[fresh], target[fresh]
        if not len(target):
            return
        sims = np.einsum("ij,ij->i", x[source], x[target])
        order = np.lexsort((-sims, target))
        source, target, sims = source[order], target[order], sims[order]
        heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        rank = np.arange(len(target)) - np.repeat(heads, np.diff(np.append(heads, len(target))))
        near = rank < width  # of many new ones, the nearest
        owners = target[heads]
        row = (np.cumsum(np.concatenate(([True], target[1:] != target[:-1]))) - 1)[near]
        added = np.full((len(owners), width), -1, np.int64)
        added[row, rank[near]] = source[near]
        added = added[:, : rank[near].max() + 1]
        both = np.concatenate((links[owners], added), axis=1)
        full = (both >= 0).sum(axis=1) > width
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :width]
        for part in np.array_split(np.flatnonzero(full), ceil(full.sum() / self.step) or 1):
            if len(part):
                members = both[part]
                near_by = np.einsum("ijk,ik->ij", x[np.maximum(members, 0)], x[owners[part]])
                packed[part] = self._diverse(members, np.where(members >= 0, near_by, -np.inf), width)
        links[owners] = packed

    def _diverse(self, places: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """For each row, so many places: near ones that are nearer to the row's vector than to any chosen before, then the nearest left."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * width]
        places, sims = np.take_along_axis(places, order, 1), np.take_along_axis(sims, order, 1)
        rows, count = places.shape
        near = self.x[np.maximum(places, 0)]
        between = near @ near.transpose(0, 2, 1)
        picked, closest = np.zeros((rows, count), bool), np.full((rows, count), -np.inf, self.x.dtype)
        valid, left = sims > -np.inf, np.full(rows, width)
        for c in range(count):
            take = valid[:, c] & (left > 0) & (sims[:, c] > closest[:, c])
            picked[:, c], left = take, left - take
            np.maximum(closest, between[:, c], out=closest, where=take[:, None])
        rest = np.argsort(np.where(picked, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :width]
        out = np.full((rows, width), -1, np.int64)
        found = np.where(np.take_along_axis(valid, rest, 1), np.take_along_axis(places, rest, 1), -1)
        out[:, : found.shape[1]] = found
        return out

    def _entries(self, q: np.ndarray, level: int, limit: int) -> np.ndarray:
        """Where to enter a layer whose first vectors are linked: the nearest of those that the layers above lead to."""
        at = np.zeros(len(q), np.int64)
        for above in range(len(self.layers) - 1, level, -1):
            at = self._beam(q, at, above, 1, min(limit, len(self.layers[above])))[0][:, 0]
        return at

    def _beam(self, q: np.ndarray, entries: np.ndarray, level: int, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of a layer's first vectors to each query, as far as following links finds them: places (-1: none) and likeness."""
        x, links, expand = self.x, self.layers[level], min(self.params.expand, width)
        n = len(q)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, x.dtype)
        done = np.ones((n, width), bool)
        seen = np.zeros((n, limit), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = entries, np.einsum("ij,ij->i", x[entries], q), False
        seen[np.arange(n), entries] = True
        active = np.arange(n)
        while True:
            waiting = np.where(done[active], -np.inf, sims[active])
            next_up = np.argpartition(-waiting, expand - 1, axis=1)[:, :expand] if expand < width else np.arange(width)[None, :].repeat(len(active), 0)
            usable = np.take_along_axis(waiting, next_up, 1) > -np.inf
            some = usable.any(axis=1)
            active, next_up, usable = active[some], next_up[some], usable[some]
            if not len(active):
                return ids, sims
            done[active[:, None], next_up] = True
            met = links[np.take_along_axis(ids[active], next_up, 1)]
            met[~usable] = -1
            met = met.reshape(len(active), -1)
            row, column = np.nonzero((met >= 0) & (met < limit))
            place = met[row, column]
            new = ~seen[active[row], place]
            row, column, place = row[new], column[new], place[new]
            # Two members may link to one vector.
            _, once = np.unique(row * limit + place, return_index=True)
            row, column, place = row[once], column[once], place[once]
            seen[active[row], place] = True
            scores = np.full(met.shape, -np.inf, x.dtype)
            scores[row, column] = np.einsum("ij,ij->i", x[place], q[active[row]])
            all_sims = np.concatenate((sims[active], scores), axis=1)
            all_ids = np.concatenate((ids[active], met), axis=1)
            all_done = np.concatenate((done[active], np.zeros(met.shape, bool)), axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[active] = np.take_along_axis(all_sims, best, 1)
            ids[active] = np.where(sims[active] > -np.inf, np.take_along_axis(all_ids, best, 1), -1)
            done[active] = np.take_along_axis(all_done, best, 1) | (ids[active] < 0)

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Places of the vectors that a beam of some width finds for each query (-1: none)."""
        return self._beam(q, self._entries(q, 0, len(self.x)), 0, width, len(self.x))[0]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; vectors whose squares leave its range are scaled first."""
    with np.errstate(all="ignore"):
        found = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    norms = np.concatenate((np.abs(a).max(axis=1), np.abs(b).max(axis=1))) if len(a) else np.ones(1)
    if norms.max() > 1e150 or norms.min() < 1e-150:
        found = np.einsum("ij,ij->i", _unit(a), _unit(b))
    return np.clip(found, -1, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _dense(rows: pd.Series, width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        x[i, : len(row)] = row
    return x


def _parts(n: int, size: int) -> Iterator[np.ndarray]:
    for start in range(0, n, size):
        yield np.arange(start, min(n, start + size))


def search_shard(cell: pd.DataFrame, params: GraphParams) -> list[tuple[int, int, float]]:
    """The best that a shard (vec_id, x, asks) has for each query: query_id, vec_id and score."""
    width = max(map(len, cell["x"]))
    x, asks, ids = _dense(cell["x"], width), cell["asks"].to_numpy(bool), cell["vec_id"].to_numpy(np.int64)
    asking, members = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(asking) or not len(members):
        return []
    vectors, which = np.unique(x[members] + 0.0, axis=0, return_inverse=True)
    by_vertex = np.lexsort((ids[members], which))
    heads = np.searchsorted(which[by_vertex], np.arange(len(vectors) + 1))
    owned = ids[members][by_vertex]
    order = np.random.default_rng(len(vectors)).permutation(len(vectors))
    graph = Graph(_unit(vectors[order]).astype(np.float32), params)
    out, queries = [], _unit(x[asking]).astype(np.float32)
    for part in _parts(len(asking), graph.step):
        found = graph.search(queries[part], max(params.beam, params.k + 1))
        row, column = np.nonzero(found >= 0)
        vertex = order[found[row, column]]
        score = cosines(x[asking[part[row]]], vectors[vertex])
        sort = np.lexsort((-score, row))
        row, vertex, score = row[sort], vertex[sort], score[sort]
        starts = np.searchsorted(row, np.arange(len(part) + 1))
        for i, p in enumerate(part):
            query_id, best = int(ids[asking[p]]), []
            for v, s in zip(vertex[starts[i] : starts[i + 1]], score[starts[i] : starts[i + 1]]):
                if len(best) >= params.k and s < best[params.k - 1][0]:
                    break
                # No more than k of a vertex's copies can count, and those of the query's id don't.
                copies = owned[heads[v] : heads[v + 1]]
                best += [(s, int(c)) for c in copies[copies != query_id][: params.k]]
                best.sort(key=lambda b: (-b[0], b[1]))
            out += [(query_id, c, float(s)) for s, c in best[: params.k]]
    return out


FOUND = "query_id bigint, vec_id bigint, score double"


def nearest(vectors: DataFrame, params: GraphParams = GraphParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest found of every query (id divisible by ``every``) among all other vectors: query_id, rank, vec_id and score (cosine)."""
    v = (
        vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
        .where("vec_id is not null and x is not null")
        .where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("x", lambda e: e != 0))
    )
    shards = max(1, ceil(v.count() / params.shard))
    held = stash(v.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")))
    queries = held.where(F.pmod("vec_id", F.lit(params.every)) == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    # The stated query set goes to every shard.
    asked = queries.select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"))
    cells = held.withColumn("asks", F.lit(False)).unionByName(asked)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(search_shard(cell, params), columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = cells.repartition(max(parallelism(vectors), 1), "shard").groupBy("shard").applyInPandas(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= params.k)
