"""Similarity join on word shingles with Bayesian candidate pruning.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is at least the threshold.

1. Each text becomes a shingle set, its digest and a MinHash signature.  Texts
   with equal sets form one class, represented by its least doc_id; from here
   on classes are compared, so copies are never expanded.
2. Bands of the signature give candidate buckets.  In a bucket, pairs that no
   earlier band has brought together compare MinHash values step by step; a
   pair is dropped once the posterior probability that its similarity reaches
   the threshold (uniform prior) falls below the tolerance.
3. Every class belongs to a block: a slice of bounded size of the largest bucket
   that it is in.  Surviving pairs are reported as the pairs of blocks that they
   lie across, once for each class or, where many classes do, once for the
   block.  So a large group of near copies isn't listed pair by pair, and a
   chain of texts meets its neighbours only.
4. The classes of each pair of blocks meet once: pairs are pruned as before and
   the rest is verified on the exact shingle sets.  Links are counted for each
   class and passed on as a spanning forest.
5. Components of the links are the near-duplicate classes.  A class's key begins
   with its least doc_id, so the least key of a component is its name.

Buckets larger than a block are cut into a grid of block pairs too, each a
bounded unit of work; there is no cap on partners.  With 25 bands of 5
values a pair at the threshold becomes a candidate with probability 0.99995,
and a pair over it sooner still.

Texts with fewer words than a shingle are one shingle; null, empty and blank
texts have no shingles, form one class of copies and are linked to nothing.
Null ids are carried through; a class of null ids only has a null class id.
Repeated rows are copies of each other.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, groups, likely, parallelism, spread_join, stash, texts
from .components import components
from .words import U64, encode, mix, shingle_set, word_hashes

NO_ID = 2**63 - 1


@dataclass(frozen=True)
class JoinParams:
    width: int = 5
    #: The threshold as a fraction, so that verification is exact.
    top: int = 4
    bottom: int = 5
    bands: int = 25
    rows: int = 5
    #: MinHash values compared between two looks at the posterior.
    step: int = 25
    tolerance: float = 1e-6
    #: Rows of a bucket's block; rows and shingles of a block that is verified.
    bucket_block: int = 512
    verify_block: int = 512
    #: A block with more classes than this to meet another sends all of its classes.
    whole_from: int = 16
    verify_shingles: int = 1_000_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


@cache
def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """MinHash values of a set of hashes, in slices that bound memory."""
    out = np.full(n, 2**32 - 1, np.uint32)
    by = multipliers(n)[:, None]
    for k in range(0, len(shingles), 2048):
        out = np.minimum(out, ((by * shingles[None, k : k + 2048]) >> U64(32)).min(axis=1).astype(np.uint32))
    return out


@cache
def least_matches(n: int, params: JoinParams) -> int:
    """Fewest matches among n MinHash values that keep a pair in play.

    With a uniform prior, P(similarity >= t | m of n match) is the probability
    of at most m successes in n + 1 draws that succeed with probability t.
    """
    t, tail = params.top / params.bottom, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= params.tolerance:
            return m
    return n


def in_play(one: np.ndarray, others: np.ndarray, params: JoinParams) -> np.ndarray:
    """Indices of the signatures that stay possible partners of one signature."""
    at, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k in range(0, params.hashes, params.step):
        if not len(at):
            break
        matches = matches + (others[at, k : k + params.step] == one[k : k + params.step]).sum(axis=1)
        keep = matches >= least_matches(min(k + params.step, params.hashes), params)
        at, matches = at[keep], matches[keep]
    return at


class Forest:
    """Union-find over the rows of one bounded cell; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[a] = b
            self.links.append((x, y))


SIGNED = "doc_id bigint, th bigint, node binary, n_shingles int, sig binary"


def sign(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """Digest and signature of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, sigs = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(word_hashes(encode(text)), params.width)
                nodes.append(blake2b(s.tobytes(), digest_size=16).digest())
                sizes.append(len(s))
                sigs.append(signature(s, params.hashes).tobytes())
            yield batch(SIGNED, b.column("doc_id"), b.column("th"), nodes, pa.array(sizes, pa.int32()), sigs)

    return texts(docs).withColumn("th", F.xxhash64("text")).select("doc_id", "th", "text").mapInArrow(run, SIGNED)


def grid(size: Column, block: int, key: Column) -> tuple[Column, Column, Column]:
    """Blocks that a group of ``size`` rows needs, a row's own block, and the block pairs that it goes to."""
    n = F.ceil(size / block).cast("int")
    own = F.pmod(F.xxhash64(key, F.lit(7)), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    return n, own, pairs


def _partners(cell: dict, at: int) -> np.ndarray:
    """Later rows of a cell that row ``at`` is to be compared with: in a cell of two blocks, those of the other block."""
    blocks = cell["own"]
    later = np.arange(at + 1, len(blocks))
    return later if cell["i"][0] == cell["j"][0] else later[blocks[at + 1 :] != blocks[at]]


#: Keys of classes: the least doc_id in an order of bytes, then the digest of the shingles.
LOWEST = -(2**63)


def key_of(d: Column, node: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(d.bitwiseXOR(F.lit(LOWEST).cast("bigint"))), 16, "0")), node)


def id_of(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(LOWEST).cast("bigint"))


MEETING = "i bigint, j bigint, own bigint, key binary"


def _candidates(params: JoinParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, ["band", "bucket", "i", "j"]):
            n = len(cell["key"])
            if n < 2:
                continue
            sigs = np.frombuffer(b"".join(cell["sig"]), np.uint32).reshape(n, -1)
            before = int(cell["band"][0]) * params.rows
            blocks, of = np.unique(cell["block"], return_inverse=True)
            meets = np.zeros((len(blocks), n), bool)
            for at in range(n - 1):
                others = _partners(cell, at)
                if before and len(others):
                    same = (sigs[others, :before] == sigs[at, :before]).reshape(len(others), -1, params.rows)
                    others = others[~same.all(axis=2).any(axis=1)]
                others = others[in_play(sigs[at], sigs[others], params)]
                meets[of[at], others] = True
                meets[of[others], at] = True
            other, row = np.nonzero(meets)
            if len(row):
                pairs, first, pair, counts = np.unique(other * len(blocks) + of[row], return_index=True, return_inverse=True, return_counts=True)
                whole = counts > params.whole_from
                single = np.flatnonzero(~whole[pair])
                own = blocks[of[np.concatenate((row[single], row[first[whole]]))]]
                other = blocks[np.concatenate((other[single], other[first[whole]]))]
                yield batch(MEETING, np.minimum(own, other), np.maximum(own, other), own, [*(cell["key"][x] for x in row[single]), *[None] * int(whole.sum())])

    return run


def candidate_meetings(classes: DataFrame, n_classes: int, params: JoinParams = JoinParams()) -> DataFrame:
    """Which classes (key, sig, n_shingles) meet across which blocks (i, j) after pruning; ``own`` is the class's block.

    Where many classes of a block meet another block, the block is told as a
    whole and its classes follow from a join, so groups of any size are told in
    rows of blocks.
    """
    width = params.rows * 4
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(params.bands - 1)), lambda k: F.xxhash64(F.substring("sig", k * width + 1, F.lit(width))))).alias("band", "bucket")
    rows = classes.select("key", "n_shingles", bands)
    sizes = rows.groupBy("band", "bucket").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w")).where("m > 1")
    members = spread_join(rows.drop("n_shingles"), sizes, ["band", "bucket"], "m", params.bands * n_classes)
    each = members.groupBy("key").agg(F.collect_list(F.struct("band", "bucket", "m")).alias("at"), F.max(F.struct("m", "w", "band", "bucket")).alias("home"))
    slices = F.ceil(F.greatest(F.col("home.m") / params.verify_block, F.col("home.w") / params.verify_shingles)).cast("int")
    block = F.xxhash64("home.band", "home.bucket", F.pmod(F.xxhash64("key", F.lit(3)), slices))
    held = stash(each.select("key", "at", block.alias("block")))
    near = held.join(classes.select("key", "sig"), "key").select("key", "sig", "block", F.inline("at"))
    _, own, pairs = grid(F.col("m"), params.bucket_block, F.col("key"))
    cells = near.select("band", "bucket", "key", "sig", "block", own.alias("own"), F.inline(pairs))
    by = ["band", "bucket", "i", "j"]
    told = stash(cells.repartition(parallelism(classes), *by).sortWithinPartitions(*by).mapInArrow(_candidates(params), MEETING).distinct())
    whole = told.where("key is null").drop("key").join(held.select(F.col("block").alias("own"), "key"), "own")
    return told.where("key is not null").unionByName(whole).distinct()


VERIFIED = "a binary, b binary, links bigint"


def _verified(params: JoinParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, ["i", "j"]):
            keys, n = cell["key"], len(cell["key"])
            if n < 2:
                continue
            sigs = np.frombuffer(b"".join(cell["sig"]), np.uint32).reshape(n, -1)
            sets = [np.frombuffer(s, U64) for s in cell["shingles"]]
            sizes = np.array([len(s) for s in sets])
            all_codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
            starts = np.cumsum(sizes) - sizes
            mine, degree, forest = np.zeros(int(all_codes.max()) + 1, bool), np.zeros(n, np.int64), Forest(n)
            for at in range(n - 1):
                others = _partners(cell, at)
                others = others[(sizes[others] * params.bottom >= sizes[at] * params.top) & (sizes[at] * params.bottom >= sizes[others] * params.top)]
                others = others[in_play(sigs[at], sigs[others], params)]
                if not len(others):
                    continue
                own = all_codes[starts[at] : starts[at] + sizes[at]]
                mine[own] = True
                if len(others) * 4 > n:  # as good as all: one pass over the cell
                    common = np.add.reduceat(mine[all_codes], starts, dtype=np.int64)[others]
                else:
                    common = np.array([np.count_nonzero(mine[all_codes[starts[k] : starts[k] + sizes[k]]]) for k in others])
                mine[own] = False
                linked = others[params.bottom * common >= params.top * (sizes[at] + sizes[others] - common)]
                degree[at] += len(linked)
                degree[linked] += 1
                for k in linked.tolist():
                    forest.join(at, k)
            out = [(keys[x], None, int(degree[x])) for x in np.flatnonzero(degree)] + [(keys[x], keys[y], 0) for x, y in forest.links]
            if out:
                yield batch(VERIFIED, *zip(*out))

    return run


SETS = "key binary, sig binary, shingles binary"


def shingles_of(docs: DataFrame, wanted: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """Signature and sorted shingles of the wanted classes (d, th, key, node)."""
    t = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"), "text")
    rows = "d bigint, th bigint, node binary, sig binary, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, nodes, sigs, sets, seen = [], [], [], [], set()
            for k, (d, th, text) in enumerate(zip(b.column("d").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist())):
                if (d, th) not in seen:  # of repeated rows a batch sends one
                    seen.add((d, th))
                    s = shingle_set(word_hashes(encode(text)), params.width)
                    keep.append(k)
                    nodes.append(blake2b(s.tobytes(), digest_size=16).digest())
                    sigs.append(signature(s, params.hashes).tobytes())
                    sets.append(s.tobytes())
            at = pa.array(keep, pa.int64())
            yield batch(rows, b.column("d").take(at), b.column("th").take(at), nodes, sigs, sets)

    # A text's hash may be another's too, so its digest has to agree.
    found = likely(t, wanted).mapInArrow(run, rows)
    return found.join(wanted.select("d", "th", "node", "key"), ["d", "th", "node"]).select("key", "sig", "shingles").dropDuplicates(["key"])


def verified_links(docs: DataFrame, classes: DataFrame, meetings: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """Exact links of the classes that meet: forests (a, b) and each class's number of links (b null)."""
    wanted = classes.join(meetings.select("key").distinct(), "key").select("d", "th", "node", "key")
    sets = shingles_of(docs, wanted, params)
    return meetings.join(sets, "key").repartition(parallelism(docs), "i", "j").sortWithinPartitions("i", "j").mapInArrow(_verified(params), VERIFIED)


def near_duplicates(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One row for each document.

    Returns doc_id, th (hash of the text), class_id (least doc_id of the
    documents that links connect, copies included), copy_id (least doc_id with
    the same shingles), n_copies (documents with the same shingles, itself
    included), n_links (classes of other shingle sets that are linked to it) and
    class_key, which names the near-duplicate class whatever its ids are.
    """
    signed = stash(sign(docs, params))
    # Signatures follow from the shingles, so any of a class's stands for it.
    grouped = signed.groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "th")).alias("rep"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = stash(grouped.select(key_of(F.col("rep.d"), F.col("node")).alias("key"), "node", "rep.d", "rep.th", "n_copies", "sig", "n_shingles"))
    texted = classes.where("n_shingles > 0")
    n_classes, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("n_copies"), F.lit(0))).first()
    meetings = stash(candidate_meetings(texted, n_classes, params))
    found = stash(verified_links(docs, texted, meetings, params))
    degrees = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("n_links"))
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("key"), "root")
    real = lambda c: F.when(c == NO_ID, None).otherwise(c)
    told = classes.select("key", "node", "d", "n_copies").join(roots, "key", "left").join(degrees, "key", "left").select(
        "node",
        real(id_of(F.coalesce("root", "key"))).alias("class_id"),
        real(F.col("d")).alias("copy_id"),
        "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("root", "key").alias("class_key"),
    )
    return spread_join(signed.select("doc_id", "th", "node"), told, ["node"], "n_copies", n_rows).select("doc_id", "th", "class_id", "copy_id", "n_copies", "n_links", "class_key")
