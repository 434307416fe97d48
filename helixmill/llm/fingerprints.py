"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash among its inner
s-mers is that of its first or last one.  The choice depends on the k-mer alone,
so equal passages give equal anchors wherever they stand.  ``anchors`` returns
position and hash of every chosen k-mer.  A fingerprint keeps the ``size``
smallest distinct anchor hashes (32 bits each, in hex), and two fingerprints'
likeness estimates the Jaccard similarity of their anchor sets, whatever the
order of passages.  Its length is fixed; all of a text counts, at any length.
Where both texts are at hand, ``aligned`` matches anchors by position as well:
the largest share of a text's anchors that recur in the other at one offset.

Null and empty texts have the empty fingerprint; a text without an anchor
(shorter than k code points) is fingerprinted by its whole content.  Two empty
fingerprints are alike (1.0), an empty one and another are not (0.0).  Equal
texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, parallelism, stash, texts
from .ranges import draw, quantiles, range_of
from .words import U64, mix

BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class SyncmerParams:
    k: int = 16
    s: int = 5
    size: int = 64


def _powers(n: int) -> list[np.uint64]:
    return [U64(pow(BASE, i, 1 << 64)) for i in range(n)]


def _polynomial(x: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` values, by doubling."""
    powers, n = _powers(width + 1), len(x)
    out, done, part, size, at = None, 0, x, 1, width
    while at:
        if at & 1:
            out = part.copy() if out is None else out[: n - done - size + 1] * powers[size] + part[done : n - size + 1]
            done += size
        at >>= 1
        if at:
            part = part[: len(part) - size] * powers[size] + part[size:]
            size *= 2
    return out[: n - width + 1]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every run of ``width`` values, by doubling."""
    size, part = 1, x
    while 2 * size <= width:
        part = np.minimum(part[: len(part) - size], part[size:])
        size *= 2
    if size < width:
        rest = width - size
        part = np.minimum(part[: len(part) - rest], part[rest:])
    return part


def anchors(text: str | None, params: SyncmerParams = SyncmerParams()) -> tuple[np.ndarray, np.ndarray]:
    """Code-point positions and 64-bit hashes of a text's closed syncmers."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1)
    k, s = params.k, params.s
    if len(points) < k:
        return np.empty(0, np.int64), np.empty(0, U64)
    inner = _polynomial(points, s)
    order = mix(inner)
    least = _least(order, k - s + 1)
    n = len(points) - k + 1
    at = np.flatnonzero((order[:n] == least) | (order[k - s :] == least))
    rest, h = k, np.zeros(len(at), U64)
    while rest >= s:  # a k-mer's hash from those of its inner s-mers
        h = h * U64(pow(BASE, s, 1 << 64)) + inner[at + (k - rest)]
        rest -= s
    for j in range(k - rest, k):
        h = h * U64(BASE) + points[at + j]
    return at, mix(h)


def fingerprint(text: str | None, params: SyncmerParams = SyncmerParams(), hashes: np.ndarray | None = None) -> str:
    """The fingerprint of a text; ``hashes`` saves finding its anchors again."""
    if not text:
        return ""
    hashes = anchors(text, params)[1] if hashes is None else hashes
    if not len(hashes):
        return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).hexdigest()
    least = np.unique((hashes >> U64(32)).astype(np.uint32))[: params.size]
    return least.astype(">u4").tobytes().hex()


def aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Largest share of the first text's anchors (positions, hashes) that the second has at one offset; 0 without anchors.

    An anchor that a text repeats is matched at its first position there.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    one, at_one = np.unique(a[1], return_index=True)
    two, at_two = np.unique(b[1], return_index=True)
    _, x, y = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    if not len(x):
        return 0.0
    return float(np.unique(b[0][at_two[y]] - a[0][at_one[x]], return_counts=True)[1].max() / len(one))


def likeness(a: str, b: str, params: SyncmerParams = SyncmerParams()) -> float:
    """Estimated Jaccard similarity of two anchor sets from their smallest members."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (a, b))
    union = sorted(x | y)[: params.size]
    return sum(1 for h in union if h in x and h in y) / len(union)


FINGERPRINTS = "doc_id bigint, n_chars bigint, fingerprint string"


def fingerprint_texts(docs: DataFrame, params: SyncmerParams = SyncmerParams()) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column("text").to_pylist()
            yield batch(FINGERPRINTS, b.column("doc_id"), [len(t) for t in given], [fingerprint(t, params) for t in given])

    return texts(docs).mapInArrow(run, FINGERPRINTS)


def edited(text: str, other: str) -> str:
    """The last half of a text (rounded down) replaced by the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, aligned_edited double"


@dataclass
class _Row:
    """A text with what is known of it; ``times`` rows have it."""

    rid: int
    doc_id: int | None
    text: str
    times: int
    anchors: tuple[np.ndarray, np.ndarray]
    print: str


def _compare(row: _Row, following: _Row, params: SyncmerParams) -> tuple:
    new = edited(row.text, following.text)
    found = row.anchors if new == row.text else anchors(new, params)
    near = row.print if new == row.text else fingerprint(new, params, found[1])
    digest = sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    alike = 1.0 if new == row.text else aligned(row.anchors, found)
    return (row.doc_id, len(row.text), digest, row.print, near, likeness(row.print, near, params), likeness(row.print, following.print, params), alike)


#: Ranges of keys: at least, at most, rows aimed at for each, and sampled keys for each.
MIN_RANGES, MAX_RANGES, RANGE_ROWS, OVERSAMPLING = 1024, 65536, 50_000, 8
WALKED = "h bigint, d bigint, s bigint, rid int, guest boolean, doc_id bigint, text string, times bigint"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's rows of one id and text one, with their number."""
    for b in batches:
        first: dict[tuple, int] = {}
        times: dict[int, int] = {}
        for k, key in enumerate(zip(b.column("h").to_pylist(), b.column("d").to_pylist(), b.column("text").to_pylist())):
            at = first.setdefault(key, k)
            times[at] = times.get(at, 0) + 1
        kept = b.take(pa.array(list(times), pa.int64()))
        yield pa.RecordBatch.from_arrays([*(kept.column(f.split()[0]) for f in WALKED.split(", ")[:-1]), pa.array(list(times.values()), pa.int64())], [f.split()[0] for f in WALKED.split(", ")])


def compare_neighbours(docs: DataFrame, params: SyncmerParams = SyncmerParams()) -> DataFrame:
    """Fingerprint each text, its edit by the next document's, and compare.

    The next document is the one with the next smaller doc_id (the first comes
    after the last).  Null ids come last; equal ids are ordered by a hash of
    their texts.  Sampled splitters of (id, hash) give ranges of about equal
    bytes, however often an id occurs; each range's texts are brought together
    once, with the first text of the range after it as a guest, and walked in
    order.  The guests (one a range, a bounded number) are found by a broadcast
    of their keys.  Rows that agree in id and text are each other's neighbours,
    so a batch sends one of them with their number.
    """
    t = texts(docs).select("doc_id", "text", F.col("doc_id").isNull().cast("bigint").alias("h"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("d"), F.xxhash64("text").alias("s"))
    keys = stash(t.select("h", "d", "s", (F.octet_length("text") + 100).cast("bigint").alias("size")))
    rows, total = keys.agg(F.count("*"), F.sum("size")).first()
    if not rows:
        return t.select("doc_id").mapInArrow(lambda batches: iter(()), RESULT)
    ranges = min(MAX_RANGES, max(MIN_RANGES, rows // RANGE_ROWS))
    bounds = quantiles(draw(keys, ranges * OVERSAMPLING, F.col("size") / total, 3), ranges)
    number = range_of(bounds)
    tops = sorted((x["rid"], *x["top"]) for x in keys.groupBy(number.alias("rid")).agg(F.min(F.struct("h", "d", "s")).alias("top")).collect())
    # The text that comes after a range is the first of the next one, after the last that of the first.
    before = [(tops[k - 1][0], *top[1:]) for k, top in enumerate(tops)]
    hosts = t.sparkSession.createDataFrame(before, "host int, h bigint, d bigint, s bigint")
    guests = (
        t.join(F.broadcast(hosts), ["h", "d", "s"])
        .groupBy("host")
        .agg(F.max(F.struct("text", "doc_id", "h", "d", "s")).alias("x"))
        .select("x.h", "x.d", "x.s", F.col("host").alias("rid"), F.lit(True).alias("guest"), "x.doc_id", "x.text", F.lit(1).cast("bigint").alias("times"))
    )
    numbered = t.select("h", "d", "s", number.alias("rid"), F.lit(False).alias("guest"), "doc_id", "text", F.lit(1).cast("bigint").alias("times"))
    walked = numbered.mapInArrow(_once, WALKED).unionByName(guests).repartition(max(parallelism(docs), 1), "rid").sortWithinPartitions("rid", "guest", "h", "d", "s", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Row | None = None
        for b in batches:
            out = []
            for rid, guest, doc_id, text, times in zip(*(b.column(c).to_pylist() for c in ("rid", "guest", "doc_id", "text", "times"))):
                if last is not None and last.rid == rid and not guest and last.doc_id == doc_id and last.text == text:
                    last.times += times
                    continue
                if last is not None and last.text == text:
                    row = _Row(rid, doc_id, text, times, last.anchors, last.print)
                else:
                    found = anchors(text, params)
                    row = _Row(rid, doc_id, text, times, found, fingerprint(text, params, found[1]))
                if last is not None and last.rid == rid:
                    if last.times > 1:
                        out += [_compare(last, last, params)] * (last.times - 1)
                    out.append(_compare(last, row, params))
                last = None if guest else row
                if len(out) >= 10_000:
                    yield batch(RESULT, *zip(*out))
                    out = []
            if out:
                yield batch(RESULT, *zip(*out))

    return walked.mapInArrow(walk, RESULT)
