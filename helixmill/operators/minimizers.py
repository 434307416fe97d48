"""Words and minimizers of all positions of a table of sequences.

Sequences are cut into chunks of bounded length that overlap by k-1 bases and
dealt to partitions while they are still compact, so no long sequence stays in
one task.  Where the input is spread over many files, sequences of one chunk stay
in the tasks that read them and only the others are dealt.  In a task, blocks of chunks are arrays of two-bit codes: m-mers,
hashes and the sliding minimum are computed for all positions at once, and only
selected k-mers become rows.  A k-mer's minimizer depends on the k-mer alone, so
chunks don't change a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.params import MAX_INT_K, SketchParams, ordered
from ..sources.shared import tasks

CHUNK = 16_384
#: Bases that a task works on at once.
BLOCK = 1 << 19
KEY = ("sketch_id", "rec_id")


def chunks(records: DataFrame, k: int, chunk: int = CHUNK, more: int = 0, cut: bool | None = None) -> DataFrame:
    """Pieces of at most ``chunk + k - 1`` bases (and ``more`` that follow): sketch_id, rec_id, base (offset) and bases (bytes).

    ``cut`` keeps only rows that are cut into several pieces, or only the others.
    Records shorter than k are left out.  Slices of bytes cost their own length
    only, wherever they begin.  A record may come in several rows that overlap by
    k-1 bases and say their offset in ``base``.
    """
    start = F.col("base") if "base" in records.columns else F.lit(0)
    held = records.select(*KEY, start.cast("bigint").alias("row_base"), F.col("seq").cast("binary").alias("seq"))
    # A filter on the length would be pushed below the cleaning and clean each sequence again.
    wanted = F.length("seq") >= k
    if cut is not None:
        several = F.length("seq") >= chunk + k
        wanted &= several if cut else ~several
    offsets = F.when(wanted, F.sequence(F.lit(0), F.length("seq") - k, F.lit(chunk)))
    pieces = held.select(*KEY, "row_base", "seq", F.explode_outer(offsets).alias("base")).where("base is not null")
    return pieces.select(*KEY, (F.col("row_base") + F.col("base")).alias("base"), F.substring("seq", F.col("base") + 1, F.lit(chunk + k - 1 + more)).alias("bases"))


class Block:
    """Some chunks laid end to end as codes, with the positions at which a word of k bases lies inside a chunk and spans no gap (other letter)."""

    def __init__(self, rows: pa.RecordBatch, k: int):
        data = rows.column("bases")
        sizes = np.array([len(x.as_buffer()) for x in data], np.int64)
        data_bytes = b"".join(x.as_buffer() for x in data)
        self.codes = hashing.CODES[np.frombuffer(data_bytes, np.uint8)]
        starts, counts = np.cumsum(sizes) - sizes, np.maximum(sizes - k + 1, 0)
        self.row = np.repeat(np.arange(len(sizes)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = starts[self.row] + inside
        if not hashing.KNOWN[np.frombuffer(data_bytes, np.uint8)].all():
            # Words don't span letters that aren't bases.
            gaps = np.concatenate(([0], np.cumsum(~hashing.KNOWN[np.frombuffer(data_bytes, np.uint8)])))
            whole = gaps[self.at + k] == gaps[self.at]
            self.row, self.at = self.row[whole], self.at[whole]
        self.shift = (rows.column("base").to_numpy() - starts)[self.row]
        self.rows = rows

    def keys(self, chosen: np.ndarray) -> list[np.ndarray]:
        return [self.rows.column(c).take(pa.array(self.row[chosen])) for c in KEY]

    def canonical(self, at: np.ndarray, k: int) -> pa.Array:
        """Keys of the k-mers at some positions: whole numbers, or beyond 31 bases a high and a low part in the same order."""
        if k <= MAX_INT_K:
            ahead, back = hashing.words(self.codes, k)
            return pa.array(np.minimum(ahead[at], back[at]).view(np.int64))
        high, low = hashing.words(self.codes, k - 32), hashing.words(self.codes, 32)
        rest = at + (k - 32)
        ahead, back = (high[0][at], low[0][rest]), (high[1][at + 32], low[1][at])
        first = (ahead[0] < back[0]) | (ahead[0] == back[0]) & (ahead[1] <= back[1])
        hi, lo = (np.where(first, x, y) for x, y in zip(ahead, back))
        return pa.StructArray.from_arrays([pa.array(hi.view(np.int64)), pa.array(hashing.ordered(lo))], ["hi", "lo"])


def blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[Block]:
    for b in batches:
        start, size = 0, 0
        for n, x in enumerate(b.column("bases")):
            size += len(x.as_buffer())
            if size >= BLOCK or n == b.num_rows - 1:
                yield Block(b.slice(start, n + 1 - start), k)
                start, size = n + 1, 0


def on_blocks(cut: DataFrame, k: int, work: Callable[[Block], list], schema: str) -> DataFrame:
    """Rows that a function makes of each block of chunks."""
    names = [c.split()[0] for c in schema.split(", ")]  # nested types have no blank after their commas

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, k):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in work(block)], names)

    return cut.mapInArrow(run, schema)


def over_blocks(records: DataFrame, k: int, work: Callable[[Block], list], schema: str) -> DataFrame:
    """Rows that a function makes of each block of dealt chunks."""
    return on_blocks(dealt(records, k), k, work, schema)


def dealt(records: DataFrame, k: int) -> DataFrame:
    """Chunks in partitions of even work.

    An input of at least as many files as a shuffle has partitions, none of which
    stands for more than a task's bytes, is spread as it is: what is one chunk
    stays where it is read, and only long sequences are shuffled (the input is
    read once for each kind).  Any other input, such as one file, is shuffled
    whole, to as many tasks as its size demands: bases are compact, and tasks
    that are coalesced by their bytes would hold ever more k-mers.
    """
    n, partitions = tasks(records), int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if len(records.inputFiles()) < partitions or n > max(partitions, records.sparkSession.sparkContext.defaultParallelism):
        return chunks(records, k).repartition(n, *KEY, "base")
    return chunks(records, k, cut=False).unionByName(chunks(records, k, cut=True).repartition(n, *KEY, "base"))


def key_type(k: int) -> str:
    return "bigint" if k <= MAX_INT_K else "struct<hi:bigint,lo:bigint>"


def kmers(records: DataFrame, p: SketchParams, deal: bool = True) -> DataFrame:
    """Every k-mer with its offset and canonical key: sketch_id, rec_id, pos and kmer.

    Short sequences that are spread already needn't be dealt.
    """

    def work(x: Block) -> list:
        return [*x.keys(slice(None)), x.at + x.shift, x.canonical(x.at, p.k)]

    return on_blocks(dealt(records, p.k) if deal else chunks(records, p.k), p.k, work, f"sketch_id bigint, rec_id bigint, pos bigint, kmer {key_type(p.k)}")


def mmers(records: DataFrame, m: int) -> DataFrame:
    """Every m-mer: sketch_id, rec_id, pos, code (as read), mmer (canonical) and ho (hash order)."""

    def work(x: Block) -> list:
        ahead, back = hashing.words(x.codes, m)
        canonical = np.minimum(ahead, back)
        return [*x.keys(slice(None)), x.at + x.shift, ahead[x.at].view(np.int64), canonical[x.at].view(np.int64), hashing.ordered(hashing.xxh64(canonical))[x.at]]

    return over_blocks(records, m, work, "sketch_id bigint, rec_id bigint, pos bigint, code bigint, mmer bigint, ho bigint")


def order_of(canonical: np.ndarray, p: SketchParams) -> np.ndarray:
    """Signed numbers in the order in which canonical m-mers are preferred as minimizers."""
    h = hashing.xxh64(canonical)
    if p.order == "decycling":
        h = hashing.by_class(h, hashing.decycling_class(canonical, p.m))
    return hashing.ordered(h)


def _minima(x: Block, p: SketchParams) -> tuple[np.ndarray, ...]:
    """Canonical m-mers, whether they are read in reverse, their hash order, and where each k-mer's minimizer starts."""
    ahead, back = hashing.words(x.codes, p.m)
    canonical = np.minimum(ahead, back)
    ho = order_of(canonical, p)
    return canonical.view(np.int64), back < ahead, ho, hashing.least_at(ho, p.window)[x.at]


def selected(x: Block, p: SketchParams, most: int) -> list:
    """Columns sketch_id, rec_id, pos, minimizer, kmer and pos_min of a block's k-mers whose minimizer's hash order is at most that."""
    canonical, _, ho, at = _minima(x, p)
    chosen = np.flatnonzero(ho[at] <= most)
    at = at[chosen]
    return [*x.keys(chosen), x.at[chosen] + x.shift[chosen], canonical[at], x.canonical(x.at[chosen], p.k), at - x.at[chosen]]


def minimizers(records: DataFrame, p: SketchParams, most: int | None = None) -> DataFrame:
    """Every k-mer with its minimizer; with ``most`` only those whose minimizer's hash order is at most that.

    Columns: sketch_id, rec_id, pos, kmer (canonical key), minimizer (number of
    the canonical m-mer), ho (its hash order), mpos (offset of its leftmost
    occurrence) and is_rev (whether it stands there reversed).
    """

    def work(x: Block) -> list:
        canonical, turned, ho, at = _minima(x, p)
        chosen = slice(None) if most is None else np.flatnonzero(ho[at] <= most)
        at = at[chosen]
        return [*x.keys(chosen), x.at[chosen] + x.shift[chosen], x.canonical(x.at[chosen], p.k), canonical[at], ho[at], at + x.shift[chosen], turned[at]]

    return over_blocks(records, p.k, work, f"sketch_id bigint, rec_id bigint, pos bigint, kmer {key_type(p.k)}, minimizer bigint, ho bigint, mpos bigint, is_rev boolean")


def leveled(records: DataFrame, p: SketchParams, limits: list[int]) -> DataFrame:
    """k-mers whose minimizer's hash order is at most the last of some rising limits: sketch_id, kmer and level (the first limit that isn't under it)."""

    def work(x: Block) -> list:
        _, _, ho, at = _minima(x, p)
        level = np.searchsorted(np.array(limits, np.int64), ho[at])
        chosen = np.flatnonzero(level < len(limits))
        return [x.keys(chosen)[0], x.canonical(x.at[chosen], p.k), level[chosen].astype(np.int32)]

    return over_blocks(records, p.k, work, f"sketch_id bigint, kmer {key_type(p.k)}, level int")


def runs(records: DataFrame, p: SketchParams, with_seq: bool = False) -> DataFrame:
    """Runs of k-mers that share one occurrence of a minimizer, cut at the ends of chunks.

    Columns: sketch_id, rec_id, mpos, start, n_kmers, minimizer, ho, is_rev and,
    if wanted, seq (the bases of the run).
    """

    def work(x: Block) -> list:
        canonical, turned, ho, at = _minima(x, p)
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (x.row[1:] != x.row[:-1])))) if len(at) else np.empty(0, np.int64)
        counts = np.diff(np.append(first, len(at)))
        at, begin = at[first], x.at[first]
        found = [*x.keys(first), at + x.shift[first], begin + x.shift[first], counts, canonical[at], ho[at], turned[at]]
        if not with_seq:
            return found
        letters = np.frombuffer(b"ACTG", np.uint8)[x.codes].tobytes()
        seqs = [letters[s : s + n] for s, n in zip(begin.tolist(), (counts + p.k - 1).tolist())]
        return [*found, pa.array(seqs, pa.binary()).cast(pa.string())]

    schema = "sketch_id bigint, rec_id bigint, mpos bigint, start bigint, n_kmers bigint, minimizer bigint, ho bigint, is_rev boolean"
    return over_blocks(records, p.k, work, f"{schema}, seq string" if with_seq else schema)


def most_selected(p: SketchParams) -> int:
    """The largest hash order that is selected."""
    return ordered(p.threshold())


def is_selected(p: SketchParams) -> Column:
    """Whether a minimizer's hash is at most the threshold (unsigned)."""
    return F.col("ho") <= F.lit(most_selected(p)).cast("bigint")
