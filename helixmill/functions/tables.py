"""Table functions for SQL: k-mers and selected k-mers of a table of sequences.

Both take a table with the columns sketch_id, rec_id and seq, in that order and
under any names, which SQL may partition or order as it likes: rows are worked
on in Arrow batches, each for itself.  Letters other than ACGT are deleted;
rows without a sketch_id or a sequence give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import minimizers
from ..sources.streams import bases_of
from .params import MAX_INT_K, SketchParams


def _blocks(rows: pa.RecordBatch, k: int) -> Iterator[minimizers.Block]:
    """The cleaned sequences of some rows, long ones in overlapping chunks, a bounded number of bases at a time."""
    if k > MAX_INT_K:
        raise ValueError(f"k-mers of a table function have {MAX_INT_K} bases at most")
    held: list[tuple[int, int | None, int, bytes]] = []
    size = 0

    def block() -> minimizers.Block:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*held), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        return minimizers.Block(pa.RecordBatch.from_arrays(columns, [*minimizers.KEY, "base", "bases"]), k)

    for sketch_id, rec_id, seq in zip(*(rows.column(i) for i in range(3))):
        if not sketch_id.is_valid or not seq.is_valid:
            continue
        bases = bases_of(seq.as_py().encode())
        for base in range(0, max(0, len(bases) - k + 1), minimizers.CHUNK):
            held.append((sketch_id.as_py(), rec_id.as_py(), base, bases[base : base + minimizers.CHUNK + k - 1]))
            size += len(held[-1][3])
            if size >= minimizers.BLOCK:
                yield block()
                held, size = [], 0
    if held:
        yield block()


@F.arrow_udtf(returnType="sketch_id bigint, rec_id bigint, pos bigint, kmer bigint")
class SequenceKmers:
    """``sequence_kmers(TABLE(...), k)``: every k-mer with its offset and canonical key."""

    def eval(self, rows: pa.RecordBatch, k: pa.Array) -> Iterator[pa.Table]:
        size = k[0].as_py()
        for x in _blocks(rows, size):
            yield pa.table([*x.keys(slice(None)), pa.array(x.at + x.shift), x.canonical(x.at, size)], ["sketch_id", "rec_id", "pos", "kmer"])


@F.arrow_udtf(returnType="sketch_id bigint, rec_id bigint, pos bigint, minimizer bigint, kmer bigint, pos_min bigint")
class SelectedKmers:
    """``selected_kmers(TABLE(...), k, m, s)``: the k-mers that a sketch of rate s selects."""

    def eval(self, rows: pa.RecordBatch, k: pa.Array, m: pa.Array, s: pa.Array) -> Iterator[pa.Table]:
        p = SketchParams(k[0].as_py(), m[0].as_py(), float(s[0].as_py())).normalised()
        for x in _blocks(rows, p.k):
            found = minimizers.selected(x, p, minimizers.most_selected(p))
            yield pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in found], ["sketch_id", "rec_id", "pos", "minimizer", "kmer", "pos_min"])


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    spark.udtf.register("sequence_kmers", SequenceKmers)
    spark.udtf.register("selected_kmers", SelectedKmers)
