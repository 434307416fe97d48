"""Byte streams that are plain, gzip or zlib, taken for what they are and read in bounded memory.

Files are opened through Arrow's filesystems, so tasks on any machine reach what
a URI names (local and network folders, object stores, HDFS).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read or inflated at once.
PIECE = 1 << 20
#: Sequences come in rows of so many bases (a multiple of what kernels take at once), and as many more as rows overlap by.
BASES = 1 << 20
_OTHER = bytes(c for c in range(256) if c not in b"ACGTacgt")
_UPPER = bytes.maketrans(b"acgt", b"ACGT")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^([a-z0-9.+-]+):/(?!/)", r"\1:///", path))


def opened(path: str):
    """A file as a stream of bytes as they are stored."""
    system, place = filesystem(path)
    return system.open_input_stream(place, compression=None)


def _is_packed(head: bytes) -> bool:
    """Whether a stream's first two bytes are those of gzip, or of zlib at a usual level."""
    return head == b"\x1f\x8b" or head in (b"\x78\x01", b"\x78\x9c", b"\x78\xda")


def pieces(stream, size: int = PIECE) -> Iterator[bytes]:
    """A stream's content in pieces of bounded size, inflated if its first bytes say that it is packed.

    Packed streams may follow each other in one file.  What ends too early is an error.
    """
    data = stream.read(size)
    while len(data) < 2 and (more := stream.read(size)):
        data += more
    if not _is_packed(data[:2]):
        while data:
            yield data
            data = stream.read(size)
        return
    inflater = zlib.decompressobj(47)  # either header
    while data or (data := stream.read(size)):
        out = inflater.decompress(data, size)
        if out:
            yield out
        data = inflater.unconsumed_tail
        if inflater.eof:
            data = inflater.unused_data or stream.read(size)
            while len(data) == 1 and (more := stream.read(size)):
                data += more
            if not _is_packed(data[:2]):  # padding, or the end
                return
            inflater = zlib.decompressobj(47)
    if not inflater.eof:
        raise EOFError("a packed stream ends before its end mark")


class Bytes:
    """Reading by counts and lines from pieces."""

    def __init__(self, source: Iterator[bytes]):
        self.source, self.held, self.at = source, b"", 0

    def _more(self) -> bool:
        piece = next(self.source, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def read(self, n: int) -> bytes:
        """The next n bytes, or what is left."""
        while len(self.held) - self.at < n and self._more():
            pass
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def line(self) -> bytes:
        """The next line without its end."""
        start = self.at
        while (end := self.held.find(b"\n", start)) < 0:
            start = len(self.held) - self.at
            if not self._more():
                return self.read(len(self.held))
        out = self.held[self.at : end]
        self.at = end + 1
        return out


def bases_of(data: bytes) -> bytes:
    """Only the letters ACGTacgt of some bytes, in upper case."""
    return data.translate(_UPPER, _OTHER)


def records(source: Iterator[bytes], overlap: int | None) -> Iterator[tuple[int, int, bytes]]:
    """FASTA records of a stream as (number, offset, bases): only the letters ACGT, in upper case.

    A record's first line is its header, whatever it is.  With an overlap, long
    records come in rows of ``BASES`` bases and the overlap; without one, each is a row.
    """
    number, offset, in_header, held, kept, size = 0, 0, True, b"", [], 0

    def rows(last: bool) -> Iterator[tuple[int, int, bytes]]:
        nonlocal offset, kept, size
        if not last and (overlap is None or size < BASES + overlap):
            return
        seq = b"".join(kept)
        while overlap is not None and len(seq) > BASES + overlap:
            yield number, offset, seq[: BASES + overlap]
            seq, offset = seq[BASES:], offset + BASES
        if last:
            yield number, offset, seq
            seq, offset = b"", 0
        kept, size = [seq], len(seq)

    def keep(body: bytes) -> None:
        nonlocal size
        kept.append(bases_of(body))
        size += len(kept[-1])

    begun = False
    for piece in source:
        begun, held = True, held + piece
        while held:
            if in_header:
                end = held.find(b"\n")
                if end < 0:
                    held = b""
                else:  # the line's end may begin the next header
                    held, in_header = held[end:], False
                continue
            end = held.find(b"\n>")
            if end < 0:
                tail = held[-1:] == b"\n"
                keep(held[:-1] if tail else held)
                held = b"\n" if tail else b""
                yield from rows(False)
                break
            keep(held[:end])
            held, in_header = held[end + 2 :], True
            yield from rows(True)
            number += 1
    if begun:
        yield from rows(True)


class FilePart(InputPartition):
    def __init__(self, place: int, path: str):
        super().__init__(place)
        self.place, self.path = place, path


class ListedFiles(DataSourceReader):
    """One partition for each file of the option ``paths`` (a JSON list)."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[FilePart]:
        return [FilePart(i, p) for i, p in enumerate(json.loads(self.options["paths"]))]


class FastaStreams(DataSource):
    """FASTA files of any packing: place (of the file in the list), record, base (offset) and seq.

    Options: ``paths`` (a JSON list) and, if records are to come in overlapping
    rows of bounded size, ``overlap`` (bases).
    """

    @classmethod
    def name(cls) -> str:
        return "fasta_streams"

    def schema(self) -> str:
        return "place bigint, record bigint, base bigint, seq string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


class FastaReader(ListedFiles):
    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        overlap = self.options.get("overlap")
        rows, size = [], 0
        with opened(part.path) as stream:
            for row in records(pieces(stream), None if overlap is None else int(overlap)):
                rows.append(row)
                size += len(row[2]) + 64
                if size >= PIECE:
                    yield self._batch(part.place, rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(part.place, rows)

    @staticmethod
    def _batch(place: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        number, base, seq = zip(*rows)
        columns = [pa.array([place] * len(rows), pa.int64()), pa.array(number, pa.int64()), pa.array(base, pa.int64()), pa.array(seq, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["place", "record", "base", "seq"])
