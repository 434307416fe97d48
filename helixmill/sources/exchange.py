"""Sketches in files of their own format, for exchange with other programs.

A file is a gzip stream: a line with the length of a maximal super-k-mer, the
minimizer size, how many k-mers were selected and the rate; then, for each
minimizer in ascending order of its number, its bases, the size of what follows
packed (32 bits, little-endian), the flanks of its maximal super-k-mers at two
bits a base, and two lines (what stands before and behind the minimizer) for each
other super-k-mer, closed by two empty lines.

A file is one ordered stream, so it is written and read by one task; both stream
it and hold one super-k-mer list entry at a time.  Many sketches are many tasks.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from ..functions import dna
from ..functions.hashing import CODES
from ..functions.params import SketchParams
from ..operators.minimizers import kmers
from .fasta import located, looked_up
from .streams import Bytes, FilePart, ListedFiles, filesystem, opened, pieces

LETTERS = np.frombuffer(b"ACTG", np.uint8)
#: Packed bytes that are taken at once, and rows of a batch.
PART, ROWS = 1 << 18, 1 << 13


def pack(flanks: bytes) -> bytes:
    """Bases at two bits each, the first in the highest bits; their number is a multiple of four."""
    codes = CODES[np.frombuffer(flanks, np.uint8)].reshape(-1, 4)
    return (codes @ np.array([64, 16, 4, 1], np.uint8)).astype(np.uint8).tobytes()


def unpack(data: bytes) -> bytes:
    codes = np.frombuffer(data, np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
    return LETTERS[codes].tobytes()


def header(stream: Bytes) -> tuple[int, int, int, float]:
    """k, m, selected k-mers and rate."""
    longest, m, selected, rate = stream.line().split()
    return (int(longest) + int(m)) // 2, int(m), int(selected), float(rate)


def super_kmers(stream: Bytes) -> Iterator[tuple[bytes, bytes]]:
    """(minimizer, bases) of each super-k-mer of an opened file."""
    k, m, _, _ = header(stream)
    side = k - m
    while minimizer := stream.read(m):
        size = stream.read(4)
        if len(minimizer) < m or len(size) < 4:
            raise EOFError("a sketch file ends inside a bucket")
        left = struct.unpack("<I", size)[0]
        if left:
            rest = stream.read(1)[0]  # bases modulo 4
            left -= 1
            if rest or left % (side // 2):
                raise ValueError("packed flanks don't have the length of super-k-mers")
        while left:
            part = stream.read(min(left, PART // (side // 2) * (side // 2) or side // 2))
            if not part:
                raise EOFError("a sketch file ends inside a bucket")
            left -= len(part)
            bases = unpack(part)
            for at in range(0, len(bases), 2 * side):
                yield minimizer, bases[at : at + side] + minimizer + bases[at + side : at + 2 * side]
        while True:
            before, behind = stream.line(), stream.line()
            if not before and not behind:
                break
            yield minimizer, before + minimizer + behind


class SketchFiles(DataSource):
    """Sketch files, read as place (in the list of paths), minimizer (bases) and seq, or their headers, and written.

    Reading takes the options ``paths`` (a JSON list) and ``headers`` (``true``
    for place, k, m, selected and rate).  Writing takes rows of sketch_id, name,
    selected, n_maximal, minimizer (bases) and seq, the rows of a sketch in one
    partition and sorted by minimizer number, maximal ones first; a sketch
    without k-mers is one row without a minimizer.  Options: ``path`` (a
    folder), ``k``, ``m``, ``s`` and ``listed`` (name of the file that lists the
    sketches by their sketch_id).  Files show up under their names when all tasks have ended.
    """

    @classmethod
    def name(cls) -> str:
        return "sketch_files"

    def schema(self) -> str:
        if self.options.get("headers") == "true":
            return "place bigint, k int, m int, selected bigint, rate double"
        return "place bigint, minimizer string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return SketchReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SketchWriter(self.options, overwrite)


class SketchReader(ListedFiles):
    def read(self, part: FilePart) -> Iterator:
        with opened(part.path) as raw:
            stream = Bytes(pieces(raw))
            if self.options.get("headers") == "true":
                yield (part.place, *header(stream))
                return
            rows: list[tuple[bytes, bytes]] = []
            for row in super_kmers(stream):
                rows.append(row)
                if len(rows) >= ROWS:
                    yield self._batch(part.place, rows)
                    rows = []
            if rows:
                yield self._batch(part.place, rows)

    @staticmethod
    def _batch(place: int, rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        texts = [pa.array(c, pa.binary()).cast(pa.string()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array([place] * len(rows), pa.int64()), *texts], ["place", "minimizer", "seq"])


class Made(WriterCommitMessage):
    """Files of a task: (sketch_id, name, temporary path)."""

    def __init__(self, files: list[tuple[int, str, str]]):
        self.files = files


class SketchFile:
    """One file in the making."""

    def __init__(self, system: fs.FileSystem, path: str, selected: int, p: SketchParams):
        self.p, self.raw = p, system.open_output_stream(path)
        self.out = gzip.GzipFile(filename="", mode="wb", compresslevel=9, fileobj=self.raw, mtime=0)
        self.out.write(f"{p.longest} {p.m} {selected} {p.s:f}\n".encode())
        self.minimizer: bytes | None = None

    def bucket(self, minimizer: bytes, maximal: int) -> None:
        self._end()
        self.minimizer = minimizer
        size = 1 + maximal * (self.p.k - self.p.m) // 2 if maximal else 0
        self.out.write(minimizer + struct.pack("<I", size) + (b"\0" if maximal else b""))

    def add(self, seqs: list[bytes]) -> None:
        """Super-k-mers of the bucket; once one isn't maximal, none after it is."""
        k, m = self.p.k, self.p.m
        maximal = [s for s in seqs if len(s) == self.p.longest]
        if maximal:
            self.out.write(pack(b"".join(s[: k - m] + s[k:] for s in maximal)))
        for s in seqs[len(maximal) :]:
            at = s.find(self.minimizer)
            self.out.write(s[:at] + b"\n" + s[at + m :] + b"\n")

    def _end(self) -> None:
        if self.minimizer is not None:
            self.out.write(b"\n\n")

    def close(self) -> None:
        self._end()
        self.out.close()
        self.raw.close()


class SketchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.overwrite, self.listed = overwrite, options["listed"]
        self.p = SketchParams(int(options["k"]), int(options["m"]), float(options["s"]))
        self.folder = options["path"].rstrip("/")
        #: Where files are until all are there.
        self.waiting = f"{self.folder}/_temporary-{uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Made:
        system, place = filesystem(self.waiting)
        system.create_dir(place)
        made, file, sketch_id = [], None, None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("sketch_id", "name", "selected", "n_maximal", "minimizer", "seq")]
            at = 0
            while at < b.num_rows:
                own, name, selected, maximal, minimizer, _ = (c[at] for c in columns)
                if own != sketch_id:
                    if file:
                        file.close()
                    sketch_id, temporary = own, f"{place}/{uuid4().hex}"
                    file = SketchFile(system, temporary, selected, self.p)
                    made.append((own, name, temporary))
                end = at + 1
                while end < b.num_rows and columns[0][end] == own and columns[4][end] == minimizer:
                    end += 1
                if minimizer is not None:
                    if minimizer.encode() != file.minimizer:
                        file.bucket(minimizer.encode(), maximal)
                    file.add([s.encode() for s in columns[5][at:end]])
                at = end
        if file:
            file.close()
        return Made(made)

    def commit(self, messages: list[Made | None]) -> None:
        """Move all files to their names (one move a sketch) and list them in order of their ids."""
        files = sorted(f for message in messages if message for f in message.files)
        system, folder = filesystem(self.folder)
        names = [name for _, name, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several sketches have one name")
        taken = [i.base_name for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File]
        if not self.overwrite and (clash := set(taken) & {*names, self.listed}):
            self.abort(messages)
            raise FileExistsError(f"{self.folder}/{min(clash)}")
        for _, name, temporary in files:
            system.move(temporary, f"{folder}/{name}")
        with system.open_output_stream(f"{folder}/{self.listed}") as out:
            out.write("".join(f"{self.folder}/{name}\n" for name in names).encode())
        self.abort(messages)

    def abort(self, messages: list[Made | None]) -> None:
        system, place = filesystem(self.waiting)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


def _listed(spark: SparkSession, paths: list[str], ids: list[int] | None) -> tuple[str, DataFrame]:
    located(spark, paths, ids)  # an error if a file doesn't exist
    told = spark.createDataFrame(list(zip(range(len(paths)), range(len(paths)) if ids is None else ids)), "place bigint, sketch_id bigint")
    return json.dumps(paths), told


def read_headers(spark: SparkSession, paths: list[str], ids: list[int] | None = None) -> DataFrame:
    """What the headers of sketch files say: sketch_id (place in the list, or as given), k, m, selected and rate."""
    spark.dataSource.register(SketchFiles)
    listed, told = _listed(spark, paths, ids)
    found = spark.read.format("sketch_files").options(paths=listed, headers="true").load()
    return looked_up(found, told, "place", len(paths)).select("sketch_id", "k", "m", "selected", "rate")


def read_super_kmers(spark: SparkSession, paths: list[str], ids: list[int] | None = None) -> DataFrame:
    """Super-k-mers of sketch files: sketch_id, minimizer (number) and seq."""
    spark.dataSource.register(SketchFiles)
    listed, told = _listed(spark, paths, ids)
    found = spark.read.format("sketch_files").options(paths=listed).load()
    code = F.conv(F.translate("minimizer", "ACTG", "0123"), 4, 10).cast("bigint")
    return looked_up(found, told, "place", len(paths)).select("sketch_id", code.alias("minimizer"), "seq")


def read_sketches(spark: SparkSession, paths: list[str], p: SketchParams, ids: list[int] | None = None) -> DataFrame:
    """Sketches of sketch files: sketch_id, minimizer and canonical kmer, each once."""
    found = read_super_kmers(spark, paths, ids)
    # The minimizer goes along as the record's number.
    held = kmers(found.select("sketch_id", F.col("minimizer").alias("rec_id"), "seq"), p)
    return held.select("sketch_id", F.col("rec_id").alias("minimizer"), "kmer").distinct()


def write_sketches(rebuilt: DataFrame, names: DataFrame, p: SketchParams, folder: str, listed: str, overwrite: bool = False) -> None:
    """Write super-k-mers (sketch_id, minimizer, seq) as one file for each row of ``names`` (sketch_id, name, selected), and a list of the files."""
    spark = rebuilt.sparkSession
    spark.dataSource.register(SketchFiles)
    rows = names.select("sketch_id", "name", "selected").join(rebuilt, "sketch_id", "left")
    maximal = F.length("seq") == p.longest
    # A sketch's rows meet once; the count of each bucket needs no further exchange.
    dealt = rows.repartition("sketch_id").withColumn("n_maximal", F.count(F.when(maximal, 1)).over(Window.partitionBy("sketch_id", "minimizer")))
    ordered = dealt.sortWithinPartitions("sketch_id", "minimizer", F.desc(F.coalesce(maximal, F.lit(False))), "seq")
    text = F.when(F.col("minimizer").isNotNull(), dna.text_of(F.col("minimizer"), p.m)).alias("minimizer")
    chosen = ordered.select("sketch_id", "name", "selected", "n_maximal", text, "seq")
    chosen.write.format("sketch_files").mode("overwrite" if overwrite else "append").options(k=p.k, m=p.m, s=p.s, listed=listed).save(folder)
