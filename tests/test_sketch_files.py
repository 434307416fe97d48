import gzip
import io
import random
import struct
import tracemalloc
import zlib

import pytest

from helixmill.functions.params import SketchParams
from helixmill.jobs import tools
from helixmill.operators import sketch, superkmers
from helixmill.sources import exchange, fasta, streams
from . import model
from .test_sketch import random_seqs, records


@pytest.mark.parametrize("p", [SketchParams(15, 5, 2), SketchParams(21, 7, 1), SketchParams(15, 5, 1, 2), SketchParams(33, 11, 2)])
def test_round_trip(spark, tmp_path, p):
    made, paths = [random_seqs(3, 500, 60 + k) for k in range(3)] + [["ACGT"]], []
    for k, s in enumerate(made):
        (tmp_path / f"g{k}.x.fa").write_text("".join(f">r\n{x}\n" for x in s * (1 + k % 2)))
        paths.append(str(tmp_path / f"g{k}.x.fa"))
    got = tools.sketch_to_files(spark, paths, p, str(tmp_path / "out"), "list.txt")
    assert [x.rsplit("/", 1)[1] for x in got] == [f"subsampled_g{k}.gz" for k in range(4)]
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")) == ["list.txt", *(f"subsampled_g{k}.gz" for k in range(4))]
    want = {(k, *key) for k, s in enumerate(made) for key in model.sketch(s * (1 + k % 2), p.k, p.m, p.threshold(), p.abundance)}
    plain = (lambda x: x.hi * 2**64 + x.lo + 2**63) if p.k > 31 else int
    assert {(r.sketch_id, r.minimizer, plain(r.kmer)) for r in exchange.read_sketches(spark, got, p).collect()} == want
    heads = {r.sketch_id: r for r in exchange.read_headers(spark, got).collect()}
    for k, s in enumerate(made):
        assert (heads[k].k, heads[k].m, heads[k].rate) == (p.k, p.m, p.s)
        assert heads[k].selected == sum(model.sketch(s * (1 + k % 2), p.k, p.m, p.threshold()).values())


def test_bytes_of_a_file(spark, tmp_path):
    """The layout, taken apart by hand."""
    p = SketchParams(15, 5, 1)
    (tmp_path / "a.fa").write_text(">x\n" + random_seqs(1, 400, 3)[0] + "ACGTTGCATGTCGCATGATGCATG")
    path = tools.sketch_to_files(spark, [str(tmp_path / "a.fa")], p, str(tmp_path / "out"))[0]
    data = gzip.decompress(open(path, "rb").read())
    head, at = data.split(b"\n", 1)[0], data.index(b"\n") + 1
    held = sketch.build(fasta.read_fasta(spark, [str(tmp_path / "a.fa")]), p)
    assert head == f"25 5 {sum(r.cnt for r in held.collect())} 1.000000".encode()
    found, order = [], []
    while at < len(data):
        m, (size,) = data[at : at + 5].decode(), struct.unpack("<I", data[at + 5 : at + 9])
        order.append(model.number(m))
        at += 9
        bases = "".join("ACTG"[b >> s & 3] for b in data[at + 1 : at + size] for s in (6, 4, 2, 0))
        assert not size or data[at] == 0
        found += [(order[-1], bases[i : i + 10] + m + bases[i + 10 : i + 20]) for i in range(0, len(bases), 20)]
        at += size
        while data[at : at + 2] != b"\n\n":
            before, behind, _ = data[at:].split(b"\n", 2)
            found.append((order[-1], before.decode() + m + behind.decode()))
            at += len(before) + len(behind) + 2
        at += 2
    assert order == sorted(set(order))
    assert sorted(found) == sorted((r.minimizer, r.seq) for r in superkmers.rebuild(held, p).collect())


def test_comparing_files(spark, tmp_path):
    p, shared = SketchParams(15, 5, 2), random_seqs(1, 900, 41)[0]
    paths = []
    for k in range(3):
        (tmp_path / f"g{k}.fa").write_text(f">a\n{shared[k * 40 :]}{random_seqs(1, 300, k)[0]}\n")
        paths.append(str(tmp_path / f"g{k}.fa"))
    made = tools.sketch_to_files(spark, paths, p, str(tmp_path / "out"))
    kept = [{r[1:3] for r in sketch.build(fasta.read_fasta(spark, [f]), p).collect()} for f in paths]
    scores, names = tools.compare_files(spark, made)
    assert {(r.i, r.j): r.containment for r in scores.collect()} == {(i, j): len(kept[i] & kept[j]) / len(kept[i]) for i in range(3) for j in range(3) if i != j}
    assert [r.name for r in names.orderBy("sketch_id").collect()] == [f"subsampled_g{k}.gz" for k in range(3)]
    scores, _ = tools.compare_files(spark, made, made[:1])
    assert {(r.i, r.j): r.jaccard for r in scores.collect()} == {(0, j + 1): len(kept[0] & kept[j]) / len(kept[0] | kept[j]) for j in range(3)}
    other = tools.sketch_to_files(spark, paths[:1], SketchParams(17, 5, 2), str(tmp_path / "other"))
    with pytest.raises(ValueError):
        tools.compare_files(spark, [*made, *other])


def test_names_and_overwriting(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for place in (tmp_path / "x.fa", tmp_path / "a" / "x.fa"):
        place.write_text(">a\nACGTTGCATGTCGCATGATGCATGAGAGC\n")
    p, out = SketchParams(15, 5, 1), str(tmp_path / "out")
    with pytest.raises(Exception, match="several sketches have one name"):
        tools.sketch_to_files(spark, [str(tmp_path / "x.fa"), str(tmp_path / "a" / "x.fa")], p, out)
    assert not [x for x in (tmp_path / "out").iterdir() if "temporary" in x.name]
    made = tools.sketch_to_files(spark, [str(tmp_path / "x.fa")], p, out)
    with pytest.raises(Exception, match="x.gz|sketches.txt"):
        tools.sketch_to_files(spark, [str(tmp_path / "x.fa")], p, out)
    assert tools.sketch_to_files(spark, [str(tmp_path / "x.fa")], p, out, overwrite=True) == made


def test_damaged_files(spark, tmp_path):
    good = b"25 5 9 1.000000\nACGTA" + struct.pack("<I", 6) + b"\0" + bytes(5) + b"A\nC\n\n\n"
    read = lambda data: list(exchange.super_kmers(streams.Bytes(iter([data]))))
    assert read(good) == [(b"ACGTA", b"A" * 10 + b"ACGTA" + b"A" * 10), (b"ACGTA", b"AACGTAC")]
    for bad in (good[:18], good[:24], good[:28]):
        with pytest.raises(EOFError):
            read(bad)
    with pytest.raises(ValueError):
        read(good.replace(struct.pack("<I", 6), struct.pack("<I", 5)))


# Streams.


def cut(data, size):
    return io.BytesIO(data) if size is None else type("Slow", (), {"at": 0, "read": lambda self, n: (data[self.at : self.at + min(n, size)], setattr(self, "at", self.at + min(n, size)))[0]})()


@pytest.mark.parametrize("size", [1, 7, None])
def test_pieces(size):
    data = bytes(random.Random(1).choices(b"ACGT\n", k=50_000))
    for packed in (data, gzip.compress(data), zlib.compress(data), gzip.compress(data[:900]) + gzip.compress(data[900:]), gzip.compress(data) + bytes(600)):
        assert b"".join(streams.pieces(cut(packed, size), 4096)) == data
    assert b"".join(streams.pieces(cut(b"", size))) == b"" and b"".join(streams.pieces(cut(b"A", size))) == b"A"
    for end in (2, 40, -9):
        with pytest.raises((EOFError, zlib.error)):
            list(streams.pieces(cut(gzip.compress(data)[:end], size), 4096))


def brute_records(data):
    parts = data.decode("latin-1").split("\n>")
    bodies = [p.split("\n", 1)[1] if "\n" in p else "" for p in parts]
    return ["".join(c for c in b if c in "ACGTacgt").upper() for b in bodies]


def test_records_across_pieces(monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choices(b"AcGtN\n\n>>\r", k=rng.randrange(60)))
        for size in (1, 2, 5, 100):
            got = list(streams.records((data[i : i + size] for i in range(0, len(data), size)), None))
            assert [r[2].decode() for r in got] == (brute_records(data) if data else []) and [r[0] for r in got] == list(range(len(got)))
    monkeypatch.setattr(streams, "BASES", 16)
    data = b">a\n" + bytes(rng.choices(b"ACGT", k=100)) + b"\n>b\nACG\n>c\n" + b"A" * 20
    got = list(streams.records(iter([data[:50], data[50:]]), 4))
    for number, whole in enumerate(brute_records(data)):
        rows = [r for r in got if r[0] == number]
        assert [r[1] for r in rows] == [16 * i for i in range(len(rows))] and all(len(r[2]) <= 20 for r in rows)
        assert "".join(r[2].decode()[: 16 if i < len(rows) - 1 else None] for i, r in enumerate(rows)) == whole


def test_rows_that_overlap_give_the_same_sketch(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (3_000_000, 5, 15, 40_000)]
    (tmp_path / "odd.name").write_bytes(gzip.compress("".join(f">r\n{s}\n" for s in seqs).encode()))
    p, paths = SketchParams(15, 5, 50), [str(tmp_path / "odd.name")]
    whole, rows = fasta.read_any_fasta(spark, paths), fasta.read_any_fasta(spark, paths, k=15)
    assert rows.count() == 6 and whole.count() == 4 and max(map(len, (r.seq for r in rows.collect()))) <= streams.BASES + 14
    for f in (lambda r: sketch.build(r, p), lambda r: superkmers.super_kmers(r, p, with_seq=True).where("selected"), lambda r: sketch.total_kmers(r, p)):
        assert sorted(map(tuple, f(rows).collect())) == sorted(map(tuple, f(whole).collect()))


def test_large_streams_stay_small():
    """What a stream of 400 MB holds at once doesn't grow with it."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    line = b"ACGTTGCA" * (1 << 17)
    packed = io.BytesIO(b"".join([pack.compress(b">one record\n"), *(pack.compress(line) for _ in range(400)), pack.flush()]))
    tracemalloc.start()
    total = sum(len(seq) - (20 if base else 0) for _, base, seq in streams.records(streams.pieces(packed), 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 400 * len(line) and peak < 40 << 20


def test_hot_minimizer_is_spread(spark):
    """k-mers of one minimizer are linked and chained over many tasks, in groups of bounded size."""
    rng, p = random.Random(2), SketchParams(15, 5, 1)
    seqs = ["".join(rng.choices("ACGT", k=10)) + "TTTTA" + "".join(rng.choices("ACGT", k=10)) for _ in range(3000)]
    rows = {(0, 0, s[i : i + 15], 0) for s in seqs for i in range(11)}
    nodes = spark.createDataFrame(list(rows), "sketch_id bigint, minimizer bigint, x string, at bigint").withColumn("at", superkmers.F.instr("x", superkmers.F.lit("TTTTA")) - 1).where("at >= 0")
    found = superkmers.links(nodes, p)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = found.groupBy(superkmers.F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2 * min(r["count"] for r in sizes)
    pairs = found.collect()
    assert len({r.x for r in pairs}) == len(pairs) == len({r.after for r in pairs}) and all(r.x[1:] == r.after[:-1] for r in pairs)


def test_rebuilding_takes_the_fewest(spark):
    """As many chains as k-mers less the most links that can be made, at each overlap by itself."""
    for p in (SketchParams(15, 5, 1), SketchParams(33, 11, 1)):
        rng = random.Random(4)
        base = "".join(rng.choices("ACGT", k=300))
        seqs = [base] + ["".join(c if rng.random() > 0.03 else rng.choice("ACGT") for c in base) for _ in range(8)]
        held = sketch.build(records(spark, [seqs]), p)
        nodes, rows = superkmers.placed(held, p).collect(), superkmers.rebuild(held, p).collect()
        before, behind = {}, {}
        for r in nodes:
            if r["at"] > 0:
                before.setdefault((r.minimizer, r["at"], r.x[1:]), []).append(r)
            behind.setdefault((r.minimizer, r["at"] + 1, r.x[:-1]), []).append(r)
        made = sum(min(len(b), len(behind.get(key, []))) for key, b in before.items())
        assert made > 100 and len(rows) == len(nodes) - made and all(len(r.seq) <= p.longest for r in rows)
        assert sorted((r.minimizer, r.seq[i : i + p.k]) for r in rows for i in range(r.n_kmers)) == sorted((r.minimizer, r.x) for r in nodes)
