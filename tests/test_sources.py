import gzip
import zlib

import pytest

from helixmill.functions.params import SketchParams
from helixmill.operators import sketch
from helixmill.sources import fasta
from helixmill.streaming.folder import read_records, read_sketch, sketch_stream

FASTA = ">one\nACGT\nnnAC\n>two\r\nGGTT\r\n\n>three\nT>A\n"


def seqs(rows):
    found = {}
    for r in rows.orderBy("sketch_id", "rec_id").collect():
        found.setdefault(r.sketch_id, []).append(r.seq)
    return found


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b"no marker\nTTTT\n"))
    (tmp_path / "empty.fa").write_text("")
    paths = [str(tmp_path / n) for n in ("a.fa", "b.fa.gz", "empty.fa", "a.fa")]
    got = seqs(fasta.read_fasta(spark, paths))
    assert got[0] == ["ACGTAC", "GGTT", "TA"] == got[3] and got[1] == ["TTTT"] and got.get(2, []) in ([], [""])


def test_hidden_compression(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(gzip.compress(FASTA.encode()))
    (tmp_path / "y.fa").write_bytes(zlib.compress(FASTA.encode()))
    (tmp_path / "z.fa").write_text(FASTA)
    got = seqs(fasta.read_any_fasta(spark, [str(tmp_path / n) for n in ("x.fa", "y.fa", "z.fa")]))
    assert got[0] == got[1] == got[2] == ["ACGTAC", "GGTT", "TA"]


def test_lists_and_tables(spark, tmp_path):
    (tmp_path / "list").write_text("a/b.fa\n\nx\nabc\n/c/d.fa.gz\n")
    assert [(r.ord, r.path) for r in fasta.read_paths(spark, str(tmp_path / "list"), fasta.BUILD).collect()] == [(0, "a/b.fa"), (3, "/c/d.fa.gz")]
    assert fasta.read_paths(spark, str(tmp_path / "list"), fasta.COMPARE).count() == 3
    (tmp_path / "m.csv").write_text("a,b\n\n1,0.5\n0.25,1\n")
    assert {(r.i, r.j): r.value for r in fasta.read_matrix(spark, str(tmp_path / "m.csv")).collect()} == {(0, 0): 1, (0, 1): 0.5, (1, 0): 0.25, (1, 1): 1}
    (tmp_path / "d.csv").write_text("name;a;b\na;0;0.25\nb;0.25;0\n")
    assert {(r.i, r.j): r.value for r in fasta.read_distances(spark, str(tmp_path / "d.csv")).collect()} == {(0, 0): 1, (0, 1): 0.75, (1, 0): 0.75, (1, 1): 1}
    (tmp_path / "run_12_x.tsv").write_text("s\tuser\tram\tio\tt\n1\t9\t250\t8\t3.5\n")
    row = fasta.read_benchmarks(spark, [str(tmp_path / "run_12_x.tsv")]).first()
    assert (row.key, row.ram, row.time) == (12, 250.0, 3.5)
    assert fasta.read_sizes(spark, [str(tmp_path / "d.csv")]).first().mib == (tmp_path / "d.csv").stat().st_size / 1048576


def test_paths_are_matched_whole(spark, tmp_path):
    """Names that end alike, blanks, marks of patterns, files listed twice, and files that don't exist."""
    (tmp_path / "sub").mkdir()
    names = ["x.fa", "sub/x.fa", "with a blank.fa", "50%.fa", "a[1].fa", "sub/x.fa"]
    for k, n in enumerate(names[:5]):
        (tmp_path / n).write_text(f">h\n{'ACGT' * (k + 1)}\n")
    paths = [str(tmp_path / n) for n in names]
    for read in (fasta.read_fasta, fasta.read_any_fasta):
        got = {k: [x for x in v if x] for k, v in seqs(read(spark, paths)).items()}
        assert got == {**{k: ["ACGT" * (k + 1)] for k in range(5)}, 5: ["ACGT" * 2]}
        assert set(seqs(read(spark, paths[:3], [7, 7, 9]))) == {7, 9}
        with pytest.raises(FileNotFoundError):
            read(spark, [*paths, str(tmp_path / "none.fa")])


def test_large_files_are_read_in_pieces(spark, tmp_path):
    (tmp_path / "m.txt").write_text("".join(f"line {k}\n\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    rows = fasta.numbered_lines(spark, str(tmp_path / "m.txt"))
    assert rows.rdd.getNumPartitions() > 3 and {r.line: r.value for r in rows.collect()} == {k: f"line {k}" for k in range(3000)}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_pieces_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    """Beyond the bound of what is broadcast, lines and records are the same."""
    for name in "ab":
        (tmp_path / f"{name}.fq").write_text("".join(f"@{k}\n{'ACGT' * (k % 5)}C\n+\n~\n" for k in range(600)))
    paths = [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    few = sorted(map(tuple, fasta.read_fastq(spark, paths).collect()))
    monkeypatch.setattr(fasta, "BROADCAST_ROWS", 1)
    lines = fasta.numbered_lines(spark, paths)
    many = sorted(map(tuple, fasta.read_fastq(spark, paths).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "hint" not in lines._jdf.queryExecution().logical().toString().lower()
    assert many == few == sorted((i, k, "ACGT" * (k % 5) + "C") for i in range(2) for k in range(600))


def test_fastq_and_names(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@a\nACGT\n+\n@III\n@b\nGG\n+\nII\n")
    got = fasta.read_fastq(spark, [str(tmp_path / "r.fq")] * 2).collect()
    assert sorted((r.sketch_id, r.rec_id, r.seq) for r in got) == [(0, 0, "ACGT"), (0, 1, "GG"), (1, 0, "ACGT"), (1, 1, "GG")]
    df = spark.createDataFrame([("/x/y/z.fa.gz",)], "p string")
    assert df.select(fasta.output_name(df.p, "subsampled_").alias("n")).first().n == "subsampled_z.gz"


def test_stream_equals_batch(spark, tmp_path):
    p = SketchParams(15, 5, 2)
    rows = [(i, 0, "ACGTTGCATGTCGCATGATGCATGAGAGCTACGATTACAGATTACACCATG"[i:]) for i in range(4)]
    frame = spark.createDataFrame(rows, "sketch_id bigint, rec_id bigint, seq string")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    # Sketch 1 arrives in two parts.
    again = frame.where("sketch_id >= 1").selectExpr("sketch_id", "rec_id + 1 AS rec_id", "seq")
    frame.where("sketch_id < 2").write.parquet(source)
    for _ in range(2):
        sketch_stream(read_records(spark, source), target, str(tmp_path / "ckpt"), p).awaitTermination(120)
        again.write.mode("append").parquet(source)
    columns = ["sketch_id", "minimizer", "kmer", "cnt"]
    for a in (1, 2):
        many = SketchParams(15, 5, 2, a)
        want = sketch.build(frame.where("sketch_id < 2").unionByName(again), many).select(columns).collect()
        assert sorted(read_sketch(spark, target, many).select(columns).collect()) == sorted(want)
