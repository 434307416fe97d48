import gzip

import pytest

from helixmill.__main__ import main
from helixmill.functions.params import SketchParams
from helixmill.sources import exchange, fasta
from . import model
from .test_sketch import random_seqs


def matrix(folder):
    lines = "".join(gzip.decompress(f.read_bytes()).decode() for f in sorted(folder.glob("part-*"))).split()
    return [line.split(",") for line in lines]


def test_from_sequences_to_errors(spark, tmp_path, capsys):
    shared, paths = random_seqs(1, 900, 41)[0], []
    for k in range(3):
        (tmp_path / f"g{k}.fa").write_text(f">a\n{shared[k * 30 :]}{random_seqs(1, 300, k)[0]}\n")
        paths.append(str(tmp_path / f"g{k}.fa"))
    (tmp_path / "all").write_text("\n".join(paths) + "\n")
    out = str(tmp_path / "out")
    main(["sketch", "-f", str(tmp_path / "all"), "-k", "14", "-m", "5", "-s", "2", "-o", out])
    listed = (tmp_path / "out" / "subsampled_all.txt").read_text().split()
    assert capsys.readouterr().out.split() == listed == [f"{out}/subsampled_g{k}.gz" for k in range(3)]
    p = SketchParams(15, 5, 2)  # even sizes become odd
    kept = [set(model.sketch([r.seq for r in fasta.read_fasta(spark, [f]).collect()], 15, 5, p.threshold())) for f in paths]
    assert {(r.sketch_id, r.minimizer, r.kmer) for r in exchange.read_sketches(spark, listed, p).collect()} == {(i, *key) for i, s in enumerate(kept) for key in s}

    main(["compare", "-f", f"{out}/subsampled_all.txt", "-o", str(tmp_path / "scores"), "-p", "17"])
    names, *rows = matrix(tmp_path / "scores_jaccard.csv.gz")
    assert names == [f"subsampled_g{k}.gz" for k in range(3)]
    assert [[float(x) for x in r] for r in rows] == [[len(a & b) / len(a | b) for b in kept] for a in kept]
    (tmp_path / "some").write_text(f"{listed[1]}\n")
    main(["compare", "-f", f"{out}/subsampled_all.txt", "-q", str(tmp_path / "some"), "-o", str(tmp_path / "few")])
    names, *rows = matrix(tmp_path / "few_containment.csv.gz")
    assert names == ["subsampled_g1.gz", *(f"subsampled_g{k}.gz" for k in range(3))] and len(rows) == 1 and rows[0][2] == "1"

    (tmp_path / "order").write_text("\n".join(f"x/subsampled_g{k}.gz" for k in (2, 0, 1)) + "\n")
    main(["sort", str(tmp_path / "scores_jaccard.csv.gz"), str(tmp_path / "sorted"), str(tmp_path / "order"), "-p", "17"])
    names, *rows = matrix(tmp_path / "sorted")
    order = [kept[k] for k in (2, 0, 1)]
    assert names == [f"subsampled_g{k}.gz" for k in (2, 0, 1)] and [[float(x) for x in r] for r in rows] == [[len(a & b) / len(a | b) for b in order] for a in order]

    (tmp_path / "truth.csv").write_text(";".join(["name", *"abc"]) + "\n" + "".join(";".join(["n", *("0" if i == j else "0.5" for j in range(3))]) + "\n" for i in range(3)))
    main(["errors", str(tmp_path / "truth.csv"), f"2:7.5:{tmp_path / 'scores_jaccard.csv.gz'}", "-t", "ram", "-o", str(tmp_path / "table"), "--triangle"])
    mean = sum(len(a & b) / len(a | b) for a in kept for b in kept) / 9
    row = spark.read.csv(str(tmp_path / "table"), header=True).first()
    assert (row.type, row.threshold, row.ram, row.tool) == ("error", "2", "7.5", "sketch") and abs(float(row.value) - abs(6 / 9 - mean)) < 1e-9
    assert "'l1'" in capsys.readouterr().out


def test_sketch_needs_an_input():
    with pytest.raises(SystemExit):
        main(["sketch", "-k", "21"])
