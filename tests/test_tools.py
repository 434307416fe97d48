import gzip

import pytest

from helixmill.functions.params import SketchParams
from helixmill.jobs import catalog, tools
from helixmill.sources import fasta

from . import model
from .test_sketch import random_seqs


@pytest.fixture
def files(tmp_path):
    shared = random_seqs(1, 900, 41)[0] + "ACGTTGCATGCCATTACG" * 3
    paths = []
    for k in range(3):
        own = random_seqs(2, 500, 50 + k)
        path = tmp_path / f"genome{k}.v1.fa.gz"
        path.write_bytes(gzip.compress("".join(f">r{i}\n{s}\n" for i, s in enumerate([shared[k * 50 :], *own])).encode()))
        paths.append((str(path), [shared[k * 50 :], *own]))
    return paths


def drop(spark, *tables):
    for t in tables:
        spark.sql(f"drop table if exists {t}")
        spark.sql(f"drop table if exists {t}_meta")


def test_from_files_to_errors(spark, files, tmp_path):
    drop(spark, "tool_bank", "tool_exact", "tool_queries")
    p, paths = SketchParams(15, 5, 2), [f for f, _ in files]
    made = tools.sketch_files(spark, paths, p, "tool_bank").collect()
    assert [r.name for r in made] == [f"subsampled_genome{k}.gz" for k in range(3)]
    scores, names = tools.compare_tables(spark, "tool_bank")
    kept = [set(model.sketch(s, 15, 5, p.threshold())) for _, s in files]
    cells = {(r.i, r.j): r.value for r in tools.matrix_cells(scores, names, "containment").collect()}
    assert cells == {(i, j): len(kept[i] & kept[j]) / len(kept[i]) for i in range(3) for j in range(3)}
    jaccard = tools.matrix_cells(scores, names, "jaccard")
    tools.write_matrix(jaccard, names, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines)[-1].startswith("subsampled_genome0.gz,") and len(lines) == 4

    listed = spark.createDataFrame([(5, "x/subsampled_genome2.gz"), (6, "subsampled_genome0.gz"), (9, "y/subsampled_genome1.gz")], "ord bigint, path string")
    moved, renamed = tools.sort_matrix(jaccard, names, listed)
    old = {(r.i, r.j): r.value for r in jaccard.collect()}
    at = {0: 1, 1: 2, 2: 0}
    assert {(r.i, r.j): r.value for r in moved.collect()} == {(at[i], at[j]): v for (i, j), v in old.items()}
    assert {r.sketch_id: r.name for r in renamed.collect()}[0] == "subsampled_genome2.gz"
    with pytest.raises(ValueError):
        tools.sort_matrix(jaccard, names, listed.where("ord < 9"))

    tools.sketch_files(spark, paths, SketchParams(15, 5, 1), "tool_exact", hidden=True)
    exact = tools.matrix_cells(*tools.compare_tables(spark, "tool_exact"), "jaccard")
    table = tools.error_table(exact, {2: jaccard, 1: exact}, "ram", {2: 10, 1: 30}, "own").collect()
    assert {(r.threshold, r.ram, r.tool, r.type) for r in table} == {(2, 10.0, "own", "error"), (1, 30.0, "own", "error")}
    assert {r.threshold: r.value for r in table}[1] == 0

    tools.sketch_files(spark, paths[:1], p, "tool_queries")
    found, everyone = tools.compare_tables(spark, "tool_bank", "tool_queries")
    rows = {(r.i, r.j): r.containment for r in found.collect()}
    assert set(rows) == {(0, 1), (0, 2), (0, 3)} and rows[0, 1] == 1.0 and everyone.count() == 4
    with pytest.raises(ValueError):
        tools.compare_tables(spark, "tool_bank", "tool_exact")
    drop(spark, "tool_bank", "tool_exact", "tool_queries")


def test_entry_and_catalogue():
    import __spark_entry__ as entry

    known = set(entry.queries())
    assert set(entry.oracle_sql()) <= known and len(catalog.queries()) >= 44


def test_paths_to_records(spark, files):
    frame = fasta.read_fasta(spark, [f for f, _ in files])
    got = {}
    for r in frame.collect():
        got.setdefault(r.sketch_id, []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(s) for k, (_, s) in enumerate(files)}
