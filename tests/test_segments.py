import random

import pytest

from helixmill.functions.params import SketchParams
from helixmill.operators import minimizers, segments, sketch

from . import model
from .test_sketch import records


def sequences():
    rng = random.Random(31)
    low = lambda n, letters: "".join(rng.choices(letters, k=n))
    return [low(700, "ACGT"), low(400, "AC"), low(300, "AT"), "A" * 200, "ACGT" * 60, low(15, "ACGT"), low(14, "ACGT"), low(16, "ACGT"), "", ("ACGTTGCAAC" + low(3, "ACGT")) * 20, low(60, "AT") * 4]


@pytest.mark.parametrize("p", [SketchParams(15, 5, 4), SketchParams(21, 7, 1), SketchParams(9, 3, 2), SketchParams(7, 5, 2)])
def test_equals_the_scan(spark, p):
    """In one chunk and in many: the pieces' state is carried over their borders."""
    seqs = sequences()
    want = {(r, s, n, code, rev) for r, seq in enumerate(seqs) if len(seq) >= p.k for s, n, code, rev in model.tracked(seq, p.k, p.m)}
    for chunk in (minimizers.CHUNK, 64, 25, 3):
        rows = segments.tracked_super_kmers(records(spark, [seqs]), p, chunk).collect()
        assert {(r.rec_id, r.start, r.len, r.minimizer, r.is_rev) for r in rows} == want and len(rows) == len(want)
        assert all(r.len <= p.longest and r.is_maximal == (r.len == p.longest) and r.n_kmers == r.len - p.k + 1 for r in rows)


def test_selects_the_same_kmers(spark):
    p, seqs = SketchParams(15, 5, 3), sequences()
    rows = segments.tracked_super_kmers(records(spark, [seqs]), p, 100).where("selected").collect()
    got = sorted((r.minimizer, model.canonical(seqs[r.rec_id][r.start + i : r.start + i + 15])) for r in rows for i in range(r.n_kmers))
    assert got == sorted((r.minimizer, r.kmer) for r in sketch.selected_kmers(records(spark, [seqs]), p).collect())


def test_nothing_to_cut(spark):
    assert segments.tracked_super_kmers(records(spark, [["", "ACG"]]), SketchParams(15, 5, 1)).count() == 0
    with pytest.raises(ValueError):
        segments.tracked_super_kmers(records(spark, [["ACGT"]]).selectExpr("*", "0 AS base"), SketchParams(15, 5, 1))
