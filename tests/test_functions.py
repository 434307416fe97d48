import pytest
import xxhash
from pyspark.sql import functions as F

from helixmill.functions import dna, packing
from helixmill.functions.params import SketchParams, ordered

from . import model

HASHES = {0: 2089024008308347993, 1: 4806500305925943593, 27: 17490068043288970716, 452: 12120085680329909, 12345: 8088850410016834736, 1073741823: 8162471337011206963}
THRESHOLDS = {
    (1000, 31, 11): 878834950402620, (100, 31, 11): 8826267444307538, (10, 31, 11): 92318620588483954, (2, 31, 11): 598932972098291230,
    (10, 31, 15): 113973418633854036, (10, 21, 7): 129116574041335046, (4, 21, 7): 350415488267061736, (4, 15, 5): 476182224416525922,
    (8, 15, 5): 222575360102076914, (2, 15, 5): 1126525861838007544, (1, 31, 11): 18446744073709551615,
}


def test_hash_order(spark):
    rows = spark.createDataFrame([(c,) for c in HASHES], "c bigint").select("c", dna.hash_order(F.col("c")).alias("h")).collect()
    assert {r.c: r.h for r in rows} == {c: ordered(h) for c, h in HASHES.items()}
    assert all(xxhash.xxh64_intdigest(c.to_bytes(8, "little"), seed=1312) == h for c, h in HASHES.items())


@pytest.mark.parametrize("key", THRESHOLDS)
def test_threshold(key):
    s, k, m = key
    assert SketchParams(k, m, s).threshold() == THRESHOLDS[key]


def test_normalised():
    p = SketchParams(30, 16).normalised()
    assert (p.k, p.m) == (31, 15)
    with pytest.raises(ValueError):
        SketchParams(65, 11).normalised()
    with pytest.raises(ValueError):
        SketchParams(11, 11).normalised()


def test_scalars(spark):
    rows = [("acgtNN-ACGT",), ("xyz",), ("",), (None,), ("GGGATTTT",)]
    out = spark.createDataFrame(rows, "t string").select(
        dna.clean(F.col("t")).alias("seq"),
        dna.reverse_complement(dna.clean(F.col("t"))).alias("rc"),
        dna.digits(dna.clean(F.col("t"))).alias("d"),
        dna.canonical(dna.digits(dna.clean(F.col("t")))).alias("cd"),
    ).collect()
    assert [r.seq for r in out] == ["ACGTACGT", "", "", None, "GGGATTTT"]
    assert out[4].rc == "AAAATCCC" and out[4].d == "33302222" and out[4].cd == "00002111"


def test_number_round_trip(spark):
    seqs = ["T" * 31, "G" * 31, "A" * 31, "ACGTACGTACGTACGTACGTACGTACGTACG"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").withColumn("n", dna.number(dna.digits(F.col("s"))))
    rows = df.select("s", "n", dna.text_of(F.col("n"), 31).alias("t")).collect()
    assert all(r.s == r.t and r.n == model.number(r.s) for r in rows)


def test_packing(spark):
    seqs = ["", "A", "ACG", "ACGT", "GATTACAGATTACA"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", packing.pack(F.col("s")).alias("p"))
    rows = df.select("s", "p", packing.unpack(F.col("p")).alias("u")).collect()
    assert all(r.s == r.u and len(r.p) == 1 + (len(r.s) + 3) // 4 and r.p[0] == len(r.s) % 4 for r in rows)


def test_decycling_covers_all_rotations(spark):
    from itertools import product

    words = ["".join(w) for w in product("0123", repeat=3)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", dna.decycling_class(F.col("w"), 3).alias("c")).collect()
    kind = {r.w: r.c for r in rows}
    for w in words:  # every rotation cycle of an m-mer that isn't constant is hit
        if len(set(w)) > 1:
            assert any(kind[w[i:] + w[:i]] == 2 for i in range(3))


def test_decycling_classes(spark):
    """Classes by the definition, in arrays and in columns; every cycle of rotations has one m-mer of class 2 at least, unless all its sums are 0."""
    import math

    import numpy as np

    from helixmill.functions import dna, hashing

    for m in (3, 5, 7):
        x = np.arange(4**m, dtype=np.uint64)
        digits = [[int(n) >> 2 * (m - 1 - i) & 3 for i in range(m)] for n in x]
        weigh = lambda d: sum(math.sin(2 * math.pi * i / m) * c for i, c in enumerate(d))
        want = []
        for d in digits:
            here, turned = weigh(d), weigh([d[-1], *d[:-1]])
            want.append(2 if here > 1e-6 > turned else 1 if here < -1e-6 < turned else 0)
        got = hashing.decycling_class(x, m)
        assert got.tolist() == want
        by_digits = dict(zip(map(tuple, digits), want))
        for d in by_digits:
            turns = [d[i:] + d[:i] for i in range(m)]
            assert any(by_digits[t] == 2 for t in turns) or all(abs(weigh(t)) < 1e-6 for t in turns)
        frame = spark.createDataFrame([("".join(map(str, d)),) for d in digits], "d string")
        assert [r.c for r in frame.select(dna.decycling_class(frame.d, m).alias("c")).collect()] == want
    order = hashing.by_class(np.array([2**64 - 1, 5, 7], np.uint64), np.array([2, 1, 0]))
    assert order.tolist() == [2**62 - 1, 2**62 + 5, 2**63 + 7]
