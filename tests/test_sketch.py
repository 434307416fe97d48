import random

import pytest
from pyspark.sql import functions as F

from helixmill.functions import dna
from helixmill.functions.params import SketchParams
from helixmill.operators import compare, evaluate, matrix, minimizers, sketch, superkmers

from . import model

P = SketchParams(15, 5, 4)


def random_seqs(n, size, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, size))) for _ in range(n)]


def records(spark, by_sketch):
    rows = [(s, r, seq) for s, seqs in enumerate(by_sketch) for r, seq in enumerate(seqs)]
    return spark.createDataFrame(rows, "sketch_id bigint, rec_id bigint, seq string")


@pytest.mark.parametrize("p", [P, SketchParams(21, 7, 2), SketchParams(15, 5, 1), SketchParams(15, 5, 2, 2), SketchParams(15, 5, 4, 1, "fracminhash")])
def test_sketch_equals_model(spark, p):
    seqs = [random_seqs(3, 300, seed) + ["ACGTACGTACGTACGTACGTAC" * 4] for seed in range(3)]
    got = {}
    for r in sketch.build(records(spark, seqs), p).collect():
        got.setdefault(r.sketch_id, {})[r.minimizer, r.kmer] = r.cnt
    for i, s in enumerate(seqs):
        assert got.get(i, {}) == model.sketch(s, p.k, p.m, p.threshold(), p.abundance)


@pytest.mark.parametrize("k", [33, 45, 63])
def test_long_kmers_have_keys_in_two_parts(spark, k):
    """The parts are the canonical number's, sort as it does, and give the bases back."""
    p, seqs = SketchParams(k, 11, 1), random_seqs(6, 200, 77) + ["G" * 70, "C" * 70, "ACGT" * 20, ""]
    rows = sketch.build(records(spark, [seqs]), p).select("minimizer", "kmer", "cnt", dna.kmer_text(F.col("kmer"), k).alias("text")).orderBy("kmer").collect()
    number = lambda key: key.hi * 2**64 + key.lo + 2**63
    assert {(r.minimizer, number(r.kmer)): r.cnt for r in rows} == model.sketch(seqs, k, 11, p.threshold())
    assert all(model.number(r.text) == number(r.kmer) and len(r.text) == k for r in rows)
    numbers = [number(r.kmer) for r in rows]
    assert numbers == sorted(numbers) and len(numbers) > 100


def test_long_kmers_are_compared(spark, tmp_path):
    p, shared = SketchParams(41, 11, 2), random_seqs(1, 900, 5)[0]
    held = sketch.build(records(spark, [[shared[30 * i :] + random_seqs(1, 400, i)[0]] for i in range(3)]), p)
    kept = [{tuple(r.kmer) for r in held.where(F.col("sketch_id") == i).collect()} for i in range(3)]
    assert {(r.i, r.j): r.jaccard for r in compare.all_pairs(held).collect()} == {(i, j): len(kept[i] & kept[j]) / len(kept[i] | kept[j]) for i in range(3) for j in range(i + 1, 3)}
    spark.sql("drop table if exists long_bank")
    sketch.write_sketches(held, held.select("sketch_id").distinct(), "long_bank", 4, str(tmp_path))
    assert sorted(map(tuple, spark.table("long_bank").collect())) == sorted(map(tuple, held.collect()))
    spark.sql("drop table long_bank")


def test_chunks_do_not_matter(spark, monkeypatch):
    seqs = [random_seqs(2, 3000, 3)]
    whole = {(r.minimizer, r.kmer, r.cnt) for r in sketch.build(records(spark, seqs), P).collect()}
    original = minimizers.chunks
    monkeypatch.setattr(minimizers, "chunks", lambda rec, k, chunk=64, more=0: original(rec, k, 64, more))
    assert {(r.minimizer, r.kmer, r.cnt) for r in sketch.build(records(spark, seqs), P).collect()} == whole


def test_long_record_takes_many_tasks(spark):
    """A record of two million bases is cut in linear time and dealt to all partitions."""
    from time import perf_counter

    rng = random.Random(1)
    seq = "".join(rng.choices("ACGT", k=1 << 21))
    frame = records(spark, [[seq]])
    began = perf_counter()
    dealt = minimizers.chunks(frame, 21).repartition(4, "sketch_id", "rec_id", "base")
    assert dealt.count() == -(-(len(seq) - 20) // minimizers.CHUNK)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and perf_counter() - began < 30
    assert minimizers.kmers(frame, SketchParams(21, 7, 4)).count() == len(seq) - 20


def test_runs_across_chunks(spark, monkeypatch):
    """Super-k-mers and their bases are the same however sequences are cut."""
    seqs = random_seqs(3, 900, 21)
    whole = sorted(map(tuple, superkmers.super_kmers(records(spark, [seqs]), P, with_seq=True).collect()))
    original = minimizers.chunks
    monkeypatch.setattr(minimizers, "chunks", lambda rec, k, chunk=64, more=0: original(rec, k, 50, more))
    assert sorted(map(tuple, superkmers.super_kmers(records(spark, [seqs]), P, with_seq=True).collect())) == whole
    for r in superkmers.super_kmers(records(spark, [seqs]), P, with_seq=True).collect():
        assert r.seq == seqs[r.rec_id][r.start : r.start + r.len]
    for r in superkmers.flanks(superkmers.super_kmers(records(spark, [seqs]), P, with_seq=True), P).collect():
        assert len(r.left) == len(r.right) == P.k - P.m


def test_output_metrics(spark):
    held = records(spark, [random_seqs(3, 500, 23)])
    row, rebuilt = sketch.output_metrics(held, P).first(), superkmers.rebuild(sketch.build(held, P), P).collect()
    stored = [1 + -(-(len(r.seq) - P.m * (len(r.seq) == P.longest)) // 4) for r in rebuilt]
    assert (row.rebuilt, row.rebuilt_maximal) == (len(rebuilt), sum(len(r.seq) == P.longest for r in rebuilt))
    assert abs(row.output_kb - sum(stored) / 1000) < 1e-9 and abs(row.bits_per_kmer - 8 * sum(stored) / sum(r.n_kmers for r in rebuilt)) < 1e-9


def test_strands_are_alike(spark):
    seqs = random_seqs(3, 400, 5)
    turned = [s.translate(model.OTHER)[::-1] for s in seqs]
    rows = compare.all_pairs(sketch.build(records(spark, [seqs, turned]), P)).collect()
    assert len(rows) == 1 and rows[0].jaccard == 1.0 == rows[0].containment_ij


def test_rates_nest(spark):
    rec = records(spark, [random_seqs(3, 500, 11)])
    keys = [{(r.minimizer, r.kmer) for r in sketch.build(rec, SketchParams(15, 5, s)).collect()} for s in (1, 2, 4, 8)]
    assert all(b <= a for a, b in zip(keys, keys[1:])) and len(keys[0]) > len(keys[-1])


def test_segments(spark):
    seqs = random_seqs(4, 300, 13)
    rows = superkmers.super_kmers(records(spark, [seqs]), P).collect()
    for rec, seq in enumerate(seqs):
        want = {}
        for pos, code, _, at in model.minimizers(seq, P.k, P.m):
            want.setdefault(at, []).append((pos, code))
        got = {(r.start, r.len, r.minimizer) for r in rows if r["rec_id"] == rec}
        assert got == {(x[0][0], len(x) + P.k - 1, x[0][1]) for x in want.values()}
    assert all(r.len <= P.longest and r.is_maximal == (r.len == P.longest) for r in rows)


def test_rebuild_holds_each_kmer_once(spark):
    held = sketch.build(records(spark, [random_seqs(4, 400, 17)]), SketchParams(15, 5, 2))
    want = sorted(r.kmer for r in held.collect())
    rows = superkmers.rebuild(held, P).collect()
    got = sorted(model.canonical(r.seq[i : i + 15]) for r in rows for i in range(len(r.seq) - 14))
    assert got == want and all(len(r.seq) <= P.longest and r.n_kmers == len(r.seq) - 14 for r in rows)


def test_metrics(spark):
    seqs = random_seqs(3, 400, 19)
    row = sketch.metrics(records(spark, [seqs]), P).collect()[0]
    mins = [x for s in seqs for x in model.minimizers(s, 15, 5)]
    assert row.total_kmers == len(mins) and row.selected_kmers == sum(h <= P.threshold() for _, _, h, _ in mins)
    assert row.distinct_kmers == len(model.sketch(seqs, 15, 5, P.threshold()))


def sets(spark, *members):
    rows = [(i, 0, x, 1, 0) for i, s in enumerate(members) for x in s]
    return spark.createDataFrame(rows, "sketch_id bigint, minimizer bigint, kmer bigint, cnt bigint, pos_min bigint")


def test_comparison(spark):
    pairs = compare.all_pairs(sets(spark, {1, 2, 3, 4}, {3, 4, 5}, set())).collect()
    assert [(r.i, r.j, r.n_shared, r.containment_ij, r.containment_ji, r.jaccard) for r in pairs] == [(0, 1, 2, 0.5, 2 / 3, 0.4)]
    ids = spark.createDataFrame([(0,), (1,), (2,)], "sketch_id bigint")
    scored = compare.at_least(compare.all_pairs(sets(spark, {1, 2, 3, 4}, {3, 4, 5})), "jaccard", 0.45, sparse=False)
    cells = {(r.i, r.j): r.value for r in matrix.dense(scored, ids, "jaccard").collect()}
    assert cells == {(i, j): float(i == j) for i in range(3) for j in range(3)}
    assert compare.at_least(compare.all_pairs(sets(spark, {1, 2, 3, 4}, {3, 4, 5})), "jaccard", 0.45).count() == 0


def test_pairs_of_hot_kmers(spark, monkeypatch):
    """k-mers in every sketch: pairs are made once, in blocks."""
    rng = random.Random(2)
    members = [set(range(40)) | {rng.randrange(100, 160) for _ in range(9)} for _ in range(50)]
    want = {(i, j): len(members[i] & members[j]) for i in range(50) for j in range(i + 1, 50)}
    for block in (256, 7):
        monkeypatch.setattr(compare, "HOLDERS", block)
        assert {(r.i, r.j): r.n_shared for r in compare.shared(sets(spark, *members)).collect()} == want
    colors = compare.color_map(sets(spark, {1, 2}, {2, 3}, {2})).collect()
    assert sorted((r.kmer, r.sketch_id, r.n_sketches) for r in colors) == [(2, 0, 3), (2, 1, 3), (2, 2, 3)]


def test_pairs_of_new_rows(spark, monkeypatch):
    """Counts where one of both rows is new, in blocks, in crowded cells and few pairs at once; with what was counted before they are those of all rows."""
    rng = random.Random(3)
    members = [set(range(30)) - {rng.randrange(30)} | {rng.randrange(100, 130) for _ in range(9)} for _ in range(40)]
    rows = [(i * 7 - 9, 0, x, rng.random() < 0.4) for i, s in enumerate(members) for x in s]
    held = spark.createDataFrame(rows, "sketch_id bigint, minimizer bigint, kmer bigint, fresh boolean")
    want, n = {}, {}
    for i, _, x, new in rows:
        n[i] = n.get(i, 0) + 1
        for j, _, y, other in rows:
            if i < j and x == y and (new or other):
                want[i, j] = want.get((i, j), 0) + 1
    old = {(r.i, r.j): r.n_shared for r in compare.shared(held.where("not fresh")).collect()}
    every = {(r.i, r.j): r.n_shared for r in compare.shared(held).collect()}
    for block, pairs, once in ((256, 1 << 23, 1 << 21), (7, 40, 50)):
        for name, value in {"HOLDERS": block, "PAIRS": pairs, "AT_ONCE": once}.items():
            monkeypatch.setattr(compare, name, value)
        got = compare.shared(held, fresh=True, sizes=compare.cardinality(held)).collect()
        assert {(r.i, r.j): r.n_shared for r in got} == want and all((r.n_i, r.n_j) == (n[r.i], n[r.j]) for r in got)
    assert {p: want.get(p, 0) + old.get(p, 0) for p in every} == every and any(want.get(p, 0) for p in old)


def test_alike_sets_meet(spark, monkeypatch):
    """k-mers that nearly the same sketches hold: their pairs are added up where they are made, so rows that are shuffled are about as many as the pairs."""
    rng = random.Random(4)
    held = [(i, 0, x, 1, 0) for x in range(60) for i in range(80) if i % 79 == 0 or rng.random() < 0.95]
    made = []
    rows = spark.createDataFrame(held, "sketch_id bigint, minimizer bigint, kmer bigint, cnt bigint, pos_min bigint")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, s, real=type(rows).mapInArrow: (made.append(real(self, f, s)), made[-1])[1])
    pairs = compare.shared(rows)
    assert pairs.count() == 80 * 79 // 2 and pairs.agg(F.sum("n_shared")).first()[0] > 150_000
    assert made and made[0].count() < 4 * 80 * 79 // 2


def test_bank(spark):
    held = sets(spark, {1, 2}, {2, 3}, {1, 2, 3})
    rows = compare.against_bank(held.where("sketch_id = 0"), held.where("sketch_id > 0")).collect()
    assert sorted((r.i, r.j, r.n_shared, r.containment) for r in rows) == [(0, 1, 1, 0.5), (0, 2, 2, 1.0)]


def test_matrix_and_lines(spark):
    ids = spark.createDataFrame([(0, "a"), (1, "b")], "sketch_id bigint, name string")
    cells = matrix.dense(spark.createDataFrame([(0, 1, 2 / 3)], "i bigint, j bigint, c double"), ids, "c")
    lines = [r.text for r in matrix.csv_lines(cells, ids).orderBy("line").collect()]
    assert lines == ["a,b", "1,0.666667", "0.666667,1"]
    order = spark.createDataFrame([(0, 1), (1, 0)], "sketch_id bigint, place bigint")
    assert matrix.reorder(cells, order).count() == 4 and matrix.unknown(cells, order.where("place = 0")).collect()[0].sketch_id == 0
    assert matrix.transpose(cells).where("i = 0 and j = 1").first().value == 2 / 3


def test_evaluation(spark):
    kind = "i bigint, j bigint, value double"
    truth = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.25), (2, 1, 1.0), (0, 0, 1.0)], kind)
    guess = spark.createDataFrame([(1, 0, 0.25), (2, 0, 0.25), (2, 1, 0.5), (0, 0, 1.0)], kind)
    tri = evaluate.triangle(truth, guess)
    n = evaluate.norms(tri).first()
    assert n.l1 == 0.75 and abs(n.l2 - (0.0625 + 0.25) ** 0.5) < 1e-12
    h = evaluate.harmonic(tri, 2).first()
    assert h.n == 2 and abs(h.as_written - 2 / 20 / 2) < 1e-12 and abs(h.intended - (2 / 20) ** 0.5) < 1e-12
    assert abs(evaluate.mean_error(truth, guess).first().diff - 0.1875) < 1e-12
    s = evaluate.summary(tri, "truth").first()
    assert s["median"] == 0.5 and s["max"] == 1.0


def test_empty(spark):
    none = records(spark, [])
    assert sketch.build(none, P).count() == 0 and compare.all_pairs(sketch.build(none, P)).count() == 0
    assert superkmers.super_kmers(none, P).count() == 0 and sketch.metrics(none, P).count() == 0
    short = records(spark, [["ACG", "", "A" * 14]])
    assert sketch.build(short, P).count() == 0
    assert sketch.build(records(spark, [["A" * 15]]), SketchParams(15, 5, 1)).count() == 1


def test_hot_kmer_is_counted(spark):
    row = sketch.build(records(spark, [["A" * 15] * 300]), SketchParams(15, 5, 1)).collect()
    assert [r.cnt for r in row] == [300]


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    p = SketchParams(15, 5, 2)
    held = sketch.build(records(spark, [random_seqs(2, 300, 1), random_seqs(2, 300, 2)]), p)
    names = spark.createDataFrame([(0, "a"), (1, "b")], "sketch_id bigint, name string")
    spark.sql("drop table if exists kept_sketches")
    spark.sql("drop table if exists kept_sketches_meta")
    sketch.write_sketches(held, sketch.meta_rows(names, p), "kept_sketches", 4)
    assert sketch.agreed(spark.table("kept_sketches_meta")).k == 15
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    a = spark.table("kept_sketches").alias("a").join(spark.table("kept_sketches").alias("b"), ["minimizer", "kmer"])
    plan = a._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("drop table kept_sketches")
    spark.sql("drop table kept_sketches_meta")
    assert "Exchange hashpartitioning" not in plan


def test_spread_inputs_are_not_shuffled_before_counting(spark, tmp_path, monkeypatch):
    """From many files only long records are dealt out; from one file everything is; both give the same sketch."""
    monkeypatch.setattr(minimizers, "CHUNK", 200)
    monkeypatch.setattr(minimizers.chunks, "__defaults__", (200, *minimizers.chunks.__defaults__[1:]))
    p = SketchParams(15, 5, 1)
    edge = ["A" * 14, "ACGTT" * 3, random_seqs(1, 0)[0], *("".join(random.Random(n).choice("ACGT") for _ in range(n)) for n in (213, 214, 215, 216, 414, 415, 1000, 5000))]
    seqs = [random_seqs(20, 700, 3) + edge, random_seqs(5, 5000, 4)]
    whole = records(spark, seqs)
    whole.repartition(6).write.parquet(str(tmp_path / "many"))
    whole.coalesce(1).write.parquet(str(tmp_path / "one"))
    many, one = (spark.read.parquet(str(tmp_path / name)) for name in ("many", "one"))
    joined = minimizers.dealt(many, p.k)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan(joined) and plan(joined).count("RepartitionByExpression") == 1
    assert "Union" not in plan(minimizers.dealt(one, p.k))
    long_pieces = minimizers.chunks(many, p.k, cut=True)
    assert {r[0] for r in long_pieces.select("rec_id").where("sketch_id = 0 and rec_id >= 20").distinct().collect()} == {20 + n for n, s in enumerate(edge) if len(s) >= 215}
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(joined) == rows(minimizers.dealt(one, p.k))
    assert rows(sketch.build(many, p)) == rows(sketch.build(one, p)) == rows(sketch.build(whole, p))
    for i, s in enumerate(seqs):
        got = {(r.minimizer, r.kmer): r.cnt for r in sketch.build(many, p).where(F.col("sketch_id") == i).collect()}
        assert got == model.sketch(s, p.k, p.m, p.threshold(), p.abundance)


def test_chains_on_arrays_and_over_rows(spark, monkeypatch):
    """Groups chained on arrays, whatever batches cut them, give what doubling over rows gives, and so do groups that are too large for a task."""
    rng = random.Random(4)
    base = "".join(rng.choices("ACGT", k=400))
    seqs = [["".join(c if rng.random() > 0.03 else rng.choice("ACGT") for c in base) for _ in range(6)] + random_seqs(5, 300, s) + ["ACGTACGT" * 9, "A" * 60] for s in range(3)]
    for p in (SketchParams(15, 5, 1), SketchParams(31, 11, 2)):
        held = sketch.build(records(spark, seqs), p)
        want = sorted(map(tuple, superkmers.over_rows(held, p).collect()))
        sizes = [r["count"] for r in held.groupBy("sketch_id", "minimizer").count().collect()]
        for rows, group in ((1 << 18, 1 << 20), (50, 1 << 20), (50, sorted(sizes)[-4])):
            monkeypatch.setattr(superkmers.chains, "ROWS", rows)
            monkeypatch.setattr(superkmers, "GROUP", group)
            rebuilt = superkmers.rebuild(held, p)
            assert sorted(map(tuple, rebuilt.collect())) == want and len(want) > 100
    monkeypatch.setattr(superkmers, "GROUP", 1 << 20)
    # A group moves once.
    plan = superkmers.rebuild(held, p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan


def test_rates_counted_as_bits(spark, monkeypatch):
    """Pairs and sizes at several rates, k-mers as rows of bits: what the sketches give one by one, for ids of several words and gaps, and by rows beyond the places."""
    rng = random.Random(9)
    pool = random_seqs(12, 120, 3)
    rows = [(7 * i - 20, r, "".join(rng.sample(pool, 3))) for i in range(70) for r in range(2)] + [(9999, 0, "ACG")]
    held = spark.createDataFrame(rows, "sketch_id bigint, rec_id bigint, seq string")
    rates = {"some": SketchParams(15, 5, 4), "exact": SketchParams(15, 5, 1), "few": SketchParams(15, 5, 30)}
    want, sizes = {}, {}
    for name, p in rates.items():
        made = sketch.build(held, p)
        want[name] = {(r.i, r.j): r.n_shared for r in compare.shared(made).collect()}
        sizes[name] = {r.sketch_id: r.n for r in compare.cardinality(made).collect()}
    for places in (512, 70):
        monkeypatch.setattr(compare, "PLACES", places)
        pairs, n = (x.collect() for x in sketch.shared_at(held, rates))
        for name in rates:
            assert {(r.i, r.j): r[name] for r in pairs if r[name]} == want[name] and len(want[name]) > 500
            assert {r.sketch_id: r[name] for r in n if r[name]} == sizes[name]
    monkeypatch.setattr(compare, "PLACES", 512)
    assert not sketch.shared_at(held.limit(0), rates)[0].count()


def test_tasks_follow_the_input(spark, tmp_path, monkeypatch):
    """Chunks are dealt, and pairs made, in tasks whose number follows the input and isn't cut down to few bytes; sketches and pairs stay the same."""
    p = SketchParams(15, 5, 1)
    seqs = [random_seqs(4, 300, s) + ["ACGTTGCA" * 20] for s in range(12)]
    whole = records(spark, seqs)
    whole.repartition(6).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    want = sorted(map(tuple, sketch.build(whole, p).collect()))
    pairs = sorted(map(tuple, compare.all_pairs(sketch.build(whole, p)).collect()))
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] + 1
    size = sum(f.stat().st_size for f in (tmp_path / "many").glob("*.parquet"))
    monkeypatch.setattr("helixmill.sources.shared.TASK_BYTES", size // 20)
    assert "Union" not in minimizers.dealt(many, p.k)._jdf.queryExecution().optimizedPlan().toString()
    assert parts(minimizers.dealt(many, p.k)) > 15 and parts(compare.spread(many.select("sketch_id", F.col("rec_id").alias("minimizer"), F.col("rec_id").alias("kmer"), "seq"))) >= 4
    assert sorted(map(tuple, sketch.build(many, p).collect())) == want
    monkeypatch.setattr(compare, "PAIRS", 2)
    held = sketch.build(many, p).localCheckpoint()
    assert sorted(map(tuple, compare.all_pairs(held).collect())) == pairs and len(pairs) == 66
    assert "RepartitionByExpression" in compare.shared(held)._jdf.queryExecution().optimizedPlan().toString()
