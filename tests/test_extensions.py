import random


from helixmill.functions import tables
from helixmill.functions.params import SketchParams
from helixmill.operators import compare, minimizers, sketch, superkmers
from helixmill.sources.fasta import records_of
from helixmill.streaming.comparison import compare_stream, compared
from helixmill.streaming.folder import read_records
from . import model
from .test_sketch import random_seqs, records

P = SketchParams(15, 5, 3)


def test_kmers_do_not_span_gaps(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ACGTacgtNn -é\U0001f600", weights=[30] * 8 + [1] * 6, k=n)) for n in (900, 15, 14, 300, 0)] + [None, "ACGT" * 30, "N" * 50]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    p = SketchParams(15, 5, 1)
    held = records_of(frame, gaps=True)
    want, counts = set(), {}
    for i, t in enumerate(texts):
        t = (t or "").upper()
        for pos in range(len(t) - 14):
            word = t[pos : pos + 15]
            if set(word) <= set("ACGT"):
                (_, code, _, at), key = model.minimizers(word, 15, 5)[0], model.canonical(word)
                want.add((i, pos, key, code, pos + at))
                counts[i, code, key] = counts.get((i, code, key), 0) + 1
    assert {tuple(r) for r in minimizers.minimizers(held, p).select("sketch_id", "pos", "kmer", "minimizer", "mpos").collect()} == want and len(want) > 300
    assert {(r.sketch_id, r.minimizer, r.kmer): r.cnt for r in sketch.build(held, p).collect()} == counts
    segments = superkmers.super_kmers(held, p, with_seq=True).collect()
    assert sum(r.n_kmers for r in segments) == len(want) and all(r.seq == texts[r.sketch_id][r.start : r.start + r.len].upper() for r in segments)
    # By default such letters go, and k-mers span them.
    assert sketch.build(records_of(frame), p).count() > len(counts)


def test_nearest_sketches(spark):
    rng = random.Random(3)
    pairs = [(i, j, rng.choice((0.25, 0.5, 0.75))) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.6]
    frame = spark.createDataFrame(pairs, "i int, j int, jaccard double")
    want = set()
    for i in range(30):
        own = sorted([(-s, b) for a, b, s in pairs if a == i] + [(-s, a) for a, b, s in pairs if b == i])[:4]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(own)}
    assert {tuple(r) for r in compare.nearest(frame, "jaccard", 4).collect()} == want
    plan = compare.nearest(frame, "jaccard", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange
    assert compare.nearest(frame.limit(0), "jaccard", 4).count() == 0


def test_stream_keeps_up(spark, tmp_path):
    """Sketches arrive in parts, some rows twice, and the stream stops and starts: the pairs are those of one pass."""
    shared = random_seqs(1, 700, 4)[0]
    seqs = [shared[40 * i :] + random_seqs(1, 200, i)[0] for i in range(5)]
    rows = [(i, 0, s[:400]) for i, s in enumerate(seqs)] + [(i, 1, s[386:]) for i, s in enumerate(seqs)]
    frame = spark.createDataFrame(rows, "sketch_id bigint, rec_id bigint, seq string")
    source, target, state = (str(tmp_path / n) for n in ("in", "held", "state"))
    for part in ("rec_id = 0 and sketch_id < 3", "rec_id = 1", "rec_id = 0 and sketch_id >= 2"):
        frame.where(part).coalesce(1).write.mode("append").parquet(source)
        compare_stream(read_records(spark, source), target, state, P).awaitTermination()
        seen = spark.read.schema("sketch_id bigint, rec_id bigint, seq string").parquet(source).distinct()
        want = {tuple(r) for r in compare.all_pairs(sketch.build(seen, P)).collect()}
        assert {tuple(r) for r in compared(frame, target).collect()} == want
    assert len(want) == 10


def test_stream_compares_by_growth(spark, tmp_path):
    """Six batches are compared after the first and the fourth only; a reader adds what came since, and a count that broke off is left out and made again."""
    shared = random_seqs(1, 900, 4)[0]
    seqs = [shared[60 * (i % 4) :][:500] + random_seqs(1, 200, i)[0] for i in range(6)] + [shared[100:400]]
    rows = [(i, 0, s[:400]) for i, s in enumerate(seqs)] + [(i, 1, s[386:]) for i, s in enumerate(seqs)]
    source, target, state = (str(tmp_path / n) for n in ("in", "held", "state"))
    for n in range(6):  # a sketch's records are in several batches, some of them twice
        part = [r for k, r in enumerate(rows) if k % 6 in (n, (n + 5) % 6)]
        spark.createDataFrame(part, "sketch_id bigint, rec_id bigint, seq string").coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema("sketch_id bigint, rec_id bigint, seq string").option("maxFilesPerTrigger", 1).parquet(source)
    compare_stream(arriving, target, state, P).awaitTermination()
    folders = lambda of: sorted(int(f.name.removeprefix("batch=")) for f in (tmp_path / "held" / of).glob("batch=*"))
    assert folders("rows") == list(range(6)) and folders("pairs") == [0, 3]
    want = {tuple(r) for r in compare.all_pairs(sketch.build(spark.createDataFrame(rows, "sketch_id bigint, rec_id bigint, seq string"), P)).collect()}
    assert {tuple(r) for r in compared(arriving, target).collect()} == want and len(want) == 21
    for broken in (3, 0):
        (tmp_path / "held" / "pairs" / f"batch={broken}" / "_SUCCESS").unlink()
        assert {tuple(r) for r in compared(arriving, target).collect()} == want
    assert compared(arriving, str(tmp_path / "none")).count() == 0


def test_table_functions(spark):
    tables.register(spark)
    seqs = random_seqs(4, 300, 12) + ["".join(random.Random(1).choices("ACGT", k=40_000)), "acgtNNacgtacgtacgtacgtacgt", "AC", None]
    spark.createDataFrame([(i % 3, i, s) for i, s in enumerate(seqs)] + [(None, 9, "ACGT" * 9)], "sketch_id bigint, rec_id bigint, seq string").createOrReplaceTempView("sequences")
    clean = ["".join(c for c in (s or "").upper() if c in "ACGT") for s in seqs]
    got = spark.sql("SELECT * FROM sequence_kmers(TABLE(sequences), 15)").collect()
    assert sorted((r.sketch_id, r.rec_id, r.pos, r.kmer) for r in got) == sorted((i % 3, i, at, model.canonical(s[at : at + 15])) for i, s in enumerate(clean) for at in range(len(s) - 14))
    for deal in ("", "PARTITION BY (rec_id)", "PARTITION BY (sketch_id) ORDER BY (rec_id)"):
        rows = spark.sql(f"SELECT sketch_id, minimizer, kmer, count(*) AS cnt FROM selected_kmers(TABLE(SELECT * FROM sequences) {deal}, 15, 5, 3D) GROUP BY ALL").collect()
        by_sketch = [[s for i, s in enumerate(clean) if i % 3 == k] for k in range(3)]
        assert {(r.sketch_id, r.minimizer, r.kmer): r.cnt for r in rows} == {(k, *key): n for k, s in enumerate(by_sketch) for key, n in model.sketch(s, 15, 5, P.threshold()).items()}


def test_decycling_order(spark):
    p, seqs = SketchParams(15, 5, 2, order="decycling"), random_seqs(3, 400, 30)
    rows = minimizers.minimizers(records(spark, [seqs]), p).collect()
    import numpy as np

    from helixmill.functions import hashing

    order = lambda code: int(hashing.by_class(np.array([model.hashed(code)], np.uint64), hashing.decycling_class(np.array([code], np.uint64), 5))[0])
    for r in rows:
        word = seqs[r.rec_id][r.pos : r.pos + 15]
        codes = [model.canonical(word[i : i + 5]) for i in range(11)]
        best = min(range(11), key=lambda i: (order(codes[i]), i))
        assert (r.minimizer, r.mpos - r.pos, r.ho) == (codes[best], best, order(codes[best]) - 2**63)
