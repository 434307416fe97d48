"""Small tables with every awkward case."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, size=2000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def prose(n, seed):
    return " ".join(words(n, seed))


def awkward():
    """Null ids, null and empty texts, repeated rows, shared ids, long and odd texts."""
    long = prose(12_000, 1)
    base = prose(300, 2)
    near = base.split()
    near[150] = "changed"
    rows = [
        (0, base), (1, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (None, base), (None, None), (6, long),
        (7, "short"), (8, "é ü 漢字 \U0001f600 text"), (9, prose(60, 3) + " " + base), (10, "a"), (9, "other text of the same id"), (11, "no break \x85 here"),
    ]
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]


def docs(spark, rows=None, clashing=False):
    rows = awkward() if rows is None else rows
    frame = spark.createDataFrame([r if len(r) == 5 else (*r, "en", "src0", None if r[1] is None else len(r[1])) for r in rows], DOCS)
    if clashing:
        for name in ("th", "node", "d", "sig", "shard", "slot", "rid", "r", "h", "code", "anchor", "content", "spans", "kept", "bin", "bucket", "text_", "score", "guest", "size", "_d", "_th", "_codes", "codes", "_word", "_bits", "block", "key", "times"):
            from pyspark.sql import functions as F

            frame = frame.withColumn(name, F.lit(f"x-{name}"))
    return frame


def rows_of(frame, *columns):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)
