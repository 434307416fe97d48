import random
from math import floor, inf, nan

import numpy as np

from helixmill.llm import hard_negatives
from helixmill.llm.hard_negatives import Lists, NegativeParams

VECTORS = "vec_id bigint, embedding array<double>, label int, score string, x string, block string"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)


def brute(rows):
    width = max([len(v) for _, v, _ in rows if v] or [0])
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or c != c or abs(c) == inf for c in v):
            continue
        z = [floor(256 * c) if abs(c) < 1e300 else int(c) * 256 for c in v] + [0] * (width - len(v))
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, v, z))
    out = []
    for anchor in sorted({r[0] for r in kept if r[0] % 100 == 0}):
        _, label, _, q = min((r for r in kept if r[0] == anchor), key=lambda r: (r[1], r[2]))
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, z)))), i, same == label) for i, same, _, z in kept if i != anchor)
        for s, positive, _ in [r for r in scored if r[2]][:5]:
            fitting = [r for r in scored if not r[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(anchor, positive, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fitting, 1)]
    return sorted(out)


def mined(spark, rows, **given):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows), NegativeParams(**given)).select(*COLUMNS).collect())


def clustered(n, seed, width=8, labels=4):
    rng = random.Random(seed)
    centre = [rng.gauss(0, 1) for _ in range(width)]
    rows = []
    for i in range(n):
        base = centre if i % 3 == 0 else [0.0] * width
        rows.append((i, [b + rng.gauss(0, 0.2) for b in base], rng.randrange(labels)))
    return rows


def test_against_brute_force(spark):
    rows = clustered(900, 1)
    want = brute(rows)
    assert len(want) > 60 and mined(spark, rows) == want
    assert mined(spark, rows, block=100, group=2, step=1) == want


def test_awkward_rows(spark):
    rows = clustered(320, 2) + [(100, [1.0] * 8, 2), (100, [0.5] * 8, 2), (200, None, 1), (None, [1.0] * 8, 1), (700, [1.0] * 8, None), (300, [1.0, nan], 1), (400, [inf] * 8, 1), (500, [1.0, None], 1)]
    rows += [(600, [], 1), (800, [0.0] * 8, 3), (900, [1.0, 1.0], 3), (1000, [2.0] * 9, 0)] + [(2000 + k // 2, [1.0] * 8, k % 4) for k in range(40)]
    want = brute(rows)
    assert want and mined(spark, rows) == want and mined(spark, rows, block=40, group=3) == want


def test_ties_and_negative_scores(spark):
    rows = [(100 * k, [1.0, 0.0], k % 2) for k in range(4)] + [(1 + k, [1.0, float(k % 2)], k % 3) for k in range(60)] + [(5000, [-1.0, 0.0], 1)]
    assert mined(spark, rows) == brute(rows)
    opposite = [(100, [1.0], 1), (101, [-1.0], 1), (102, [-0.9], 2), (103, [0.0], 2)]
    assert mined(spark, opposite) == brute(opposite) == []


def test_huge_components(spark):
    rows = [(100, [1e200, 1.0], 1), (101, [1e200, 0.5], 1), (102, [9e199, 0.5], 2), (103, [1e10, 2.0], 2), (200, [3.5, 1.0], 1), (201, [3.0, 1.0], 1), (203, [2.9, 1.0], 2)]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == []
    assert hard_negatives.hard_negatives(frame(spark, [])).columns == list(COLUMNS)


def test_stops_early():
    """An anchor inside a tight group reads little of the lists; results are those of a full scan."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate((rng.normal(0, 0.1, (4000, 6)), 1 + rng.normal(0, 0.05, (200, 6)))))
    lists, allowed = Lists(x), np.ones(len(x), bool)
    allowed[4000] = False
    q = x[4000]
    score = x @ q
    ranked = [p for p in np.lexsort((np.arange(len(x)), -score)) if allowed[p]]
    best = lambda window: [p for p, _ in sorted(lists.search(q, [window], 5, 8, allowed)[0], key=lambda r: (-r[1], r[0]))[:5]]
    assert best((None, None)) == ranked[:5]
    assert lists.scored[0] < 400 and lists.read[0] < 200
    top = int(score[ranked[0]])
    assert best((-(-80 * top // 100), top)) == ranked[:5] and lists.read[1] < 400
