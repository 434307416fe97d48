import math
import random

import numpy as np
import pytest

from helixmill.llm import nearest_graph
from helixmill.llm.nearest_graph import Graph, GraphParams

VECTORS = "vec_id bigint, embedding array<double>, label int, shard string, x string, asks string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], VECTORS)


def found(spark, rows, **given):
    return sorted(tuple(r) for r in nearest_graph.nearest(frame(spark, rows), GraphParams(**given)).collect())


def usable(rows):
    width = max([len(v) for _, v in rows if v] or [0])
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    return [(i, v + [0.0] * (width - len(v))) for i, v in good]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))


def brute(rows, k=5):
    """The k nearest of each query as {query_id: [(score, vec_id)]}."""
    rows, out = usable(rows), {}
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        own = min(v for i, v in rows if i == q)
        out[q] = sorted(((-cosine(own, v), i) for i, v in rows if i != q))[:k]
    return out


def recall(got, want):
    names = {}
    for q, _, i, _ in got:
        names.setdefault(q, []).append(i)
    return sum(len(set(names.get(q, [])) & {i for _, i in best}) for q, best in want.items()) / sum(map(len, want.values()))


def normal(n, seed, width=16):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]


def test_against_brute_force(spark):
    rows = normal(1500, 1)
    scores = {i: v for i, v in rows}
    for given in ({}, {"shard": 200, "links": 8, "build_beam": 32, "beam": 40, "step": 64}):
        got = found(spark, rows, **given)
        assert recall(got, brute(rows)) >= 0.95
        assert all(abs(s - cosine(scores[q], scores[i])) < 1e-12 for q, _, i, s in got)
        for q in {r[0] for r in got}:
            own = [r for r in got if r[0] == q]
            assert [r[1] for r in own] == [1, 2, 3, 4, 5] and [(-r[3], r[2]) for r in own] == sorted((-r[3], r[2]) for r in own)


def test_small_tables_are_exact(spark):
    rows = normal(120, 2)
    want = brute(rows)
    got = found(spark, rows)
    assert [(q, i) for q, _, i, _ in got] == [(q, i) for q in sorted(want) for _, i in want[q]]
    assert found(spark, normal(3, 3)) and len(found(spark, normal(3, 3))) == 2
    assert found(spark, []) == [] and found(spark, [(50, [1.0, 2.0])]) == []
    assert nearest_graph.nearest(frame(spark, [])).columns == ["query_id", "rank", "vec_id", "score"]


def test_awkward_rows(spark):
    rows = normal(150, 4, 4) + [(50, [1.0, 0.0, 0.0, 0.0]), (50, [0.5, 0.0, 0.0, 0.0]), (200, None), (None, [1.0] * 4), (250, [0.0] * 4), (300, [1.0, math.nan, 0.0, 0.0]), (350, [math.inf] * 4), (400, [1.0, None, 0.0, 0.0]), (450, []), (500, [2.0])]
    got, want = found(spark, rows), brute(rows)
    assert {r[0] for r in got} == set(want) and 500 in want and not {200, 250, 300, 350, 400, 450} & ({r[0] for r in got} | {r[2] for r in got})
    # Parallel vectors tie up to rounding, so the scores are compared.
    assert [round(r[3], 9) for r in got] == [round(-s, 9) for q in sorted(want) for s, _ in want[q]]


def test_copies_give_their_least_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700)] + [(1000 + i, v) for i, v in normal(300, 5, 3)] + [(2000, [-1.0, 0.5, 0.0])]
    got = found(spark, rows, shard=250)
    for q in range(0, 700, 50):
        assert [r[2] for r in got if r[0] == q] == [i for i in range(6) if i != q][:5]


def test_extreme_sizes(spark):
    rows = [(0, [1e200, 1e200]), (1, [3e-200, 0.0]), (2, [1e180, 1.1e180]), (3, [-5.0, 1.0]), (4, [0.0, 1e-160])]
    got = {r[2]: r[3] for r in found(spark, rows)}
    assert got[1] == pytest.approx(math.sqrt(0.5)) and got[2] == pytest.approx(2.1 / math.sqrt(2 * 2.21)) and got[4] == pytest.approx(math.sqrt(0.5))


def test_graph_keeps_its_form():
    """Links point to other vectors of the layer, none twice, and every vector can be reached from the entry."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(900, 12)), 4 + 0.05 * rng.normal(size=(600, 12))))[rng.permutation(1500)]
    graph = Graph(nearest_graph._unit(x).astype(np.float32), GraphParams())
    for links in graph.layers:
        assert links.max() < len(links)
        for i, row in enumerate(links):
            near = row[row >= 0].tolist()
            assert i not in near and len(near) == len(set(near))
    met, todo = {0}, [0]
    while todo:
        new = {int(j) for j in graph.layers[0][todo.pop()] if j >= 0} - met
        met |= new
        todo += new
    assert len(met) > 0.99 * len(x)


def test_wide_vectors_take_small_steps(spark):
    assert GraphParams().in_step(64) == 256 and GraphParams().in_step(4096) == 8
    rows = normal(260, 9, 40)
    assert recall(found(spark, rows, components=320), brute(rows)) >= 0.95


def test_recall_on_clusters():
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(size=(2000, 48)), 2 + 0.1 * rng.normal(size=(1500, 48))))[rng.permutation(3500)]
    unit = nearest_graph._unit(x).astype(np.float32)
    graph, asked = Graph(unit, GraphParams()), np.arange(0, 3500, 25)
    got = graph.search(unit[asked], 96)
    likeness = unit[asked] @ unit.T
    best = np.argsort(-likeness, axis=1)[:, :6]
    assert np.mean([len(set(b) & set(g)) / 6 for b, g in zip(best, got)]) > 0.95
