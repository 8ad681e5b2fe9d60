import numpy as np
import pytest

from mirepoix.operators import neighbours


def brute(queries, vectors, k):
    out = {}
    ids = [i for i, v in vectors if v is not None and np.all(np.isfinite(np.array(v, float))) and np.any(v) and len(v) == 8]
    rows = np.array([dict(vectors)[i] for i in ids], float)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    for q, v in queries:
        if v is not None and np.any(v):
            s = rows @ (np.array(v) / np.linalg.norm(v))
            out[q] = sorted(zip(-np.round(s, 9), ids))[:k]
    return out


@pytest.mark.parametrize("k,block", [(1, 4096), (7, 16), (400, 50)])
def test_nearest_of_many_queries_are_exact(spark, k, block):
    rng = np.random.default_rng(k)
    hubs = rng.normal(size=(6, 8))
    vectors = [(i, (hubs[i % 6] + rng.normal(scale=0.3, size=8)).tolist()) for i in range(500)] + [(1000 + i, hubs[0].tolist()) for i in range(20)]
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0]), (904, [float("inf")] * 8)]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(40)] + [(50, hubs[0].tolist()), (51, None), (52, [0.0] * 8)]
    left = spark.createDataFrame([(q, v, "x") for q, v in queries], "q long, embedding array<double>, cell string").repartition(3)
    right = spark.createDataFrame([(i, v, 1) for i, v in vectors + bad], "vec_id long, embedding array<double>, part int").repartition(3)
    rows = neighbours.nearest(left, right, k, query_id="q", block=block).collect()
    want = brute(queries, vectors, k)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.nth)):
        got.setdefault(r.query_id, []).append((r.similarity, r.vec_id))
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert len(found) == len(want[q]) == min(k, 520)
        assert [i for _, i in found] == [i for _, i in want[q]] or np.allclose([s for s, _ in found], [-s for s, _ in want[q]], atol=1e-8)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(one, none, 3, query_id="vec_id").collect() == []
    assert neighbours.nearest(none, one, 3, query_id="vec_id").collect() == []
    assert [tuple(r) for r in neighbours.nearest(one, one, 3, query_id="vec_id").collect()] == [(1, 1, 1.0, 1)]


def test_routes_leave_in_blocks():
    rows, at_row, cell = np.eye(3), np.repeat([0, 1, 2], 10), np.tile(np.arange(10), 3)
    parts = list(neighbours._in_blocks(np.array([7, 8, 9]), rows, at_row, cell, 4))
    assert max(map(len, parts)) == 4
    got = [(q, int(np.argmax(v)), c) for p in parts for q, v, c in zip(p["query_id"], p["v"], p["cell"])]
    assert got == [(7 + i, i, c) for i in range(3) for c in range(10)]
