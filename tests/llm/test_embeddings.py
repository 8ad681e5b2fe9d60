import math

import numpy as np
import pytest

from mirepoix.llm import embeddings


def brute(rows, least=0.93):
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(np.float32(v), dtype=float) / np.linalg.norm(np.array(np.float32(v), dtype=float)) if good(v, label) else None for _, v, label in rows]
    links, label = [0] * n, list(range(n))
    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least_id = {}
    for i, (key, _, _) in enumerate(rows):
        least_id[label[i]] = min(least_id.get(label[i], key), key)
    return {key: (links[i], least_id[label[i]]) for i, (key, _, _) in enumerate(rows)}


def vectors(n=420, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    bases = rng.normal(size=(25, dim))
    out = []
    for i in range(n):
        base = bases[0] if i % 3 == 0 else bases[rng.integers(25)]
        v = base + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.5])
        out.append((i, [float(np.float32(x)) for x in v], [0, 0, 0, 1, None][rng.integers(5)]))
    out += [(1000 + i, out[3][1], out[3][2]) for i in range(20)]
    odd = [None, [], [0.0] * dim, [None] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    return out + [(2000 + i, v, 0) for i, v in enumerate(odd)]


@pytest.mark.parametrize("shard_rows", [4096, 30])
def test_equals_brute_force(spark, shard_rows):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(5)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, shard_rows=shard_rows, sample_rows=100).collect()}
    want = brute(rows)
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_dual_traversal_with_partners_and_guests():
    rng = np.random.default_rng(0)
    bases = rng.normal(size=(30, 8))
    x = bases[rng.integers(0, 30, 900)] + rng.normal(size=(900, 8)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    role, weight = rng.integers(0, 3, 900), rng.integers(1, 4, 900).astype(float)
    links, label = embeddings.block_links(x, weight, role, 0.93)
    meet = (role[:, None] == 2) & (role[None] == 2) | (role[:, None] > 0) & (role[None] == 0) | (role[:, None] == 0) & (role[None] > 0)
    linked = (x @ x.T >= 0.93) & meet & ~np.eye(900, dtype=bool)
    assert (links == linked @ weight).all()
    forest = embeddings.Forest(900)
    forest.link(*np.nonzero(linked))
    assert (label == forest.label).all()


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).collect() == []
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.1], 1), (None, None, None)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got if r.component_id) == [(0, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert len(got) == 4


def test_very_large_and_small_components_keep_their_links(spark):
    data = [(1, [1e200, 2e200], 0), (2, [1e-200, 2e-200], 0), (3, [1.0, 2.0], 0), (4, [5e-320, 1e-319], 0), (5, [2.0, -1.0], 0)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(rows).collect()) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5)]
