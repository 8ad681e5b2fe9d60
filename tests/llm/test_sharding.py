import zlib
from collections import Counter

import numpy as np

from mirepoix.llm import sharding


def test_matrix_has_exact_sums_and_the_law_of_a_uniform_shuffle():
    draws = [sharding.communication_matrix([6, 4], [5, 3, 2], seed) for seed in range(4000)]
    assert all((m.sum(axis=1) == [6, 4]).all() and (m.sum(axis=0) == [5, 3, 2]).all() for m in draws)
    assert np.allclose(np.mean(draws, axis=0), np.outer([6, 4], [5, 3, 2]) / 10, atol=0.05)
    # P(source 1 gets all of shard 1) = C(5, 4) / C(10, 4)
    assert abs(np.mean([m[1, 0] == 4 for m in draws]) - 5 / 210) < 0.01
    big = sharding.communication_matrix([3 * 10**9, 10**9], [10**9] * 4, 1)
    assert (big.sum(axis=0) == 10**9).all() and (big.sum(axis=1) == [3 * 10**9, 10**9]).all()


def test_large_populations_have_the_law_too():
    rng = np.random.default_rng(3)
    good, bad, n = 10**9, 2 * 10**9, 2 * 10**9
    draws = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(600)], dtype=float)
    p = good / (good + bad)
    variance = n * p * (1 - p) * (good + bad - n) / (good + bad - 1)  # a binomial's is three times as large
    assert abs(draws.mean() - n * p) < 5 * (variance / 600) ** 0.5 and 0.8 < draws.var() / variance < 1.25
    small = np.array([sharding.hypergeometric(rng, 7, 5, 6) for _ in range(20_000)])
    by_numpy = rng.hypergeometric(7, 5, 6, 20_000)
    assert np.abs(np.bincount(small, minlength=8) - np.bincount(by_numpy, minlength=8)).max() < 500
    assert [sharding.hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (4, 4, 8), (4, 4, 0))] == [0, 3, 4, 0]


def test_shards_are_even_gapless_and_uniform(spark):
    n = 5003
    docs = spark.createDataFrame([(i, f"t{i % 700}" if i % 11 else None, "law") for i in range(n)], "doc_id long, text string, source string").repartition(9)
    rows = sharding.shuffled_digests(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        text = f"t{r.doc_id % 700}" if r.doc_id % 11 else ""
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text.encode()), "rows", None)
    # neither shard nor slot tells of the doc_id
    assert abs(np.corrcoef([r.doc_id for r in rows], [r.slot for r in rows])[0, 1]) < 0.05
    halves = Counter((r.doc_id < n // 2, r.shard) for r in rows)
    assert all(abs(c - n / 16) < 5 * (n / 16) ** 0.5 for c in halves.values())


def test_many_sources_few_rows_and_clashes(spark):
    rows = spark.createDataFrame([(None, "a")] * 40 + [(1, None)] * 3, "doc_id long, text string")
    got = sharding.shuffled(rows, 4, rows_per_source=5).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 4, i // 4) for i in range(43))
    clashing = spark.createDataFrame([(i, -7, -7, -7, -7) for i in range(20)], "place long, source__ int, row int, second int, `slot.x` int")
    assert {tuple(r)[1:5] for r in sharding.shuffled(clashing, 4, rows_per_source=5).collect()} == {(-7, -7, -7, -7)}
    assert sharding.shuffled(rows.limit(0), 4).collect() == []
    assert len(sharding.shuffled(rows.limit(2), 8).collect()) == 2
