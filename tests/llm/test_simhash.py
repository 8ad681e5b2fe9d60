import random

import numpy as np
import xxhash

from mirepoix.llm import simhash
from mirepoix.llm.components import connected_components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=3):
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, f in zip(ids, fps):
        for y, g in zip(ids, fps):
            if x < y and bin(f ^ g).count("1") <= radius:
                a, b = sorted((top(x), top(y)))
                label[b] = a
    return {i: top(i) for i in ids}


def test_fingerprint_and_components_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "  \n", "One", "two Words", "É Ü x", "a b c " * 3000]
    for _ in range(60):
        words = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(3, 300))]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = "Z"
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, component_id string, fp long")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([i for i, _ in rows], fps)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert {i: r.component_id for i, r in got.items()} == want


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "q r s t u v w")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (9, 9)]


def _components(pairs, n):
    label = np.arange(n)
    for _ in range(n):
        for a, b in pairs:
            label[[a, b]] = min(label[a], label[b])
    return label


def test_links_join_what_brute_force_joins_with_split_shards(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = set()
    for b in base:
        for _ in range(12):
            values.add(int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)))
    dense = int(base[0])  # a group far larger than a shard
    values |= {dense ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = simhash.hamming_links(fps, 3, shard_rows=40).distinct().collect()
    at = {v: i for i, v in enumerate(values)}
    u = lambda x: at[x % (1 << 64)]
    got = simhash.Forest(len(values))
    got.link(np.array([u(e.a) for e in edges]), np.array([u(e.b) for e in edges]))
    v = np.array(values, dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3)
    want = simhash.Forest(len(values))
    want.link(i, j)
    assert (got.label == want.label).all()
    assert len(edges) < 40 * len(values)


def test_connected_components_on_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (7, 6)]
    edges = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_similar_documents_find_what_brute_force_finds(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "tu", "re", "so"]) for _ in range(rng.randint(1, 4)))
    texts, base = [], []
    for b in range(120):
        words = [word() for _ in range(rng.randint(60, 500))]
        texts.append(" ".join(words))
        base.append(b)
        copy = list(words)
        for at in range(rng.randint(0, 40), len(words), rng.choice([45, 60, 90, 400])):
            copy[at] = word()
        texts.append(" ".join(copy))
        base.append(b)
    sets = [shingles(t) for t in texts]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, search string, node long").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert len(got) == len(texts) and all(base[c] == base[i] for i, c in got.items())
    similar = [i for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    found = sum(got[i] == got[i + 1] for i in similar)
    assert len(similar) > 60 and found >= 0.9 * len(similar)
    far = [i for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) < 0.8 * len(sets[i] | sets[i + 1])]
    assert len(far) > 10
    assert all(got[i] != got[i + 1] for i in far)


def test_similar_documents_odd_rows(spark):
    data = [(3, "A b c d e f"), (3, "a b\tc d e f"), (None, "a b c d e F"), (9, None), (8, " "), (10, "one"), (11, "one"), (12, "two words")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.similar_documents(docs).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (8, 8), (9, 8), (10, 10), (11, 10), (12, 12)]
    assert simhash.similar_documents(docs.limit(0)).collect() == []


def test_proposed_pairs_are_confirmed_exactly(spark):
    rng = random.Random(3)
    texts = ["", "one", "one two", "One\ttwo", *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(60))]
    sets = [shingles(t) if t.split() else set() for t in texts]
    nodes = spark.createDataFrame([(i, simhash.shingle_set(t.encode(), 5).tobytes()) for i, t in enumerate(texts)], "node long, shingles binary")
    assert [len(simhash.shingle_set(t.encode(), 5)) for t in texts] == [len(s) for s in sets]
    edges = spark.createDataFrame([(i, j) for j in range(len(texts)) for i in range(j)], "a long, b long")
    for least in (0.2, 0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in simhash.confirmed(edges, nodes, least).collect()}
        assert got == {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


def test_a_forest_keeps_links_that_span_it():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 200, (2, 300))
    forest, again, plain = simhash.Forest(200), simhash.Forest(200), np.arange(200)
    used = np.concatenate([forest.link(a[:150], b[:150]), 150 + forest.link(a[150:], b[150:])])
    again.link(a[used], b[used])
    for _ in range(200):
        for i, j in zip(a, b):
            plain[[i, j]] = min(plain[i], plain[j])
    assert (forest.label == plain).all() and (again.label == plain).all()
    assert len(used) == 200 - len(set(plain.tolist()))
