import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mirepoix.llm import toxicity


def rows(n=600, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(["alba", "coro", "der", "mint", "sole", "été"]) + rng.choice(["a", "na", "x"]) for _ in range(rng.randint(5, 60))]
        toxic = i % 9 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Grubber", "grubbing", "snidé"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy_and_columns(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in data], "doc_id long, text string, source string, score double").repartition(6)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}
    assert len(got) == len(data)
    for i, _, y in data:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    wrong = sum(got[i].predicted != y for i, _, y in data if got[i].held_out)
    assert wrong <= 3
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1, y ^ got[i].held_out) for i, _, y in data], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.judged(docs, flipped).collect()}
    assert all(again[i] == pytest.approx(got[i].score, abs=1e-9) for i in got)


def test_bounded_sample_keeps_calibration(spark):
    data = rows(1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(docs, labels, rows_per_label=60).collect()}
    assert sum(got[i].predicted != y for i, _, y in data) <= 30


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (2, "grubber " * 40000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.held_out is not None for r in got)
    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None), (7, 1), (7, 0), (8, 1)], "doc_id long, toxic int")
    assert toxicity.judged(docs, labels).count() == 4
    assert toxicity.judged(docs.limit(0), labels).collect() == []


def test_n_grams_are_of_code_points_with_digits_and_marks():
    texts = ["Ab1 $x", None, "ЖÉ\t漢z", ""]
    points, offsets = toxicity.code_points(pa.array(texts))
    assert "".join(map(chr, points)) == "ab1 $xжé 漢z" and list(offsets) == [0, 6, 6, 11, 11]
    keys = dict(zip((1, 3), toxicity.ngram_keys(points, (1, 3))))
    assert len(keys[1]) == 11 and len(keys[3]) == 9 and len(set(keys[1]) | set(keys[3])) == 19
    again = list(toxicity.ngram_keys(points[6:], (3,)))[0]
    assert (again == keys[3][6:]).all() and [len(k) for k in toxicity.ngram_keys(points[:2], (2, 4))] == [1, 0]


def test_ratios_weights_and_scores_equal_plain_ones(spark):
    data = rows(300, seed=9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(0, "zzz later text")] * 3, "doc_id long, text string").repartition(5)
    model = toxicity.trained(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"), steps=3000)
    held = {i: {t.lower()[a : a + n] for n in (4, 5, 6) for a in range(len(t) - n + 1)} for i, t, _ in data}
    labels = np.array([y for _, _, y in data])
    p, q = (Counter(g for i, _, y in data if y == label for g in held[i]) for label in (1, 0))
    m1, m0 = labels.sum(), len(labels) - labels.sum()
    h = lambda *counts: sum(c * math.log(c) for c in counts if c)
    told = lambda g: 2 * (h(p[g], q[g], m1 - p[g], m0 - q[g]) - h(p[g] + q[g], m0 + m1 - p[g] - q[g]) - h(m1, m0) + h(m0 + m1))
    best = [g for g in p | q if told(g) >= 12]
    key = {g: int(next(toxicity.ngram_keys(np.array(list(map(ord, g)), np.uint32), (len(g),)))[0]) for g in best}
    assert sorted(key.values()) == [int(k) for k in model.keys]
    total = [sum(c[g] for g in best) + len(best) for c in (p, q)]
    ratio = {key[g]: math.log((p[g] + 1) / total[0]) - math.log((q[g] + 1) / total[1]) for g in best}
    x = np.array([[ratio[int(k)] if k in {key[g] for g in best if g in held[i]} else 0.0 for k in model.keys] for i, _, _ in data])
    w = model.weights / np.array([ratio[int(k)] for k in model.keys])
    z = x @ w + model.intercept
    error = (1 / (1 + np.exp(-z)) - labels) / len(labels)
    # the weights are where the regularised likelihood is flat
    assert np.abs(x.T @ error + w / len(w) / 1.0 * 1.0).max() < 2e-3 and abs(error.sum()) < 2e-3
    got = {r.doc_id: r.score for r in toxicity.scored(docs.dropDuplicates(["doc_id"]).where("doc_id > 0"), model).collect()}
    assert all(got[i] == pytest.approx(1 / (1 + math.exp(-z[k])), abs=1e-9) for k, (i, _, _) in enumerate(data) if i)


def test_long_texts_and_slices(spark):
    data = rows(200, seed=5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900 + k, "alba corox " * 300_000 + "grubber " * (5 * k)) for k in (0, 1)], "doc_id long, text string").coalesce(2)
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert got[901] > got[900] and len(got) == 202
