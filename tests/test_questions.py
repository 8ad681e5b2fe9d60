import random

from pyspark.sql import functions as F

from mirepoix.functions import rules, scoring
from mirepoix.operators import search


def _each(spark, function, cases):
    return [r.v for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def test_words_that_rank(spark):
    want = {"Comfort food for a cold evening": "comfort cold", "What is it?": "What is it?", "I want gluten-free cook's pie": "gluten-free cook's pie", "": "", None: None}
    assert _each(spark, rules.rank_words, list(want)) == list(want.values())


def test_forms_of_a_name(spark):
    want = {"Garlic, raw": ["garlic, raw", "garlic raw", "garlic"], "low-fat Yoghurts": ["low-fat yoghurts", "yoghurts", "low-fat yogurt", "yogurt"], " ": [], "rocket": ["rocket", "arugula"], None: []}
    assert _each(spark, rules.name_variants, list(want)) == list(want.values())


def test_grades_of_labels(spark):
    rows = [(100.0, None, 10.0, 1.0, 0.5, 20.0, 0.0, 0.0), (50.0, 1675.0, 1.0, 22.5, 5.0, 450.0, 0.0, 8.0), (0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (10.0, None, None, 1.0, 1.0, 1.0, 1.0, 1.0), (10.0, 1.0, 1.0, 1.0, None, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g double, kj double, kcal double, sugar double, sat double, sodium double, fibre double, protein double")
    got = frame.select("i", scoring.label(*(F.col(c) for c in frame.columns[1:])).alias("grade")).orderBy("i").collect()
    assert [r.grade for r in got] == ["A", "E", None, None, None, None]


def test_slots_of_a_plan_share_their_families(spark):
    rng, names = random.Random(3), ["pie", "soup", "salad", "stew", "", None]
    slots = [(f"s{i}", [(100 * i + j, rng.choice(names[: 3 + i]), rng.random()) for j in range(size)]) for i, size in enumerate((9, 20, 4, 0, 30))]
    for n, per_family in ((3, 1), (5, 2)):
        seen, want = {}, set()
        for name, rows in slots:
            picked, skipped = [], []
            for row in sorted(rows, key=lambda r: r[2]):
                if len(picked) < n:
                    full = row[1] and seen.get(row[1], 0) >= per_family
                    (skipped if full else picked).append(row)
                    if row[1] and not full:
                        seen[row[1]] = seen.get(row[1], 0) + 1
            for row in skipped[: n - len(picked)]:
                picked.append(row)
                seen[row[1]] = seen.get(row[1], 0) + 1
            want |= {(name, r[0]) for r in picked}
        frames = [(name, spark.createDataFrame(rows, "id int, family string, rank double")) for name, rows in slots]
        assert {(r.slot, r.id) for r in search.diverse_slots(frames, "family", [F.col("rank")], n, per_family).collect()} == want
