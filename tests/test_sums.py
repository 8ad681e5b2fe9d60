"""Sums of doubles that don't depend on how rows are dealt out."""

import random

from pyspark.sql import functions as F

from mirepoix.operators.adapt import reprofiled
from mirepoix.operators.rollup import weighted_totals
from mirepoix.plans.tables import exact_sum, lines, rounded, table


def test_totals_add_up_in_the_order_given(spark):
    rng = random.Random(2)
    rows = [(item, at, rng.randrange(1, 500) * 1.0, rng.choice([None, 0.1, 0.7, 3.3, 1e9])) for item in [1, 2, None] for at in range(40)]
    want = {}
    for item, _, w, m in rows:
        total = want.setdefault(item, [0.0, 0.0])
        total[0] += w
        total[1] += w / 100 * (m or 0.0)
    for seed in range(3):
        dealt = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "item long, at int, w double, m double").repartition(5 + seed)
        assert {r.item: [r.total_weight_g, r.m] for r in weighted_totals(dealt, "item", "w", ["m"], "at").collect()} == want
        served = reprofiled(dealt, "item", "w", ["m"], spark.createDataFrame([(1, 3)], "item long, serves int"), "at").collect()
        assert {r.item: [r.total_weight_g, r.m] for r in served} == want


def test_places_are_those_of_the_file(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [r.item_id for r in lines(spark, sf_dir, placed=True).repartition(7).orderBy("place").collect()]
    assert rows == table(spark, sf_dir, "lineitem").toPandas().l_orderkey.tolist()


def test_rounding_and_exact_sums(spark):
    assert spark.range(1).select(rounded(F.lit(1.005), 2), rounded(F.lit(-2.5), 0), rounded(F.lit(None).cast("double"), 1)).first()[:] == (1.0, -3.0, None)
    values = [0.1] * 10 + [1e9, 250905.35]
    for seed in range(3):
        rows = spark.createDataFrame([(v,) for v in random.Random(seed).sample(values, len(values))], "v double").repartition(4)
        assert rows.agg(exact_sum(F.col("v"))).first()[0] == 1000250906.35
