import random
from itertools import accumulate

from pyspark.sql import functions as F

from mirepoix.operators import scans


def test_running_values_of_a_key_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(1 if i % 3 else rng.randrange(50), rng.choice([None, *range(400)]), rng.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o int, v long, i long").repartition(5)
    got = scans.running(df, ["k"], ["o", "i"], {"nth": ("sum", F.lit(1)), "total": ("sum", F.col("v")), "top": ("max", F.col("v")), "mix": ("xor", F.col("v"))}).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["k", "o", "v", "i", "nth", "total", "top", "mix"]
    for k in {r[0] for r in rows}:
        of = sorted((r for r in got if r.k == k), key=lambda r: (r.o is not None, r.o or 0, r.i))
        v = [r.v for r in of]
        assert [r.nth for r in of] == list(range(1, len(of) + 1))
        assert [r.total for r in of] == list(accumulate(v))
        assert [r.top for r in of] == list(accumulate(v, max))
        assert [r.mix for r in of] == list(accumulate(v, lambda a, b: a ^ b))


def test_running_without_keys_and_with_equal_or_no_rows(spark):
    df = spark.range(1000).select(F.lit(7).alias("o"))
    got = scans.running(df, [], ["o"], {"nth": ("sum", F.lit(1))}).collect()
    assert sorted(r.nth for r in got) == list(range(1, 1001))
    assert scans.running(df.limit(0), [], ["o"], {"nth": ("sum", F.lit(1))}).collect() == []


def test_parts_grow_with_the_table(spark, tmp_path):
    from mirepoix.plans.tables import parts

    spark.range(1000).write.parquet(f"{tmp_path}/lineitem.parquet")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts(spark, str(tmp_path), "lineitem") == least and parts(spark, str(tmp_path), "lineitem", 10) == 100


def test_dealt_rows_stay_in_their_parts(spark):
    from mirepoix.operators import composite, graph, report

    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (3, 2), (None, 1), (None, 2)], "item int, food int")
    found = graph.collisions(edges, "item", "food", spark.createDataFrame([(1, 2)], "old int, new int"), "old", "new", parts=13)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 2, "1,3")]
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 6)], "g string, v double")
    assert report._counted(rows, ["g"], "v", 13).rdd.getNumPartitions() == 13
    cells = spark.createDataFrame([("s", "1", "egg", "g", "c", "2", "g", 0)], "source string, code string, food_name string, food_group string, column string, value string, unit string, position long")
    mapping, none = spark.createDataFrame([("s", "c", "Protein", None, 1)], "source string, column string, key string, unit string, nth int"), spark.createDataFrame([], "source string, food_group string")
    assert composite.composite(cells, mapping, none, parts=13).rdd.getNumPartitions() == 13
