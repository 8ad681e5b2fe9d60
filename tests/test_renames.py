import random

from mirepoix.operators import documents, renames


def test_chains_cycles_and_collisions(spark):
    rng = random.Random(2)
    step = {f"c{i}": f"c{i + 1}" for i in range(300)} | {"x": "y", "y": "z", "z": "x", "w": "x", "a": "b"} | {f"r{i}": f"r{rng.randrange(400)}" for i in range(200)}
    rows = [*step.items(), ("a", "d"), ("s", "s"), (None, "n"), ("n", None)]
    step.pop("s", None)
    step = {k: v for k, v in step.items() if k != v}
    got = {r.old: (r.final, r.status) for r in renames.resolved(spark.createDataFrame(rows, "old string, new string")).collect()}
    want = {}
    for k in step:
        at, seen = k, set()
        while at in step and at not in seen:
            seen.add(at)
            at = step[at]
        want[k] = (None, "cycle") if at in step else (at, "final")
    assert got == want and ("c300", "final") in got.values()
    plan = renames.resolved(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "old string, new string"))
    edges = spark.createDataFrame([(1, "a"), (1, "c"), (1, "a"), (2, "b"), (3, "x"), (3, "y"), (4, None)], "item int, name string")
    assert {tuple(r) for r in renames.collisions(edges, plan, "item", "name").collect()} == {(1, "c", 2)}
    assert {(r.item, r.name) for r in renames.applied(edges, plan, "item", "name").collect()} == {(1, "c"), (2, "c"), (3, "x"), (3, "y"), (4, None)}
    assert renames.resolved(spark.createDataFrame([], "old string, new string")).collect() == []


def test_a_changed_value_changes_the_checksum_and_the_order_does_not(spark):
    rows = [(i, f"name {i % 7}", None if i % 5 else 1) for i in range(500)]
    total = lambda data: tuple(documents.content_checksum(spark.createDataFrame(data, "k int, name string, v int").repartition(3), ["k", "name", "v"]).first())
    first = total(rows)
    assert first[0] == 500 and total(rows[::-1]) == first
    for changed in ([*rows[:-1], (499, "name 3", 1)], [*rows[:-1], (499, "name 2", 0)], rows[:-1], rows + rows[:1], [*rows[:-2], rows[0], rows[-1]]):
        assert total(changed) != first
    assert total([(1, "a", None)]) != total([(1, "a\x1f", None)]) and total([(1, None, 1)]) != total([(1, "", 1)])
