import random

from mirepoix.operators import adapt, graph


def test_first_siblings_and_the_pairs_of_groups(spark):
    rng = random.Random(8)
    parent = {f"n{i:03}": f"a{rng.randrange(40)}" for i in range(90)} | {f"a{i}": f"b{i % 6}" for i in range(40)}
    closed = graph.closure(spark.createDataFrame([*parent.items()], "c string, p string"), "c", "p", 2)
    nodes = [n for n in parent if n.startswith("n")]
    frame = spark.createDataFrame([(n,) for n in [*nodes, nodes[0], "alone"]], "node string")
    want = {}
    for n in nodes:
        for distance, up in ((1, lambda x: parent[x]), (2, lambda x: parent[parent[x]])):
            others = {m for m in nodes if m != n and up(m) == up(n)}
            if others:
                want[n] = (others, distance)
                break
    assert {(r.node, r.sibling, r.distance) for r in graph.nearest_siblings(frame, "node", closed, 2).collect()} == {(n, o, d) for n, (others, d) in want.items() for o in others}
    assert {r.node: (r.sibling, r.distance) for r in graph.first_sibling(frame, "node", closed, 2).collect()} == {n: (min(o), d) for n, (o, d) in want.items()}


def test_the_first_source_with_a_candidate_counts(spark):
    curated = spark.createDataFrame([("milk", "oat drink", 2), ("milk", "soy drink", 1), ("egg", "egg", 0), ("ham", None, 0), (None, "tofu", 0)], "food string, substitute string, rank int")
    near = spark.createDataFrame([("milk", "cream"), ("egg", "quail egg"), ("egg", "duck egg")], "food string, substitute string")
    got = adapt.first_substitutes([("curated", curated), ("taxonomy", near)], "food").collect()
    assert {tuple(r) for r in got} == {("milk", "soy drink", "curated"), ("egg", "duck egg", "taxonomy")}


def test_adapted_items_are_profiled_again(spark):
    lines = spark.createDataFrame(
        [(1, "milk", 200.0, 60.0, 3.0, "a"), (1, "flour", 100.0, 340.0, 1.0, "b"), (1, "milk", 50.0, 60.0, 3.0, "c"), (2, "milk", 100.0, None, 3.0, "d"), (3, "air", 0.0, 1.0, 1.0, "e"), (4, None, 10.0, 10.0, 1.0, "f")],
        "item int, food string, w double, kcal double, fat double, more string",
    )
    swaps = spark.createDataFrame([(1, "milk", "oat drink"), (9, "milk", "oat drink"), (2, "flour", "oat drink"), (3, "air", "unknown")], "item int, food string, substitute string")
    foods = spark.createDataFrame([("oat drink", 40.0, None)], "substitute string, kcal double, fat double")
    new = adapt.substituted(lines, swaps, foods, "item", "food", "w", ["kcal", "fat"])
    assert new.columns == [*lines.columns, "replaces"]
    assert {tuple(r) for r in new.collect()} == {
        (1, "oat drink", 200.0, 40.0, 0.0, "a", "milk"), (1, "flour", 100.0, 340.0, 1.0, "b", None), (1, "oat drink", 50.0, 40.0, 0.0, "c", "milk"),
        (2, "milk", 100.0, None, 3.0, "d", None), (3, "unknown", 0.0, 0.0, 0.0, "e", "air"), (4, None, 10.0, 10.0, 1.0, "f", None),
    }
    serves = spark.createDataFrame([(1, 4), (2, 0), (4, None)], "item int, serves int")
    got = {r["item"]: r for r in adapt.reprofiled(new, "item", "w", ["kcal", "fat"], serves).collect()}
    assert (got[1].total_weight_g, got[1].serves, got[1].kcal, got[1].fat, got[1].kcal_per_serving, got[1].fat_per_100g) == (350.0, 4.0, 440.0, 1.0, 110.0, 1.0 / 350 * 100)
    assert (got[2].serves, got[2].kcal, got[2].fat_per_serving) == (1.0, 0.0, 3.0) and got[3].kcal_per_100g is None and got[4].serves == 1.0
