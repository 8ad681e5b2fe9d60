import random

from mirepoix.operators import graph, merge


def test_all_ancestors_however_deep_and_with_cycles(spark):
    rng = random.Random(4)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(25)] + [(f"m{rng.randrange(12)}", f"m{rng.randrange(12)}") for _ in range(18)] + [("x", "x"), (None, "y"), ("z", None)]
    got = {(r.desc, r.anc): r.depth for r in graph.reachable(spark.createDataFrame(edges, "c string, p string"), "c", "p").collect()}
    up, want = {}, {}
    for c, p in edges:
        if c and p:
            up.setdefault(c, set()).add(p)
    for node in {n for e in edges if all(e) for n in e}:
        level, seen, depth = {node}, {}, 0
        while level:
            seen |= {n: depth for n in level}
            level, depth = {p for n in level for p in up.get(n, ())} - seen.keys(), depth + 1
        want |= {(node, a): d for a, d in seen.items()}
    assert got == want and got["n0", "n25"] == 25
    assert graph.reachable(spark.createDataFrame([], "c string, p string"), "c", "p").collect() == []


def test_groups_have_their_evidence(spark):
    closed = graph.reachable(spark.createDataFrame([("brie", "cheese"), ("cheese", "milk"), ("oat", "grain")], "c string, p string"), "c", "p")
    members = spark.createDataFrame([(1, "brie"), (1, "brie"), (1, "cheese"), (2, "oat"), (3, "rock"), (4, None)], "item int, food string")
    groups = spark.createDataFrame([("milk", "dairy"), ("cheese", "dairy"), ("grain", "grains")], "anc string, group string")
    rows = {(r.item, r.evidence.value): (r.evidence.classes, r.evidence.nodes, r.evidence.confidence) for r in graph.derived_groups(members, closed, groups, "item", "food").collect()}
    assert rows == {(1, "dairy"): (["cheese", "milk"], ["brie", "cheese"], 1.0), (2, "grains"): (["grain"], ["oat"], 1.0)}


def test_statuses_and_their_outcomes(spark):
    rows = spark.createDataFrame([(1, None, None, "a"), (2, "disabled", "old", "b"), (3, "active", None, "c"), (None, "active", "r", "d")], "id int, status string, reason string, more string")
    asked = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "id int")
    got = {tuple(r) for r in merge.with_status(rows, asked, "id", "disabled", "new").collect()}
    assert got == {(1, "disabled", "new", "a", "updated"), (2, "disabled", "old", "b", "unchanged"), (3, "active", None, "c", "kept"), (None, "active", "r", "d", "kept"), (9, None, None, None, "not_found")}


def test_deep_ancestors_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "checkpointed", lambda df, real=graph.checkpointed: rounds.append(1) or real(df))
    got = graph.reachable(spark.createDataFrame([(i, i // 2 if i > 1 else 100) for i in range(1, 101)], "c int, p int"), "c", "p").collect()
    assert len(got) == len({(r.desc, r.anc) for r in got}) and max(r.depth for r in got) == 12
    assert len(rounds) <= 7  # edges, the first two distances, and up to 2, 4, 8, 16


def test_ancestors_are_found_without_broadcasts(spark, monkeypatch):
    plans, write = [], graph.checkpointed

    def written(df):
        out = write(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran
        return out

    monkeypatch.setattr(graph, "checkpointed", written)
    found = graph.reachable(spark.createDataFrame([(i, i // 2) for i in range(1, 40)], "c long, p long"), "c", "p")
    assert found.where("desc = 39").orderBy("depth").select("anc").collect() == [(39,), (19,), (9,), (4,), (2,), (1,), (0,)]
    assert sum("Join" in p for p in plans) == 3 and not any("Broadcast" in p for p in plans)
