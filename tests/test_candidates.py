import random

from mirepoix.operators import match


def test_candidates_equal_a_join_on_all_words_without_dealing_out_words_of_pairs(spark):
    rng = random.Random(3)
    frequent, rare = ["the", "of", "a"], [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.sample(frequent, rng.randrange(0, 4)) + rng.sample(rare, rng.randrange(0, 5)))
    pool = [(i, text()) for i in range(80)] + [(100, None), (101, "")]
    queries = [(i, text()) for i in range(25)] + [(50, "the of"), (51, ""), (52, None), (53, "nowhere"), (54, "w1 w1 the")]
    words = lambda t: set((t or "").split())
    want = set()
    for q, said in queries:
        found = sorted((-len(words(said) & words(t)), p) for p, t in pool if words(said) & words(t))[:4]
        want |= {(q, p, -n, nth) for nth, (n, p) in enumerate(found, 1)}
    found = match.token_candidates(spark.createDataFrame(queries, "q int, said string"), "q", "said", spark.createDataFrame(pool, "p int, t string").repartition(4), "p", "t", 4)
    assert {tuple(r) for r in found.select("q", "p", "shared", "nth").collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "q_words" not in plan and "RepartitionByExpression [p" in plan


def greedy(pairs):
    lefts, rights, out = set(), set(), set()
    for n, q, p in sorted(pairs):
        if q not in lefts and p not in rights:
            lefts.add(q), rights.add(p), out.add((q, p, -n))
    return out


def test_matches_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    text = lambda most: " ".join(rng.sample([f"w{i}" for i in range(12)], rng.randrange(0, most)))
    # a few long texts are the best of nearly all queries, so most of them find their first candidates taken
    pool = [(i, text(10) if i < 6 else text(4)) for i in range(40)] + [(100, None), (101, "")]
    queries = [(i, text(7)) for i in range(32)] + [(50, None), (51, "nowhere")]
    words = lambda t: set((t or "").split())
    pairs = [(-len(words(said) & words(t)), q, p) for q, said in queries for p, t in pool if words(said) & words(t)]
    q, p = spark.createDataFrame(queries, "q int, said string"), spark.createDataFrame(pool, "p int, t string").repartition(4)
    found = match.token_matches(q, "q", "said", p, "p", "t", 2)
    assert {tuple(r) for r in found.collect()} == greedy(pairs) and found.columns == ["q", "p", "shared"]
    all_pairs = spark.createDataFrame([(a, b, -n) for n, a, b in pairs], "q int, p int, shared long").repartition(4)
    for few in (10, 0):
        assert {tuple(r) for r in match.one_to_one(all_pairs, "q", "p", "shared", few).collect()} == greedy(pairs)


def test_passages_whose_candidates_are_all_taken_find_others(spark, tmp_path):
    from mirepoix.plans.matching import greedy_one_to_one

    spark.createDataFrame([(i, 0, "red ring") for i in range(12)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, "a red ring") for i in range(12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in greedy_one_to_one(spark, str(tmp_path)).collect()} == {(i, 100 * i, 2) for i in range(12)}


def test_messages_of_long_conversations_keep_ids_of_their_own(spark, tmp_path):
    from mirepoix.plans.matching import greedy_one_to_one

    said = [(1, 105, "red ring"), (2, 5, "blue bolt"), (3, 0, "odd")]
    spark.createDataFrame(said, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "a red ring"), (2, "a blue bolt")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in greedy_one_to_one(spark, str(tmp_path)).collect()} == {(1, 1105, 2), (2, 2005, 2)}
