import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mirepoix.functions import food_classes as C
from mirepoix.operators import foods
from mirepoix.plans.foods import letters

CANDIDATES = "name string, cleaned string, food_id string, food_name string, similarity double, rrf double, curated boolean"


def best(spark, name, *candidates):
    """candidates: (food name, similarity[, curated])."""
    rows = [(name, name.lower(), str(i), c[0], float(c[1]), 0.0, len(c) > 2) for i, c in enumerate(candidates)]
    r = foods.reranked(spark.createDataFrame(rows, CANDIDATES)).collect()[0]
    return r.food_name, r.confidence


def test_reranking(spark):
    assert best(spark, "chicken breast", ("Chicken breast, raw", 0.82), ("Chicken broth", 0.7)) == ("Chicken breast, raw", "strong")
    assert best(spark, "chianti wine", ("Rice, white, Italian Arborio risotto, raw", 0.66), ("Wine, table, red", 0.52))[0] == "Wine, table, red"
    assert best(spark, "low-fat yoghurt", ("Tofu yogurt", 0.84))[1] == "none"
    assert best(spark, "low-fat yoghurt", ("Tofu yogurt", 0.84), ("Yogurt, plain, low fat", 0.78))[0] == "Yogurt, plain, low fat"
    assert best(spark, "all-purpose flour", ("Potato flour", 0.86, True), ("Wheat flour, white, all-purpose, unenriched", 0.89))[0].startswith("Wheat")
    assert best(spark, "boneless skinless chicken breast", ("Chicken, broilers or fryers, breast, meat only, raw", 0.95, True))[1] == "curated"
    assert best(spark, "chicken breast", ("Chicken breast, roll, oven-roasted", 0.86), ("Chicken, breast, raw", 0.84))[0] == "Chicken, breast, raw"


def test_lexical_score_is_bm25_of_the_candidates(spark):
    corpora = {"a": (["chicken", "breast"], {"1": ["chicken", "breast", "raw"], "2": ["beef", "rump", "steak"], "3": ["chicken", "broth", "chicken"]}), "b": (["x"], {"1": ["y"], "2": []})}
    rows = [(n, q, i, t) for n, (q, of) in corpora.items() for i, t in of.items()]
    got = {(r.name, r.food_id): r.lexical for r in foods.candidate_bm25(spark.createDataFrame(rows, "name string, q_tokens array<string>, food_id string, tokens array<string>")).collect()}
    for n, (q, of) in corpora.items():
        mean, scores = sum(map(len, of.values())) / len(of), {}
        for i, t in of.items():
            scores[i] = 0.0
            for term in q:
                df, tf = sum(term in x for x in of.values()), Counter(t)[term]
                scores[i] += math.log(1 + (len(of) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / max(mean, 1e-9))) if tf else 0
        most = max(scores.values())
        for i in of:
            assert got[n, i] == pytest.approx(scores[i] / most if most else 0.0)


def test_qualifiers(spark):
    cases = {"Fresh chopped parsley": "parsley", "extra virgin olive oil": "olive oil", "low fat milk": "milk", "freshly ground black pepper": "black pepper", "butter": None, "raw": None, "salted  salted butter": "butter"}
    rows = spark.createDataFrame([(k,) for k in cases], "n string").select("n", foods.without_qualifiers(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == cases


def test_classes(spark):
    cases = {"whole milk": "dairy", "soy milk": "plant_milk", "butter beans": "legume", "peanut butter": "dairy", "eggplant": "vegetable", "egg noodles": "egg", "egg  roll": "other", "red wine vinegar": "alcohol", "chicken stock": "animal_protein", None: "other", "": "other", "ground cinnamon": "spice_herb", "olive oil": "oil_fat"}
    rows = spark.createDataFrame([(k,) for k in cases], "n string").select("n", C.food_class(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in rows} == cases
    pairs = {("dairy", "plant_milk"): False, ("plant_milk", "dairy"): False, ("other", "dairy"): True, ("egg", "egg"): True, ("condiment_sauce", "alcohol"): True, ("vegetable", "grain_cereal"): False}
    rows = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", C.compatible(F.col("a"), F.col("b")).alias("ok")).collect()
    assert {(r.a, r.b): r.ok for r in rows} == pairs


def test_names_find_their_foods_end_to_end(spark):
    pool = spark.createDataFrame([("f1", "Parsley, raw"), ("f2", "Chicken breast, raw"), ("f3", "Chicken broth"), ("f4", "Red wine"), ("f5", None)], "food_id string, food_name string")
    aliases = spark.createDataFrame([("chook", "f2", "Chicken breast, raw"), ("chook", "f9", "Other")], "alias string, food_id string, label string")
    links = spark.createDataFrame([("vin rouge", "f4", "Red wine, vin rouge", 0.97)], "name string, food_id string, label string, similarity double")
    names = spark.createDataFrame([(n,) for n in ("Chook", "chicken breast", "freshly chopped parsley", "vin rouge", "zzz qqq xxx", "zzz qqq xxx", None, " ")], "name string")
    rows = {r.name: r for r in foods.best_foods(names, pool, aliases, links, letters, k=3).collect()}
    assert rows.keys() == {"Chook", "chicken breast", "freshly chopped parsley", "vin rouge", "zzz qqq xxx"}
    assert (rows["Chook"].food_id, rows["Chook"].confidence) == ("f2", "alias")
    assert (rows["chicken breast"].food_id, rows["chicken breast"].confidence) == ("f2", "strong")
    assert rows["freshly chopped parsley"].food_id == "f1"
    assert (rows["vin rouge"].food_id, rows["vin rouge"].confidence) == ("f4", "curated")
    assert (rows["zzz qqq xxx"].food_id, rows["zzz qqq xxx"].confidence) == (None, "none")
    nothing = foods.best_foods(names, pool.limit(0), aliases.limit(0), links.limit(0), letters).collect()
    assert {r.confidence for r in nothing} == {"none"} and len(nothing) == 5


def test_other_letters_are_no_parts_of_words(spark):
    names = {"caférum": "alcohol", "éeggplant": "vegetable", "rumé": "alcohol", "rum1": "other", "drum": "other", "ñ soy\x0bmilk": "dairy", "soy\tmilk é": "plant_milk"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", C.food_class(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in rows} == names
