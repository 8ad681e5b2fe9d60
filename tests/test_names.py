from pyspark.sql import functions as F

from mirepoix.functions import names as N


def _each(spark, function, cases):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, raw string").select("i", function(F.col("raw")).alias("name"))
    return [r.name for r in rows.orderBy("i").collect()]


def test_names_of_ingredient_lists(spark):
    want = {
        "2 cups chopped onions": "onion", "Vegetables, mixed, frozen": "vegetables mixed", "chicken, ground": "chicken ground", "tomatoes, canned": "tomato", "the fresh whole basil": "basil", "garlic cloves": "garlic",
        "ground cloves": "ground clove", "fresh thyme sprig": "thyme", "ground slices": "ground slice", "fresh sprig": "sprig", "½ to ¾ cup olive oil (extra virgin)": "olive oil", "1/2 lb. carrots": "lb. carrot", "asparagus": "asparagus", "couscous": "couscous",
        "molasses": "molass", "glasses": "glass", "pies": "pie", "berries": "berry", "salt and": "salt", "Thinly  sliced   Ham": "ham", "Sugar X": "sugar", "bay leaves": "bay leave", "3 eggs": "egg", "400g": None, "x1": None, "to": None, "": None,
        None: None, ",,": None, "optional": None, "()": None, "1 1/2 cups flour": "1/2 cups flour", "a pinch of salt": "pinch of salt", "(note) rice!": "rice", "spices": "spice", "cheese,": "cheese", "coarsely chopped walnuts, toasted": "walnut",
        "x" * 5000 + "s": "x" * 5000,
    }
    got = dict(zip(want, _each(spark, N.ingredient_name, list(want))))
    assert got == want


def test_names_that_links_are_looked_up_by(spark):
    want = {"Fresh Basil Leaves": "basil leaf", "2 large garlic cloves, minced": "2 garlic clove", "Salt, to taste": "salt", "half-and-half": "half-and-half", "crème  fraîche!": "crème fraîche", "": "", None: None, "fresh": ""}
    assert dict(zip(want, _each(spark, N.canonical_name, list(want)))) == want
