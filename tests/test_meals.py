from pyspark.sql import functions as F

from mirepoix.operators import meals as M


def test_quantities(spark):
    want = {"120 g": (120.0, "g"), "1,5ml": (1.5, "ml"), " 80 ML ": (80.0, "ml"), "30": (30.0, "g"), "2 eggs": (None, None), "g": (None, None), "": (None, None), None: (None, None)}
    quantity, unit = M.measurement(F.col("m"))
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(want)], "i int, m string").select("i", quantity.alias("q"), unit.alias("u")).orderBy("i").collect()
    assert dict(zip(want, ((r.q, r.u) for r in rows))) == want


def test_meals_have_their_dishes_and_these_their_foods(spark):
    schema = "dish_id string, name string, instructions string, row int, f1 string, f2 string, q1 string, q2 string, c1 string, c2 string"
    wide = spark.createDataFrame(
        [
            ("1", "soup", "boil", 0, "leek", " ", "100 g", None, "11", None), ("2", "old pie", None, 1, "x", None, None, None, None, None), ("2.0", "pie", " ", 2, "flour", "milk", "2", "50 ml", "21", "22"),
            ("x", "none", "", 3, "y", None, None, None, None, None), ("4", " ", "", 4, "z", None, None, None, None, None), (None, "none", "", 5, "y", None, None, None, None, None), ("5", "water", "pour", 6, None, None, None, None, None, None),
        ],
        schema,
    )
    dishes = M.dishes(wide, ["f1", "f2"], ["q1", "q2"], ["c1", "c2"])
    assert {(r.dish_id, r.name, r.instructions, len(r.ingredients)) for r in dishes.collect()} == {(1.0, "soup", "boil", 1), (2.0, "pie", None, 2), (5.0, "water", "pour", 0)}
    plan = spark.createDataFrame([(7, "2", "Pie!", "1", None, "x9", "what"), (8, None, "unlinked", "99", "gone", " ", None), (9, None, None, None, None, None, None), (10, "5", "a", "5", "b", "1.0", "c")], "meal int, `ID.1` string, n1 string, `ID.2` string, n2 string, `ID.3` string, n3 string")
    rows = M.slots(plan, ["meal"], {"dish_id": ["ID.1", "ID.2", "ID.3"], "dish_name": ["n1", "n2", "n3"]})
    got = {r.meal: r for r in M.meals(M.components(rows, dishes, "meal"), "meal").collect()}
    assert set(got) == {7, 8, 10}
    assert [(i.name, i.quantity, i.unit, i.weight_g, i.food_id, i.component) for i in got[7].ingredients] == [("flour", 2.0, "g", 2.0, "21", "pie"), ("milk", 50.0, "ml", None, "22", "pie"), ("leek", 100.0, "g", 100.0, "11", "soup")]
    assert got[7].instructions == ["soup: boil"] and [tuple(m) for m in got[7].missing] == [("x9", "what")]
    assert got[8].components == [] and [tuple(m) for m in got[8].missing] == [("99", "gone")]
    assert [(c.position, c.name, c.source_name) for c in got[10].components] == [(1, "water", "a"), (2, "water", "b"), (3, "soup", "c")]
    assert M.meals(M.components(rows.limit(0), dishes, "meal"), "meal").collect() == []
