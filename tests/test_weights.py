import pytest
from pyspark.sql import functions as F

from mirepoix.functions import weight_rules as R
from mirepoix.operators import weights

LINES = "name string, measurement string, food_id string, herb boolean, unit int"
PORTIONS = "food_id string, food_name string, portion_desc string, amount double, grams double, grams_per_unit double"
FOODS = [
    ("1", "Flour, wheat", "cup", 1.0, 125.0, None),
    ("1", "Flour, wheat", "2 tbsp", 2.0, 16.0, 99.0),
    ("2", "Carrots, raw", "slice", 4.0, 12.0, None),
    ("2", "Carrots, raw", "slice (dry yields 3)", 1.0, 99.0, None),
    ("3", "Noodles, egg, cooked", "cup", 1.0, 160.0, None),
    ("3", "Noodles, egg, cooked", "cup elbows", 1.0, 150.0, None),
    ("4", "Noodles", "oz", 0.0, 28.0, 28.0),
    (None, "Noodles", "cup", 1.0, 5.0, None),
    ("5", "Bread", "slice", 1.0, 0.0, None),
]


def weighed(spark, cases, offline=(), ones=()):
    lines = spark.createDataFrame([(*c, 7) for c in cases], LINES)
    tables = [spark.createDataFrame(list(FOODS), PORTIONS), spark.createDataFrame(list(offline), "name string, unit string, grams_per_unit double"), spark.createDataFrame(list(ones), "name string, grams_per_unit double")]
    lines = lines.withColumnRenamed("unit", "other")
    rows = weights.weighed(lines, *tables).collect()
    found = {(r.name, r.measurement, r.food_id, r.herb): r for r in rows}
    return [found[c] for c in cases]


def test_each_step_of_the_cascade(spark):
    cases = {
        ("salt", "to taste", None, False): ("to_taste_min", 0.5),
        ("rice", "2 cups", None, False): ("offline_reference", 370.0),
        ("tomatoes", "2 (400 g) cans", "9", False): ("explicit_package_size_fallback", 800.0),
        ("tomatoes", "2 x 400 g", "9", False): ("explicit_package_size_fallback", 800.0),
        ("black beans", "1 can", None, False): ("common_unit_reference_fallback", 425.0),
        ("large eggs", "3", None, False): ("common_unit_reference_fallback", 150.0),
        ("apples", "2 small", None, False): ("common_unit_reference_fallback", 236.6),
        ("vegetable stock", "1 cup", None, False): ("water_like_volume_fallback", 240.0),
        ("olive oil", "2 tbsp", None, False): ("liquid_density_volume_fallback", 27.6),
        ("maple syrup", "1 cup", None, False): ("liquid_density_volume_fallback", 328.8),
        ("dumplings", "2 large", None, False): ("size_adjusted_reference_unit_fallback", 54.0),
        ("beef", "1.5 lb", None, False): ("direct_mass", 680.388555),
        ("sugar", "250", "8", False): ("direct_mass", 250.0),
        ("seasoning", None, None, False): ("pinch_default_missing_quantity_fallback", 0.3),
        ("sumac", None, None, True): ("pinch_default_missing_quantity_fallback", 0.3),
        ("chilli powder", "2", "6", False): ("herb_pinch_fallback", 0.6),
        ("dumplings", "3", "7", False): ("unit_grams_fallback", 60.0),
        ("wheat flour", "2 cups", "1", False): ("direct", 250.0),
        ("egg noodle elbows", "1 cup", "3", False): ("direct", 150.0),
        ("raw carrot coins", "2 slices", "2", False): ("direct", 6.0),
        ("wheat flour", "1 ml", "1", False): ("density_fallback", (125 / 240 + 8 / 15) / 2),
        ("noodles", "1 slice", "3", False): (None, None),
        ("Noodles", "2 cups", "77", False): ("weight_name_portion_fallback", 320.0),
        ("love", "some", None, False): (None, None),
        ("love", "some", "5", False): (None, None),
        ("love", "2", "5", False): (None, None),
        (None, None, None, False): (None, None),
    }
    rows = weighed(spark, list(cases), [("rice", "cup", 185.0), ("rice", "cup", 190.0)], [("dumplings", 20.0)])
    for (case, (match_type, grams)), r in zip(cases.items(), rows):
        assert r.match_type == match_type, (case, r)
        assert r.grams == (pytest.approx(grams) if grams is not None else None), (case, r)
        assert (r.error is None) == (match_type is not None) and r.other == 7
    assert [rows[i].error for i in (21, 23, 24, 25, 26)] == ["no_portion", "missing_food", "missing_quantity", "missing_unit", "missing_food"]
    assert rows[5].confidence == 0.65 and rows[11].confidence == 1.0  # what is inferred is less sure


def test_no_lines_and_repeated_ones(spark):
    assert weights.weighed(spark.createDataFrame([], LINES).drop("unit"), spark.createDataFrame(FOODS, PORTIONS), *(spark.createDataFrame([], s) for s in ("name string, unit string, grams_per_unit double", "name string, grams_per_unit double"))).collect() == []
    lines = spark.createDataFrame([("beef", "1 kg", None, False)] * 3 + [("beef", "1 kg", None, None)], "name string, measurement string, food_id string, herb boolean")
    empty = [spark.createDataFrame([], s) for s in ("name string, unit string, grams_per_unit double", "name string, grams_per_unit double")]
    assert [r.grams for r in weights.weighed(lines, spark.createDataFrame(FOODS, PORTIONS), *empty).collect()] == [1000.0] * 4


def test_every_rule_is_met_by_a_pair_of_its_own(spark):
    """Each rule's words name a pair that this rule or an earlier one fits, as a plain look through the list finds it."""
    pairs = []
    for r in R.RULES:
        for unit in r.units.split():
            pairs.append((" ".join([*r.phrases, *(g.split()[0] for g in r.words)]), unit))
    got = {(r.name, r.unit): (r.unit_grams, r.label) for r in weights.reference_grams(spark.createDataFrame(pairs, "name string, unit string")).collect()}
    tokens = lambda name: {w for w in name.split()} | {w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") and not w.endswith("es") else w for w in name.split()}
    for name, unit in pairs:
        fits = next(r for r in R.RULES if unit in r.units.split() and all(set(g.split()) & tokens(name) for g in r.words) and (not r.phrases or any(p in name for p in r.phrases)) and not any(p in name for p in r.not_phrases))
        factor = R.SIZES.get(unit, 1.0) if fits.sized == "unit" else 1.0
        assert got[name, unit][0] == pytest.approx(fits.grams * factor), (name, unit)
        assert got[name, unit][1].endswith(fits.label)
    assert len({label for _, label in got.values()}) > 55


def test_sizes_and_cheeses(spark):
    pairs = [("large fennel bulb", "bulb"), ("fennel", "bulb"), ("cream cheese with cheddar", "cup"), ("cheddar cheese", "cup"), ("tomato", "large"), (None, "cup"), ("tomato", None)]
    got = {(r.name, r.unit): (round(r.unit_grams, 2), r.label) for r in weights.reference_grams(spark.createDataFrame(pairs, "name string, unit string")).collect()}
    assert got == {("large fennel bulb", "bulb"): (315.9, "large fennel bulb"), ("fennel", "bulb"): (234.0, "medium fennel bulb"), ("cheddar cheese", "cup"): (113.0, "shredded hard cheese cup"), ("tomato", "large"): (166.05, "large tomato")}


def test_search_goes_through_its_tiers(spark):
    foods = [("1", "Milk", "cup", 1.0, 244.0, None), ("2", "Milk, whole", "cup", 1.0, 240.0, None), ("3", "Milk shake mix", "tbsp", 1.0, 9.0, None), ("4", "Buttermilk", "cup", 1.0, 245.0, None), ("5", "Low-fat buttermilk", "quart", 1.0, 980.0, None), (None, "Milk", "quart", 1.0, 1.0, None), ("6", "Milk, dry", "cup, sifted whole", 2.0, 130.0, None), ("6", "Milk, dry", "cup, level", 2.0, 120.0, None)]
    wanted = [("milk", "cup"), ("Milk ", "tablespoon"), ("milk", "quart"), ("lk", "quart"), ("k", "cup"), ("milk, dry", "cup"), ("soy", "cup"), ("", "cup"), (None, "cup"), ("milk", None)]
    rows = weights.portion_search(spark.createDataFrame(wanted, "name string, unit string"), spark.createDataFrame(foods, PORTIONS)).collect()
    got = {(r.name, r.unit): (r.tier, r.food_id, r.grams_per_unit) for r in rows}
    assert got == {("milk", "cup"): (1, "1", 244.0), ("milk", "tablespoon"): (2, "3", 9.0), ("milk", "quart"): (3, "5", 980.0), ("lk", "quart"): (3, "5", 980.0), ("k", "cup"): (3, "1", 244.0), ("milk, dry", "cup"): (1, "6", 60.0)}


def test_units_of_portions(spark):
    cases = {"cup elbows": "cup", "1 fl oz": "fluid ounce", "2 Tbsp.": "tablespoon", "slice (28 g)": "slice", "0.5 lbs": "pound", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", weights.portion_unit(F.col("d")).alias("u")).collect()
    assert {r.d: r.u for r in rows} == cases


def test_texts_are_worked_out_once_however_many_foods_they_are_of(spark, monkeypatch):
    written, write = [], weights.checkpointed
    monkeypatch.setattr(weights, "checkpointed", lambda df: written.append(write(df)) or written[-1])
    lines = [(name, measurement, str(food), False) for name, measurement in (("salt", "to taste"), ("raw carrot coins", "2 slices")) for food in range(1, 41)]
    empty = [spark.createDataFrame([], s) for s in ("name string, unit string, grams_per_unit double", "name string, grams_per_unit double")]
    rows = weights.weighed(spark.createDataFrame(lines, "name string, measurement string, food_id string, herb boolean"), spark.createDataFrame(FOODS, PORTIONS), *empty).collect()
    assert len(rows) == 80 and {(r.food_id, r.match_type) for r in rows if r.grams == 6.0} == {("2", "direct")}
    assert written and all(df.count() == 2 for df in written)


def test_a_food_has_several_portions_of_a_unit(spark):
    portions = [("1", "Rice", "cup, dry", 1.0, 185.0, None), ("1", "Rice", "cup, cooked", 1.0, 158.0, None), ("1", "Rice", "cup, cooked", 1.0, 150.0, None), ("1", "Rice", "pack", 1.0, 500.0, None), (None, "Rice", "cup", 1.0, 1.0, None)]
    food = weights.food_portions(spark.createDataFrame(portions, PORTIONS)).collect()
    assert [(r.food_id, len(r.own)) for r in food] == [("1", 3)] and food[0].portion_density == pytest.approx(158.0 / 240)
    wanted = weights.food_portions(spark.createDataFrame(portions, PORTIONS)).select(*(weights.own_portion(F.col("own"), F.lit(u), F.lit(n)).alias(f"g{i}") for i, (u, n) in enumerate([("cup", "dry rice"), ("cup", "rice"), ("pack", "rice"), ("slice", "rice")])))
    assert tuple(wanted.first()) == (185.0, 150.0, 500.0, None)
