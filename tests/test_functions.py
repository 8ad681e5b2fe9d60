"""Literal cases of the expressions and operators that the SQL comparison doesn't reach."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mirepoix.functions import cleaning as C
from mirepoix.functions import measures as M
from mirepoix.functions import scoring
from mirepoix.functions import text as T
from mirepoix.operators import graph, match, report, rollup, search


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n__ int, " + schema).orderBy("n__").select(*columns).collect()]


def test_dish_families(spark):
    cases = {
        "Gluten-free berry muesli": "muesli", "Nutty toasted muesli": "muesli", "Munchy muesli mix": "muesli", "Baked eggplant with cranberry and mint": "eggplant",
        "Tomato, chickpea and barley salad": "salad", "Chicken in black bean sauce": "chicken", "Tomato sauce": "sauce", "Roasted balsamic thyme onions": "onion",
        "Blackberries": "blackberry", "Peach dishes": "dish", "Baked potatoes": "potato", "Glass": "glass", "": "", None: "",
    }
    got = values(spark, [(t,) for t in cases], "t string", T.dish_family(F.col("t")), T.is_meal(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())
    assert [t for t, g in zip(cases, got) if not g[1]] == ["Tomato sauce"]


def test_quantities(spark):
    cases = {"1 1/2 cups": 1.5, "½ tsp": 0.5, "1½ tsp": 1.5, "3/4": 0.75, "2-3 cloves": 2.5, "2 to 4": 3.0, "0.25 l": 0.25, "two eggs": 2.0, "half a lemon": 0.5, "to taste": None, "": None, None: None}
    assert [v for (v,) in values(spark, [(t,) for t in cases], "t string", T.quantity(F.col("t")))] == list(cases.values())


def test_numbers_minutes_and_coercion(spark):
    got = values(spark, [("1 h 30 min",), ("PT1H5M",), ("45",), ("20 minutes",), ("soon",), (None,)], "t string", T.minutes(F.col("t")))
    assert [v for (v,) in got] == [90.0, 65.0, 45.0, 20.0, None, None]
    got = values(spark, [("Tr",), ("<0.1",), ("1,5",), ("-",), ("12",), ("x",), (None,)], "t string", T.coerced_number(F.col("t")))
    assert [v for (v,) in got] == [None, 0.1, 1.5, None, 12.0, None, None]
    got = values(spark, [("serves 4-6",), ("none",), (None,)], "t string", T.mean_of_integers(F.col("t")))
    assert [v for (v,) in got] == [5.0, None, None]
    got = values(spark, [("-3.5 kg",), ("no",)], "t string", T.first_number(F.col("t")))
    assert [v for (v,) in got] == [-3.5, None]


def test_lines_split_and_weigh(spark):
    cases = {"1 1/2 cups milk": ("1 1/2 cups", "milk"), "2 x 400 g cans tomatoes": ("2 x 400 g cans", "tomatoes"), "28 oz can tomatoes": ("28 oz can", "tomatoes"), "salt": ("", "salt"), "3 large eggs": ("3", "large eggs"), "½ tsp. of thyme": ("1/2 tsp.", "thyme")}
    measurement, name = M.split_line(F.col("t"))
    assert values(spark, [(t,) for t in cases], "t string", measurement, name) == list(cases.values())
    rows = [("olive oil", "2 tbsp", None), ("flour", "250 g", None), ("tomatoes", "2 x 400 g", None), ("beans", "1 (14 oz) can", None), ("eggs", "3 large", 50.0), ("eggs", "2", 50.0), ("salt", "to taste", None), ("love", "some", None)]
    lines = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + rows[:1] + [(None, None, None)])], "i int, name string, m string, piece double")
    got = [(r.g, r.how) for r in M.with_grams(lines, measurement="m", piece_g=F.col("piece")).orderBy("i").select(F.round("grams", 2).alias("g"), "how").collect()]
    assert got[8:] == [(27.6, "volume"), (None, "none")]
    assert got[:8] == [(27.6, "volume"), (250.0, "package"), (800.0, "package"), (396.89, "package"), (202.5, "sized_piece"), (100.0, "piece"), (1.0, "to_taste"), (None, "none")]


def test_plural_variants_and_fractions(spark):
    got = values(spark, [("red berry",), ("box",), ("hen",)], "t string", T.number_variants(F.col("t")))
    assert [v for (v,) in got] == [["red berry", "red berries"], ["box", "boxes"], ["hen", "hens"]]
    got = values(spark, [(1.5,), (0.33,), (2.0,), (0.99,), (3.1,)], "v double", T.mixed_fraction(F.col("v")))
    assert [v for (v,) in got] == ["1 1/2", "1/3", "2", "1", "3.10"]


def test_serves(spark):
    count, source = scoring.serves(F.col("parsed"), F.col("w"))
    rows = [(4.0, 1800.0), (4.4, 1800.0), (24.0, 1800.0), (None, 1800.0), (200.0, 1800.0), (None, 50000.0), (None, 0.0), (2.5, 10.0)]
    assert values(spark, rows, "parsed double, w double", count, source) == [(4, "given"), (4, "given"), (24, "given"), (4, "estimated"), (4, "estimated"), (4, "estimated"), (1, "estimated"), (2, "given")]


def test_weight_cap(spark):
    rows = [(1, 0, 500.0, 4.0), (1, 1, 300.0, 4.0), (2, 0, 39000.0, 4.0), (2, 1, 400.0, 4.0), *((3, i, 3000.0, 4.0) for i in range(4))]
    df = spark.createDataFrame(rows, "item int, pos int, w double, serves double")
    got = {(r.item, r.pos): (r.capped_weight, r.was_capped) for r in rollup.capped_weights(df, "item", "w", "serves", ["pos"]).collect()}
    assert got[(1, 0)] == (500.0, False) and got[(2, 1)] == (400.0, True) and got[(2, 0)][0] < 5000
    assert [got[(3, i)] for i in range(4)] == [(2500.0, True)] * 4


def test_score_rules(spark):
    cols = [F.col(c) for c in ("kj", "sugar", "sat", "na", "fibre", "protein", "fruit")]
    s = scoring.score(*cols)
    rows = [(0.0,) * 7, (3400.0, 0.0, 2.0, 0.0, 0.0, 9.0, 0.0), (3400.0, 0.0, 2.0, 0.0, 0.0, 9.0, 81.0), (300.0, 0.0, 0.0, 0.0, 5.0, 9.0, 0.0)]
    schema = "kj double, sugar double, sat double, na double, fibre double, protein double, fruit double"
    assert values(spark, rows, schema, s, scoring.grade(s)) == [(0, "A"), (11, "D"), (1, "B"), (-10, "A")]
    assert values(spark, [("Nutriscore_B",), ("e",), ("x",), (None,)], "g string", scoring.grade_rank(F.col("g"))) == [(2,), (5,), (None,), (None,)]


def test_claims_and_deviation(spark):
    got = values(spark, [(30.0, 1.0, 7.0, 2.0), (None, None, None, None), (0.0, 5.0, 1.0, 1.0)], "k double, f double, fi double, p double", F.array_join(scoring.claims(*(F.col(c) for c in ("k", "f", "fi", "p"))), ","))
    assert got == [("low_calorie,low_fat,high_fibre,high_protein",), ("",), ("low_calorie",)]
    got = values(spark, [(0.0, 0.0), (5.0, 0.0), (6.0, 4.0)], "c double, r double", report.deviation_pct(F.col("c"), F.col("r")))
    assert got == [(0.0,), (None,), (50.0,)]


def test_three_states(spark):
    rows = [(1, "suitable"), (1, "not_suitable"), (2, "suitable"), (2, "suitable"), (3, "suitable"), (3, None)]
    got = {r.item: r.status for r in graph.three_state(spark.createDataFrame(rows, "item int, status string"), "item", "status").collect()}
    assert got == {1: "not_suitable", 2: "suitable", 3: "unknown"}


def test_closure_with_a_cycle_and_common_ancestors(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), (None, "c")], "child string, parent string")
    closed = graph.closure(edges, "child", "parent", 4)
    got = {(r.desc, r.anc): r.depth for r in closed.collect()}
    assert got[("a", "a")] == 0 and got[("a", "c")] == 2 and got[("d", "a")] == 2 and len(got) == 13
    pairs = spark.createDataFrame([("a", "d"), ("a", "zz"), ("d", "b")], "x string, y string")
    assert {(r.x, r.y): r.related for r in graph.common_ancestor(pairs, "x", "y", closed, 0).collect()} == {("a", "d"): False, ("a", "zz"): None, ("d", "b"): False}
    assert {(r.x, r.y): r.related for r in graph.common_ancestor(pairs, "x", "y", closed, 1).collect()} == {("a", "d"): False, ("a", "zz"): None, ("d", "b"): True}


def greedy_diverse(rows, n, k):
    taken, used = [], {}
    for rank, family in rows:
        if len(taken) < n and (family == "" or used.get(family, 0) < k):
            taken.append(rank)
            used[family] = used.get(family, 0) + 1
    return (taken + [r for r, _ in rows if r not in taken])[:n]


def test_diverse_selection_equals_greedy_with_backfill(spark):
    rng = random.Random(1)
    for _ in range(4):
        rows = [(i, rng.choice(["", "a", "b", "c"])) for i in range(12)]
        n, k = rng.randint(1, 10), rng.randint(1, 3)
        got = [r["rank"] for r in search.diverse(spark.createDataFrame(rows, "rank int, family string"), "family", [F.col("rank")], n, k).collect()]
        assert got == greedy_diverse(rows, n, k)


def ladder(rows, names, least):
    for dropped in range(len(names) + 1):
        active = names[: len(names) - dropped]
        found = [i for i, r in rows if all(r[n] for n in active)]
        if len(found) >= least:
            return found
    return found


def test_relaxation_equals_repeated_queries(spark):
    rng = random.Random(2)
    names = ["x", "y", "z"]
    for least in (1, 5, 30):
        rows = [(i, {n: rng.choice([True, False, None]) for n in names}) for i in range(25)]
        df = spark.createDataFrame([Row(id=i, **r) for i, r in rows], "id int, x boolean, y boolean, z boolean")
        c = search.Constraints(soft={n: F.col(n) for n in names})
        assert sorted(r.id for r in search.relaxed(df, c, least).collect()) == sorted(ladder(rows, names, least))


def test_hard_conditions_are_never_relaxed(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, None, False)], "id int, allergen string, x boolean")
    c = search.Constraints(excluded=[F.col("allergen") == "b"], soft={"x": F.col("x")})
    assert sorted(r.id for r in search.relaxed(df, c, 10).collect()) == [1, 3]
    with pytest.raises(ValueError):
        search.sort_columns("id;drop", ["id"])
    with pytest.raises(ValueError):
        search.page(df, ["id"], 9_990, 20)


def test_bm25_prefers_the_shorter_and_fuller(spark):
    docs = spark.createDataFrame([(1, "chicken breast"), (2, "chicken broth"), (3, "beef"), (4, "")], "id int, t string")
    got = {r.id: r.score for r in match.bm25(docs, "id", T.words(F.col("t")), ["chicken", "breast", "chicken"]).collect()}
    assert got[1] == 1.0 and 0 < got[2] < 1 and set(got) == {1, 2}


def test_greedy_one_to_one(spark):
    rng = random.Random(3)
    pairs = [(a, b, rng.randint(0, 6)) for a in range(8) for b in range(8) if rng.random() < 0.6]
    want, left, right = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    got = match.one_to_one(spark.createDataFrame(pairs, "a int, b int, s int"), "a", "b", "s").collect()
    assert {(r.a, r.b) for r in got} == want


def test_cosine_and_sequence_ratio(spark):
    got = values(spark, [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>", match.cosine(F.col("a"), F.col("b")))
    assert got == [(1.0,), (-1.0,), (None,)]
    got = values(spark, [("abcd", "bcde"), ("", ""), (None, "a")], "a string, b string", match.sequence_ratio("a", "b"))
    assert got[:2] == [(0.75,), (1.0,)] and got[2][0] is None


def test_digest_ignores_order_case_and_repeats(spark):
    (a,), (b,), (c,) = values(spark, [(["x", " Y "],), (["y", "X", "x", ""],), (["z"],)], "v array<string>", T.digest(F.col("v")))
    assert a == b != c


def test_realigned_measurements(spark):
    cases = [
        (["olive oil", "tomatoes", "salt"], ["2 large tomatoes", "1 tbsp oil", "a pinch"], ["1 tbsp oil", "2 large tomatoes", "a pinch"]),
        (["flour", "milk"], ["1 cup", "2 g", "3 oz"], ["1 cup", "2 g", "3 oz"]),
        (["egg", "egg", "milk"], ["1 cup milk", "2 eggs", "3 eggs"], ["2 eggs", "3 eggs", "1 cup milk"]),
        (["egg", None, ""], ["1 g", None, "2 eggs"], ["2 eggs", "1 g", None]),
        ([], ["1 g"], ["1 g"]),
        (["salt"], [], []),
        (None, ["1 g"], None),
        (["salt"], None, None),
    ]
    rows = spark.createDataFrame([(i, n, m) for i, (n, m, _) in enumerate(cases)], "id int, names array<string>, measurements array<string>")
    got = {r.id: r.realigned for r in match.realigned(rows).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}
    assert match.realigned(rows.limit(0)).collect() == []


def test_distribution_equals_numpy_on_ties_tails_and_null_keys(spark):
    rng = np.random.default_rng(5)
    values = {None: [3.0, 3.0, 3.0, -2.5], "a": [*rng.lognormal(0, 4, 500), *[7.0] * 300, -1e12, 1e12], "b": [1e9 + k / 8 for k in range(64)], "one": [4.0]}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("empty", None)], "k string, v double")
    got = {r.k: r for r in report.distribution(rows, ["k"], "v", {"q1": 0.25, "median": 0.5, "p99": 0.99}).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert got[k].n == len(vs) and got[k].least == min(vs) and got[k].most == max(vs)
        np.testing.assert_allclose([got[k].q1, got[k].median, got[k].p99], np.quantile(vs, [0.25, 0.5, 0.99]), rtol=1e-12)
    assert report.distribution(rows.limit(0), ["k"], "v", {"median": 0.5}).count() == 0


def test_equipment_labels_measurements_and_generic_names(spark):
    name = F.col("a")
    kept = ["rack of lamb", "tea bag", "olive oil, plus extra, to brush", "chicken breast fillets cooking spray oil", "lamb skewers", "", None]
    gone = ["wooden skewers, soaked in water", "butcher's twine", "olive oil flavored cooking spray", "Parchment paper", "cheese grater"]
    assert values(spark, [(x,) for x in kept + gone], "a string", C.pure_equipment(name)) == [(False,)] * len(kept) + [(True,)] * len(gone)
    forms = {"2.50 Tablespoons of": "2.5 tbsp", "400grams": "400 grams", "400 grams": "400 g", " 1.0  kilogram": "1 kg", "a pinch": "a pinch", "1/2 cup": "1/2 cup", "1.2.3": "1.2.3", "": "", None: None}
    assert values(spark, [(x,) for x in forms], "a string", C.measurement_form(name)) == [(x,) for x in forms.values()]
    labels = {"cheese (white)@en": "cheese white", "Feta cheese food product@en": "feta cheese", "food": "", None: None}
    assert values(spark, [(x,) for x in labels], "a string", C.ontology_label(name)) == [(x,) for x in labels.values()]
    brands = [("Acme's Honey Dressing", "honey dressing", "Acme", True, []), ("Bolt cola", "drinks", "Bolt", False, ["cola"]), ("Kip pie", "2 pies", "Kip", False, []), ("Fog prawns", "fog prawn", "Fog", False, []), (None, None, None, False, None)]
    got = values(spark, [b[:3] for b in brands], "a string, b string, c string", C.generic_is_valid(name, F.col("b"), F.col("c")), C.lost_tokens(name, F.col("b"), F.col("c")))
    assert got == [b[3:] for b in brands]
    weights = [(["duck"], "whole", 300.0, "whole_animal_too_small"), (["oil"], "", 3.0, "missing_unit"), (["oil"], "cup", 28.3, "suspicious_unit_conversion_default:28.35"), (["salt"], "pinch", 6.0, "pinch_too_heavy"), (["oil"], "oz", 28.35, None), (["oil"], "cup", 220.0, None)]
    assert values(spark, [w[:3] for w in weights], "a array<string>, u string, g double", C.implausible_weight(name, F.col("u"), F.col("g"), F.lit(None).cast("string"))) == [(w[3],) for w in weights]
