"""Weights of ingredient lines: rules of grams a unit, portions of foods, and the cascade that tries them in order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.functions import measures as M
from mirepoix.functions import text as T
from mirepoix.functions import weight_rules as R
from mirepoix.functions.measures import literal_map
from mirepoix.operators.scans import checkpointed


def _any_word(tokens: Column, words: str) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words.split())))


def singular_token(word: Column) -> Column:
    """The singular by the rules for weights: -ies, -les and -ges, -es but after s x z ch sh, -s but not -ss."""
    n = F.length(word)
    cut = lambda k: F.left(word, n - k)
    ladder = F.when(n <= 3, word).when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 4) & word.rlike("(les|ges)$"), cut(1))
    return ladder.when(word.endswith("es") & ~word.rlike("(s|x|z|ch|sh)es$"), cut(2)).when(word.endswith("s") & ~word.endswith("ss"), cut(1)).otherwise(word)


def name_tokens(name: Column) -> Column:
    """The distinct words of a name, and their singulars."""
    return F.array_distinct(F.concat(T.words(name), F.transform(T.words(name), singular_token)))


def plain_name(name: Column) -> Column:
    return T.squeezed(F.regexp_replace(F.lower(name), "[^a-z0-9]", " "))


def unit_of(measurement: Column) -> Column:
    """The first unit of a measurement outside brackets: of mass, volume, a size or something counted, singular; null if it names none."""
    known = [*R.MASS_G, *R.VOLUME_ML, *R.COUNTED, *R.SIZES, "egg_white", "egg_yolk"]
    named = lambda w: F.coalesce(literal_map(R.UNIT_NAMES)[w], w)
    words = F.transform(F.regexp_extract_all(F.regexp_replace(F.lower(measurement), r"\([^)]*\)", " "), F.lit("[a-z_]+"), F.lit(0)), lambda w: F.when(named(w).isin(known), named(w)).otherwise(named(T.singular_head(w))))
    return F.try_element_at(F.filter(words, lambda w: w.isin(known)), F.lit(1))


def counted_in(name: Column) -> Column:
    """The first thing in a name that is counted: "2" of "celery stalks" are stalks."""
    words = F.transform(F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0)), T.singular_head)
    named = F.transform(words, lambda w: F.coalesce(literal_map(R.UNIT_NAMES)[w], w))
    return F.try_element_at(F.filter(named, lambda w: w.isin([*R.COUNTED, "egg_white", "egg_yolk"])), F.lit(1))


def reference_grams(pairs: DataFrame, rules: Sequence[R.Rule] = R.RULES, name: str = "name", unit: str = "unit", size: str | None = None) -> DataFrame:
    """(name, unit, size, unit_grams, label) of the distinct pairs that a rule fits; of several the first in the list.

    Rules are rows. One is met through its unit and a word of its first group, both equal, so that rules cost a pair
    nothing that it shares no word with; what else a rule asks is looked at then. size: column of a size that the
    measurement states. A null name or unit fits no rule; pairs of the same name, unit and size give one row.
    """
    spark = pairs.sparkSession
    table = spark.createDataFrame(
        [(i, r.units.split(), [g.split() for g in r.words], list(r.phrases), list(r.not_phrases), r.grams, r.label, r.sized) for i, r in enumerate(rules)],
        "nth int, units array<string>, words array<array<string>>, phrases array<string>, not_phrases array<string>, grams double, label string, sized string",
    )
    table = table.withColumn("unit", F.explode("units")).withColumn("word", F.explode(F.col("words")[0])).drop("units")
    wanted = pairs.select(F.col(name).alias("name"), F.col(unit).alias("unit"), (F.col(size) if size else F.lit(None).cast("string")).alias("size")).distinct().where("name is not null and unit is not null")
    met = wanted.select("name", "unit", "size", F.inline(F.array(F.struct(name_tokens(F.col("name")).alias("tokens"), plain_name(F.col("name")).alias("plain"))))).withColumn("word", F.explode("tokens")).join(table, ["unit", "word"])
    fits = F.forall("words", lambda g: F.arrays_overlap(g, F.col("tokens"))) & ((F.size("phrases") == 0) | F.exists("phrases", lambda p: F.contains("plain", p))) & ~F.exists("not_phrases", lambda p: F.contains("plain", p))
    first = met.where(fits).groupBy("name", "unit", "size").agg(F.min(F.struct("nth", "grams", "label", "sized")).alias("rule"))
    stated = F.coalesce("size", *(F.when(F.array_contains(name_tokens(F.col("name")), s), s) for s in R.SIZES), F.lit("medium"))
    factor = literal_map(R.SIZES)
    of_unit, of_size = (F.col("rule.sized") == "unit") & F.col("unit").isin(list(R.SIZES)), F.col("rule.sized") == "stated"
    grams = F.when(of_unit, F.col("rule.grams") * factor[F.col("unit")]).when(of_size, F.col("rule.grams") * factor[stated]).otherwise(F.col("rule.grams"))
    label = F.when(of_unit, F.concat_ws(" ", "unit", "rule.label")).when(of_size, F.concat_ws(" ", stated, "rule.label")).otherwise(F.col("rule.label"))
    return first.select("name", "unit", "size", grams.alias("unit_grams"), label.alias("label"))


def portion_unit(desc: Column) -> Column:
    """The unit of a portion's description: its first word after the number, before any bracket."""
    clean = F.trim(F.regexp_replace(F.trim(F.substring_index(F.lower(F.trim(desc)), "(", 1)), r"^[0-9./\s]+", ""))
    first = F.when(clean.rlike("^(fl oz|fluid ounce)"), "fluid ounce").otherwise(F.regexp_replace(F.substring_index(clean, " ", 1), "^[.,]+|[.,]+$", ""))
    return F.coalesce(literal_map(R.PORTION_UNITS)[first], first)


def normal_portions(portions: DataFrame) -> DataFrame:
    """portions (food_id, food_name, portion_desc, amount, grams, grams_per_unit) that tell a unit's grams, with `unit` and those.

    Grams divided by the amount, or the stated grams of a unit where there is no amount; portions of no grams, and
    those whose grams are of what is prepared of them, are left out.
    """
    each = F.when(F.col("amount") > 0, F.col("grams") / F.col("amount")).otherwise(F.col("grams_per_unit"))
    vague = reduce(or_, (F.lower("portion_desc").contains(p) for p in R.AMBIGUOUS))
    rows = portions.where("grams > 0").where(~F.coalesce(vague, F.lit(False))).withColumn("grams_per_unit", each)
    return rows.where("grams_per_unit > 0").withColumn("unit", portion_unit(F.coalesce("portion_desc", F.lit(""))))


def _shared(desc: Column, name: Column) -> Column:
    stem = lambda w: F.when(F.length(w) <= 3, w).when(w.endswith("ies"), F.concat(F.left(w, F.length(w) - 3), F.lit("y"))).when(w.endswith("es"), F.left(w, F.length(w) - 2)).when(w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w)
    stems = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), stem))
    return F.size(F.array_intersect(stems(desc), stems(name)))


def food_portions(portions: DataFrame) -> DataFrame:
    """(food_id, own, portion_density): a row a food with its portions (unit, portion_desc, grams_per_unit) and the median of grams a millilitre.

    Of portions with the same unit and description the least grams count, so a list is as long as a food's descriptions.
    """
    rows, ml = normal_portions(portions).where("food_id is not null"), literal_map(R.VOLUME_ML)
    least = rows.groupBy("food_id", "unit", "portion_desc").agg(F.min("grams_per_unit").alias("grams_per_unit"))
    own = least.groupBy("food_id").agg(F.collect_list(F.struct("unit", "portion_desc", "grams_per_unit")).alias("own"))
    in_ml = rows.where(F.col("unit").isin(list(R.VOLUME_ML)))
    return own.join(in_ml.groupBy("food_id").agg(F.percentile(F.col("grams_per_unit") / ml[F.col("unit")], 0.5).alias("portion_density")).hint("merge"), "food_id", "left")


def own_portion(own: Column, unit: Column, name: Column) -> Column:
    """Grams of a unit by a food's own portions; of several the one whose description shares most words with the name, then the first by description."""
    fits = F.filter(own, lambda p: p["unit"] == unit)
    ranked = lambda ps: F.array_min(F.transform(ps, lambda p: F.struct((-_shared(p["portion_desc"], name)).alias("less"), p["portion_desc"], p["grams_per_unit"].alias("g"))))["g"]
    return T.once(fits, lambda ps: F.when(F.size(ps) > 1, ranked(ps)).otherwise(F.get(ps, F.lit(0))["grams_per_unit"]))


def portion_search(wanted: DataFrame, portions: DataFrame) -> DataFrame:
    """(name, unit, tier, food_name, food_id, portion_desc, grams_per_unit): for each wanted (name, unit) a portion found by the name.

    Tiers, the first with a portion of the unit counts: foods of that name; those that it begins, up to a comma or
    blank, shortest first; those that hold it anywhere, shortest first. Ties go to the smaller food_id, then to the
    portion that shares most words with the name. Names are compared lower-cased; null and empty ones find nothing.

    None is a cross join: names meet equal ones, then the beginnings of food names, and what is still open meets the
    foods that hold the rarest three letters of the name.
    """
    foods = normal_portions(portions).where("food_id is not null").withColumn("food_key", F.lower(F.trim("food_name"))).where("food_key != ''")
    names = wanted.select(F.lower(F.trim("name")).alias("key"), "unit").distinct().where("key != '' and unit is not null")
    keys = foods.select("food_key").distinct()
    letters = F.sequence(F.lit(1), F.length("food_key"))
    begins = F.filter(F.transform(letters, lambda i: F.when(F.substring("food_key", i, 1).isin(",", " "), F.left("food_key", i - 1))), lambda p: p.isNotNull())
    exact = keys.select(F.col("food_key").alias("key"), "food_key", F.lit(1).alias("tier"))
    begun = keys.select(F.explode(F.array_distinct(begins)).alias("key"), "food_key", F.lit(2).alias("tier"))
    found = _best_portion(names.join(exact.union(begun), "key"), foods)
    rest = names.join(found.select("key", "unit"), ["key", "unit"], "left_anti")
    n = F.least(F.length("key"), F.lit(3))
    grams_of = lambda c, size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, size)))
    index = keys.select("food_key", F.explode(F.array_distinct(F.flatten(F.array(*(grams_of("food_key", F.lit(k)) for k in (1, 2, 3)))))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n_foods"))
    asked = rest.select("key").distinct().select("key", F.explode(grams_of("key", n)).alias("gram"))
    rarest = asked.join(counts, "gram", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n_foods", F.lit(0)).alias("n"), "gram")).alias("least"))
    held = rarest.select("key", "least.gram").join(index, "gram").where(F.contains("food_key", "key")).select("key", "food_key", F.lit(3).alias("tier"))
    return _best_portion(rest.join(held, "key"), foods).union(found).select(F.col("key").alias("name"), "unit", "tier", "food_name", "food_id", "portion_desc", "grams_per_unit")


def _best_portion(met: DataFrame, foods: DataFrame) -> DataFrame:
    rows = met.join(foods.hint("merge"), ["food_key", "unit"])  # foods grow; broadcast, they'd pass through the driver
    order = F.struct("tier", F.when(F.col("tier") > 1, F.length("food_key")).otherwise(0).alias("long"), "food_id", (-_shared(F.col("portion_desc"), F.col("key"))).alias("less"), "portion_desc", "food_name", "grams_per_unit")
    best = rows.groupBy("key", "unit").agg(F.min(order).alias("best"))
    return best.select("key", "unit", "best.tier", "best.food_name", "best.food_id", "best.portion_desc", "best.grams_per_unit")


def liquid_density(name: Column) -> Column:
    """Grams for a millilitre of a liquid that a name holds: water-like ones unless dry, then the first listed; null for others."""
    tokens = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0))
    water = _any_word(tokens, R.WATER_LIKE)
    ladder = F.when(water & _any_word(tokens, R.NOT_LIQUID), F.lit(None).cast("double")).when(water, 1.0)
    for phrase, value in (("maple syrup", 1.37), ("soy sauce", 1.19)):
        first, second = phrase.split()
        ladder = ladder.when(F.array_contains(tokens, first) & F.array_contains(tokens, second), value)
    for token, value in R.DENSITY.items():
        ladder = ladder.when(F.array_contains(tokens, token), value)
    return ladder


def _pinch_default(name: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0))
    return ~_any_word(tokens, R.PINCH_NOT) & F.lower(name).rlike("salt|pepper|seasoning")


#: The steps in order, and how sure each is of its grams.
CONFIDENCE = {
    "to_taste_min": 0.5, "offline_reference": 0.95, "explicit_package_size_fallback": 0.9, "common_unit_reference_fallback": 0.8, "water_like_volume_fallback": 0.85,
    "liquid_density_volume_fallback": 0.85, "size_adjusted_reference_unit_fallback": 0.7, "direct_mass": 1.0, "pinch_default_missing_quantity_fallback": 0.5, "herb_pinch_fallback": 0.5,
    "unit_grams_fallback": 0.6, "direct": 0.9, "density_fallback": 0.75, "weight_name_portion_fallback": 0.6,
}


def weighed(lines: DataFrame, portions: DataFrame, offline: DataFrame, unit_grams: DataFrame) -> DataFrame:
    """lines (name, measurement, food_id, herb, ...) with qty, unit, grams, match_type, error and confidence.

    The first step of CONFIDENCE that applies gives the grams; a line that none applies to has an error: missing_food,
    missing_quantity, missing_unit or no_portion. A bare number of 50 or more is grams; else the unit is that of what
    the name counts, and a quantity that is missing is one of it.

    portions: (food_id, food_name, portion_desc, amount, grams, grams_per_unit); offline: vetted (name, unit,
    grams_per_unit), the name lower-cased; unit_grams: (name, grams_per_unit), what one of an ingredient weighs. Both
    have a row a key, of repeated keys the least grams count. herb: whether the food is known to be a spice or herb.

    What a line's texts tell is worked out once for each distinct (name, measurement, herb) with or without a food, the
    search by name included, and joined back. Only lines that no step settles by then meet their food's own portions.
    Null names and measurements are empty; no lines: no rows.
    """
    given = ["name", "measurement", "herb", "some_food"]
    raw, food = F.coalesce("measurement", F.lit("")), F.coalesce("name", F.lit(""))
    size = F.nullif(F.regexp_extract(F.lower(raw), r"\b(small|medium|large)\b", 1), F.lit(""))
    taste = F.trim(F.lower(raw)).isin("to taste", "as needed", "optional", "garnish", "to serve")
    read_once = {
        "measurement": {"q": T.quantity(raw), "u": unit_of(raw), "size": size, "taste": taste},
        "name": {"key": F.lower(F.trim(food)), "counted": counted_in(food), "density": liquid_density(food), "pinch": _pinch_default(food), "powder": F.lower(food).contains("powder")},
    }
    signatures = checkpointed(lines.select("name", "measurement", "herb", F.col("food_id").isNotNull().alias("some_food")).distinct())
    for column, parts in read_once.items():  # texts repeat far more than signatures do
        texts = signatures.select(F.col(column).alias("text__")).distinct().withColumnRenamed("text__", column)
        parsed = texts.select(F.col(column).alias("text__"), F.inline(F.array(F.struct(*(value.alias(part) for part, value in parts.items())))))
        signatures = signatures.join(parsed, F.col(column).eqNullSafe(F.col("text__"))).drop("text__")
    bare = F.col("u").isNull() & (F.col("q") >= R.BARE_GRAMS)
    unit = F.coalesce("u", F.when(bare, "gram"), "counted")
    inferred = F.col("q").isNull() & F.col("u").isNull() & F.col("counted").isNotNull()
    read = checkpointed(signatures.withColumns({"unit": unit, "qty": F.coalesce("q", F.when(inferred, 1.0)), "no_unit": F.col("u").isNull(), "inferred": inferred | (F.col("u").isNull() & unit.isNotNull())}))

    least = lambda df, keys: df.groupBy(*keys).agg(F.min("grams_per_unit").alias("g"))
    vetted = least(offline, ["name", "unit"]).select(F.col("name").alias("key"), "unit", F.col("g").alias("offline_g"))
    ones = least(unit_grams, ["name"]).select(F.col("name").alias("key"), F.col("g").alias("one_g"))
    rules = reference_grams(read, size="size").select("name", "unit", F.coalesce("size", F.lit("")).alias("size_key"), F.col("unit_grams").alias("rule_g"))
    ml = literal_map(R.VOLUME_ML)
    joined = read.withColumn("size_key", F.coalesce("size", F.lit(""))).join(vetted, ["key", "unit"], "left").join(ones, "key", "left").join(rules, ["name", "unit", "size_key"], "left")

    q, u, some_food = F.col("qty"), F.col("unit"), F.col("some_food")
    package = F.when(u.isin(R.PACKAGES.split()) | F.col("measurement").rlike(r"\d\s*x\s*\d"), M.package_grams(F.concat_ws(" ", F.col("measurement"), F.col("name"))))
    density = F.col("density")
    steps = {
        "to_taste_min": F.when(F.col("taste"), R.TO_TASTE_G),
        "offline_reference": q * F.col("offline_g"),
        "explicit_package_size_fallback": F.when(q.isNotNull(), package),
        "common_unit_reference_fallback": q * F.col("rule_g"),
        "water_like_volume_fallback": F.when(density == 1.0, q * ml[u] * density),
        "liquid_density_volume_fallback": q * ml[u] * density,
        "size_adjusted_reference_unit_fallback": q * F.col("one_g") * literal_map(R.SIZES)[u],
        "direct_mass": q * literal_map(R.MASS_G)[u],
        "pinch_default_missing_quantity_fallback": F.when(q.isNull() & (F.col("pinch") | F.col("herb")), R.PINCH_G),
        "herb_pinch_fallback": F.when(some_food & F.col("no_unit") & (F.col("herb") | F.col("powder")), q * R.PINCH_G),
        "unit_grams_fallback": F.when(some_food & F.col("no_unit"), q * F.col("one_g")),
    }
    first = lambda of: (F.coalesce(*of.values()), F.coalesce(*(F.when(value.isNotNull(), step) for step, value in of.items())))
    tried = joined.select(*given, "key", "qty", "unit", "inferred", (q * ml[u]).alias("in_ml"), F.inline(F.array(F.struct(*(value.cast("double").alias(step) for step, value in steps.items())))))
    grams, choice = first({step: F.col(step) for step in steps})
    error = F.when(choice.isNull(), F.when(~some_food, "missing_food").when(q.isNull(), "missing_quantity").when(u.isNull(), "missing_unit"))
    chosen = checkpointed(tried.select(*given, "key", "qty", "unit", "inferred", "in_ml", grams.alias("grams"), choice.alias("match_type"), error.alias("error")))  # the search reads it again and again

    sure = lambda match_type, inferred: F.round(F.greatest(F.lit(0.0), F.coalesce(literal_map(CONFIDENCE)[match_type], F.lit(0.0)) - F.when(inferred, 0.15).otherwise(0.0)), 2)
    names = [F.col(c).alias(f"weighed__{c}") for c in given]
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"weighed__{c}")) for c in given[:3])) & (F.col("food_id").isNotNull() == F.col("weighed__some_food"))
    found = ["qty", "unit", "grams", "match_type", "error", "confidence"]
    settled = "match_type is not null or error is not null"
    solved = lines.join(chosen.where(settled).select(*names, "qty", "unit", "grams", "match_type", "error", sure(F.col("match_type"), F.col("inferred")).alias("confidence")), same)

    open_ = chosen.where(f"not ({settled})")
    by_name = portion_search(open_.select("name", "unit"), portions).select(F.col("name").alias("key"), "unit", F.col("grams_per_unit").alias("weighed__named"))
    open_ = open_.join(by_name, ["key", "unit"], "left").select(*names, F.col("key").alias("weighed__key"), "qty", "unit", F.col("inferred").alias("weighed__inferred"), F.col("in_ml").alias("weighed__ml"), "weighed__named")
    foods = food_portions(portions).toDF("weighed__food", "weighed__own", "weighed__density")
    met = lines.join(open_, same).join(foods.hint("merge"), F.col("food_id") == F.col("weighed__food"), "left")
    last = {"direct": q * own_portion(F.col("weighed__own"), u, F.col("weighed__key")), "density_fallback": F.col("weighed__ml") * F.col("weighed__density"), "weight_name_portion_fallback": q * F.col("weighed__named")}
    met = met.withColumns({f"weighed__{step}": value for step, value in last.items()})
    grams, choice = first({step: F.col(f"weighed__{step}") for step in last})
    met = met.withColumns({"grams": grams, "match_type": choice, "error": F.when(choice.isNull(), "no_portion"), "confidence": sure(choice, F.col("weighed__inferred"))})
    return solved.select(*lines.columns, *found).union(met.select(*lines.columns, *found))
