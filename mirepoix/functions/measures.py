"""Measurement lines to units and grams. Unit tables are small literal maps; every step is a built-in expression."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirepoix.functions import text as T

# Grams of mass units, millilitres of volume units, densities of liquids, factors of sizes.
MASS_G = {"g": 1.0, "gram": 1.0, "kg": 1000.0, "kilogram": 1000.0, "mg": 0.001, "milligram": 0.001, "oz": 28.349523125, "ounce": 28.349523125, "lb": 453.59237, "pound": 453.59237}
VOLUME_ML = {"ml": 1.0, "milliliter": 1.0, "l": 1000.0, "liter": 1000.0, "litre": 1000.0, "teaspoon": 5.0, "tsp": 5.0, "tablespoon": 15.0, "tbsp": 15.0, "cup": 240.0, "dash": 0.5, "splash": 15.0}
DENSITY = {"oil": 0.92, "milk": 1.03, "cream": 0.99, "honey": 1.42, "syrup": 1.37, "vinegar": 1.01, "sauce": 1.19, "juice": 1.04, "wine": 0.99}
SIZE_FACTOR = {"small": 0.65, "medium": 1.0, "large": 1.35}
_ALIASES = {"c": "cup", "lbs": "lb"}


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def unit(measurement: Column) -> Column:
    """The first unit word of a measurement, singular and without aliases; null if it names none."""
    known = [*MASS_G, *VOLUME_ML, *_ALIASES]
    tokens = F.transform(F.regexp_extract_all(F.lower(measurement), F.lit("[a-z]+"), F.lit(0)), lambda w: F.when(w.isin(known), w).otherwise(F.regexp_replace(w, "s$", "")))
    found = F.try_element_at(F.filter(tokens, lambda w: w.isin(known)), F.lit(1))
    return F.coalesce(literal_map(_ALIASES)[found], found)


def density(name: Column) -> Column:
    """Grams for a millilitre by the first liquid that a name holds; 1 for others."""
    ladder = None
    for token, value in DENSITY.items():
        hit = T.keyword(name, [token])
        ladder = F.when(hit, value) if ladder is None else ladder.when(hit, value)
    return ladder.otherwise(1.0)


def package_grams(measurement: Column) -> Column:
    """Grams of a stated package: "2 x 400 g", "1 (14 oz) can"; null without one."""
    rx = r"(?:^|\()\s*(?:(\d+)\s*x\s*)?(\d+(?:\.\d+)?)\s*(kg|g|oz|lb)\b"
    m = F.lower(measurement)
    count = F.coalesce(F.nullif(F.regexp_extract(m, rx, 1), F.lit("")).cast("double"), F.nullif(F.regexp_extract(m, r"^(\d+)\s*\(", 1), F.lit("")).cast("double"), F.lit(1.0))
    return count * F.nullif(F.regexp_extract(m, rx, 2), F.lit("")).cast("double") * literal_map(MASS_G)[F.regexp_extract(m, rx, 3)]


def with_grams(rows: DataFrame, name: str = "name", measurement: str = "measurement", piece_g: Column | None = None) -> DataFrame:
    """rows with grams and how: the first way that applies, in fixed order: to taste, package, mass, volume by density, sized pieces, pieces.

    piece_g: grams of one piece of the food, null if unknown. No way: (null, "none"). A measurement is worked out once
    for each distinct (name, measurement, piece), and joined back; quantity, unit, package and density are computed once,
    before the ways that use them.
    """
    text, food = F.col("measurement"), F.col("name")
    piece = F.lit(None).cast("double") if piece_g is None else piece_g.cast("double")
    wanted = {"name": F.col(name), "measurement": F.col(measurement), "piece": piece}
    pairs = rows.select(*(c.alias(n) for n, c in wanted.items())).distinct()
    size = F.regexp_extract(F.lower(text), "(small|medium|large)", 1)
    taste = F.lower(F.trim(text)).isin("to taste", "as needed", "optional", "garnish", "to serve")
    parts = F.struct(F.coalesce(T.quantity(text), F.lit(1.0)).alias("q"), unit(text).alias("u"), package_grams(text).alias("package"), density(food).alias("density"), size.alias("size"), taste.alias("taste"))
    known = pairs.select(*wanted, F.inline(F.array(parts)))
    mass, volume, one = literal_map(MASS_G)[F.col("u")], literal_map(VOLUME_ML)[F.col("u")], F.col("piece")
    ways = {
        "to_taste": F.when(F.col("taste"), 1.0),
        "package": F.col("package"),
        "mass": F.col("q") * mass,
        "volume": F.col("q") * volume * F.col("density"),
        "sized_piece": F.when(F.col("size") != "", F.col("q") * one * literal_map(SIZE_FACTOR)[F.col("size")]),
        "piece": F.col("q") * one,
    }
    each = known.select(*(F.col(n).alias(f"grams__{n}") for n in wanted), F.inline(F.array(F.struct(*(value.alias(label) for label, value in ways.items())))))
    how = F.coalesce(*(F.when(F.col(label).isNotNull(), label) for label in ways), F.lit("none"))
    solved = each.select(*(f"grams__{n}" for n in wanted), F.coalesce(*ways).alias("grams"), how.alias("how"))
    same = reduce(and_, (c.eqNullSafe(F.col(f"grams__{n}")) for n, c in wanted.items()))
    return rows.join(solved, same).drop(*(f"grams__{n}" for n in wanted))


def confidence(how: Column, inferred: Column) -> Column:
    """A score from 0 to 1 by how grams were found, less 0.15 if anything was inferred."""
    base = literal_map({"mass": 1.0, "package": 0.95, "volume": 0.85, "sized_piece": 0.7, "piece": 0.65, "to_taste": 0.5, "none": 0.0})[how]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - F.when(inferred, 0.15).otherwise(0.0)))


def split_line(line: Column) -> tuple[Column, Column]:
    """(measurement, name) of an ingredient line: a leading amount, package and unit words, then the rest."""
    units = "|".join(sorted([*MASS_G, *VOLUME_ML, "can", "clove", "slice", "pinch", "bunch", "packet"], key=len, reverse=True))
    rx = rf"(?i)^\s*((?:\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?(?:\s*(?:-|x|to)\s*\d+(?:\.\d+)?)?)?\s*(?:\([^)]*\)\s*)?(?:(?:{units})s?\b\.?\s*)*)(?:of\s+)?(.*)$"
    clean = T.squeezed(T.plain_fractions(line))
    return F.trim(F.regexp_extract(clean, rx, 1)), F.trim(F.regexp_extract(clean, rx, 2))
