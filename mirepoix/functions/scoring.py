"""Point and grade expressions of nutrient profiles. All are null where their inputs are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirepoix.functions.text import once

# The published point tables for solid foods (a point for each threshold that is exceeded), each 100 g,
# and the grade cutoffs.
ENERGY_KJ = (335, 670, 1005, 1340, 1675, 2010, 2345, 2680, 3015, 3350)
SUGAR_G = (4.5, 9, 13.5, 18, 22.5, 27, 31, 36, 40, 45)
SATURATED_G = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
SODIUM_MG = (90, 180, 270, 360, 450, 540, 630, 720, 810, 900)
FIBRE_G = (0.9, 1.9, 2.8, 3.7, 4.7)
PROTEIN_G = (1.6, 3.2, 4.8, 6.4, 8.0)
FRUIT_PCT = (40, 60, 80, 80, 80)
GRADES = ((0, "A"), (2, "B"), (10, "C"), (18, "D"))
LAST_GRADE = "E"
COLOURS = {"A": "green", "B": "light green", "C": "yellow", "D": "orange", "E": "red"}
GRADE_VALUES = {"A": 1.0, "B": 0.75, "C": 0.5, "D": 0.25, "E": 0.0}
KJ_PER_KCAL = 4.184


def points(value: Column, thresholds: Sequence[float]) -> Column:
    """How many thresholds the value exceeds."""
    return sum(((value > t).cast("int") for t in thresholds), F.lit(0))


def score(energy_kj: Column, sugar: Column, saturated: Column, sodium: Column, fibre: Column, protein: Column, fruit: Column) -> Column:
    """Negative less positive points; protein doesn't count from 11 negative points on unless fruit has all five."""
    negative = points(energy_kj, ENERGY_KJ) + points(sugar, SUGAR_G) + points(saturated, SATURATED_G) + points(sodium, SODIUM_MG)
    fruits = points(fruit, FRUIT_PCT)
    proteins = F.when((negative >= 11) & (fruits < 5), 0).otherwise(points(protein, PROTEIN_G))
    return negative - points(fibre, FIBRE_G) - fruits - proteins


def grade(score: Column) -> Column:
    ladder = F.when(score.isNull(), None)
    for most, letter in GRADES:
        ladder = ladder.when(score <= most, letter)
    return ladder.otherwise(LAST_GRADE)


def colour(letter: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))[letter]


def grade_value(letter: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in GRADE_VALUES.items() for x in kv))[letter]


def grade_rank(label: Column) -> Column:
    """1 to 5 of A to E, or of a label that ends in one after an underscore; others null."""
    return F.nullif(F.instr(F.lit("ABCDE"), F.upper(F.substring_index(F.trim(label), "_", -1))), F.lit(0))


def per_100g(total: Column, weight_g: Column) -> Column:
    return F.when(weight_g > 0, total / weight_g * 100)


def per_serving(total: Column, serves: Column) -> Column:
    return F.when(serves > 0, total / serves)


def serves(parsed: Column, total_weight_g: Column) -> tuple[Column, Column]:
    """(serves, source): a given count from 1 to 50, else an estimate of 450 g a serving, at most 16; 4 beyond; 1 for none."""
    given = parsed.between(1, 50)
    weight = F.coalesce(total_weight_g, F.lit(0.0))
    estimate = F.when((weight > 0) & (weight <= 7200), F.greatest(F.lit(1.0), F.least(F.lit(16.0), F.bround(weight / 450)))).when(weight > 0, 4.0).otherwise(1.0)
    return F.when(given, F.bround(parsed)).otherwise(estimate), F.when(given, "given").otherwise("estimated")


def claims(kcal: Column, fat: Column, fibre: Column, protein: Column) -> Column:
    """The nutrition claims that values for each 100 g allow, in fixed order; a missing value allows none of its own."""
    energy = F.when(kcal > 0, kcal)
    return F.array_compact(
        F.array(
            F.when(kcal <= 40, "low_calorie"),
            F.when(fat <= 3, "low_fat"),
            F.when((fibre >= 6) | (fibre / energy * 100 >= 3), "high_fibre"),
            F.when(protein * 4 / energy >= 0.2, "high_protein"),
        )
    )


def label(serving_g: Column, energy_kj: Column, energy_kcal: Column, sugar: Column, saturated: Column, sodium: Column, fibre: Column, protein: Column) -> Column:
    """The grade of a label's values for one serving of a given weight; null without a weight or with a value missing.

    Energy in kJ is taken from kcal where it isn't given. Labels tell nothing of fruit, which counts as none.
    Values for 100 g are rounded to six digits, so that one that meets a threshold doesn't exceed it.
    """
    each = lambda value: F.round(value / serving_g * 100.0, 6)
    energy, others = F.coalesce(energy_kj, energy_kcal * KJ_PER_KCAL), (sugar, saturated, sodium, fibre, protein)
    whole = (serving_g > 0) & energy.isNotNull()
    for value in others:
        whole = whole & value.isNotNull()
    names = ["energy", "sugar", "saturated", "sodium", "fibre", "protein"]
    values = F.struct(*(each(value).alias(name) for name, value in zip(names, (energy, *others))))
    found = once(once(values, lambda v: score(*(v[name] for name in names), F.lit(0.0))), grade)
    return F.when(whole, found)
