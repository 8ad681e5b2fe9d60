"""Meals of dishes of foods: numbered columns of wide sheets as rows, references resolved, meals with their components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A quantity that is read, the unit of a bare number.
MEASUREMENT, BARE_UNIT = r"(?i)^\s*(\d+(?:[.,]\d+)?)\s*(g|ml)?\s*$", "g"


def blank_as_null(text: Column) -> Column:
    return F.nullif(F.trim(text.cast("string")), F.lit(""))


def measurement(text: Column) -> tuple[Column, Column]:
    """(quantity, unit) of "120 g", "1,5ml" or a bare number, which is grams; nulls for other text."""
    whole = F.coalesce(text, F.lit(""))
    number = F.replace(F.regexp_extract(whole, MEASUREMENT, 1), F.lit(","), F.lit(".")).try_cast("double")
    return number, F.when(number.isNotNull(), F.coalesce(F.nullif(F.lower(F.regexp_extract(whole, MEASUREMENT, 2)), F.lit("")), F.lit(BARE_UNIT)))


def slots(wide: DataFrame, keep: Sequence[str], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """(keep, position from 1, a column for each of `columns`): the i-th columns of each list as one row, blank text as null.

    All lists are equally long. A slot with nothing in it gives a row of nulls, for the caller to leave out.
    """
    cells = [F.struct(*(blank_as_null(F.col(f"`{names[i]}`")).alias(name) for name, names in columns.items())) for i in range(len(next(iter(columns.values()))))]
    return wide.select(*keep, F.posexplode(F.array(*cells)).alias("at__", "cell__")).select(*keep, (F.col("at__") + 1).alias("position"), "cell__.*")


def dishes(wide: DataFrame, names: Sequence[str], quantities: Sequence[str], foods: Sequence[str]) -> DataFrame:
    """(dish_id, name, instructions, ingredients): dishes with their ingredients, in the order of the columns.

    wide: (dish_id as text, name, instructions, row, and the numbered columns). Rows whose id is no number, or without
    a name, are no dishes; of repeated ids the last by row counts, then the largest. ingredients: (position,
    name, measurement, quantity, unit, weight_g, food_id); a slot without a name is none; weight_g of quantities in grams.
    """
    number = F.col("dish_id").try_cast("double")
    good = wide.withColumn("dish_id", F.when(~F.isnan(number), number)).withColumn("name", blank_as_null(F.col("name"))).where("dish_id is not null and name is not null")
    cells = [(blank_as_null(F.col(f"`{n}`")), blank_as_null(F.col(f"`{q}`")), blank_as_null(F.col(f"`{f}`"))) for n, q, f in zip(names, quantities, foods)]

    def ingredient(i: int) -> Column:
        name, text, food = cells[i]
        quantity, unit = measurement(text)
        weight = F.when(unit == "g", quantity)
        return F.when(name.isNotNull(), F.struct(F.lit(i + 1).alias("position"), name.alias("name"), text.alias("measurement"), quantity.alias("quantity"), unit.alias("unit"), weight.alias("weight_g"), food.alias("food_id")))

    ingredients = F.array_compact(F.array(*(ingredient(i) for i in range(len(cells)))))
    dish = F.struct("name", blank_as_null(F.col("instructions")).alias("instructions"), ingredients.alias("ingredients"))
    return good.groupBy("dish_id").agg(F.max(F.struct("row", dish.alias("dish"))).alias("d")).select("dish_id", "d.dish.*")


def components(meal_slots: DataFrame, dish_table: DataFrame, meal: str) -> DataFrame:
    """(meal, position, dish_id, source_name, dish): each named dish of a meal; dish is null where there is none of that id.

    meal_slots: (meal, position, dish_id as text, dish_name). A slot without an id is none; an id that is no number is
    missing like one that no dish has. The dishes are joined by number, so "7" and "7.0" are one.
    """
    asked = meal_slots.where("dish_id is not null").withColumn("number__", F.col("dish_id").try_cast("double"))
    known = dish_table.select(F.col("dish_id").alias("number__"), F.struct(F.col("name"), F.col("instructions"), F.col("ingredients")).alias("dish"))
    return asked.join(known, "number__", "left").select(meal, "position", "dish_id", F.col("dish_name").alias("source_name"), "dish")


def meals(found: DataFrame, meal: str) -> DataFrame:
    """(meal, components, ingredients, instructions, missing) of `components`, all by position; a meal has few slots.

    ingredients: those of all components, with the component's name; instructions: "name: text" of those that have any;
    missing: (dish_id, dish_name) of references without a dish. Meals without any reference have no row.
    """
    rows = found.groupBy(meal).agg(F.array_sort(F.collect_list(F.struct("position", "dish_id", "source_name", "dish"))).alias("all"))
    there, absent = F.filter("all", lambda c: c["dish"].isNotNull()), F.filter("all", lambda c: c["dish"].isNull())
    ingredients = F.flatten(F.transform(there, lambda c: F.transform(c["dish"]["ingredients"], lambda i: i.withField("component", c["dish"]["name"]))))
    instructions = F.transform(F.filter(there, lambda c: c["dish"]["instructions"].isNotNull()), lambda c: F.concat_ws(": ", c["dish"]["name"], c["dish"]["instructions"]))
    listed = F.transform(there, lambda c: F.struct(c["position"].alias("position"), c["dish_id"].alias("dish_id"), c["dish"]["name"].alias("name"), c["source_name"].alias("source_name")))
    return rows.select(meal, listed.alias("components"), ingredients.alias("ingredients"), instructions.alias("instructions"), F.transform(absent, lambda c: F.struct(c["dish_id"].alias("dish_id"), c["source_name"].alias("dish_name"))).alias("missing"))
