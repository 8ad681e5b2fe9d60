"""One composition data set from several: columns mapped to common nutrients, groups dropped, values coerced, sums and derived values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirepoix.functions import text as T

# Micrograms of retinol and of beta-carotene in an international unit of vitamin A, the digits kept.
RETINOL, CAROTENE, VITAMIN_A = "Retinol", "Carotene, beta", "Vitamin A, IU"
RETINOL_UG, CAROTENE_UG, IU_DIGITS, SUM_DIGITS = 0.3, 0.6, 2, 4
ABSENT = ["na", "n/a"]


def measured(text: Column) -> Column:
    """The finite number in a cell; null for traces, unknown and empty ones. "<" and ">" before it are left out."""
    plain = F.trim(F.regexp_replace(F.trim(text), r"^[<>]\s*", ""))
    number = F.when(~F.lower(F.trim(text)).isin(ABSENT), T.coerced_number(plain))
    return T.once(number, lambda n: F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n))


def assembled(sheets: Sequence[tuple[str, DataFrame, Sequence[str]]], source: str) -> DataFrame:
    """(source, code, food_name, food_group, column, value, unit, position) of wide sheets of one source, for `composite`.

    sheets: (name, rows of code, food_name, food_group and position, the value columns). The first sheet tells which
    foods there are, with name and group; rows of other sheets without a food there are left out. Of repeated codes in
    a sheet the row of the least position counts, then of the least values. Columns are called sheet::column.
    """
    first = lambda rows, columns: rows.where("code is not null").groupBy("code").agg(F.min(F.struct("position", "food_name", "food_group", *columns)).alias("r"))
    foods, out = None, None
    for name, rows, columns in sheets:
        one = first(rows, columns)
        foods = one.select("code", "r.food_name", "r.food_group") if foods is None else foods
        cells = F.array(*(F.struct(F.lit(f"{name}::{c}").alias("column"), F.col(f"r.{c}").cast("string").alias("value")) for c in columns))
        long = one.select("code", F.inline(cells)).join(foods, "code")
        out = long if out is None else out.unionByName(long)
    return out.select(F.lit(source).alias("source"), F.col("code").cast("string").alias("code"), "food_name", "food_group", "column", "value", F.lit("").alias("unit"), F.lit(0).cast("long").alias("position"))


def composite(rows: DataFrame, mapping: DataFrame, dropped: DataFrame, sums: Sequence[tuple[str, str, str]] = (), parts: int | None = None) -> DataFrame:
    """(id, food_name, source, food_group, nutrients): foods of all sources with a map of nutrient to (unit, value, source_code).

    rows: (source, code, food_name, food_group, column, value as text, unit, position); mapping: (source, column, key,
    unit, nth); dropped: (source, food_group), the groups to leave out. A cell without a number, and a column without a
    mapping or key, give nothing; a mapping without a unit keeps the cell's, with µ as u. Of several cells for one key
    the one of the largest nth counts, then of the largest position, column, value and unit. sums: (source, key,
    other): other is added to key where both are there in one unit, and stays. Vitamin A in international units is
    worked out from retinol and beta-carotene over what a source says. Foods without a name or any nutrient are left
    out. id is source:code; a food's name and group are those of its least position. parts: into how many parts the
    cells are dealt by food; without it, as the session says.
    """
    kept = rows.join(dropped.select("source", "food_group").distinct(), ["source", "food_group"], "left_anti").withColumn("value", measured(F.col("value")))
    named = mapping.where("key is not null and key != ''").select("source", "column", "key", F.nullif("unit", F.lit("")).alias("unit__"), "nth")
    unit = F.coalesce("unit__", F.trim(F.translate(F.coalesce("unit", F.lit("")), "µμ", "uu")))
    cells = kept.where("value is not null").join(named, ["source", "column"]).select("source", "code", "key", "column", "value", unit.alias("unit"), "nth", "position", "food_name", "food_group")
    cells = cells.repartition(parts, "source", "code") if parts else cells
    # a food's cells meet twice, first by key and then by food: both are bounded by the number of keys
    each = cells.groupBy("source", "code", "key").agg(
        F.max_by(F.struct("unit", "value", F.col("column").alias("source_code")), F.struct("nth", "position", "column", "value", "unit")).alias("cell"),
        F.min(F.struct("position", F.trim("food_name").alias("food_name"), F.nullif(F.trim("food_group"), F.lit("")).alias("food_group"))).alias("food"),
    )
    foods = each.groupBy("source", "code").agg(F.min("food").alias("food"), F.map_from_entries(F.collect_list(F.struct("key", "cell"))).alias("nutrients"))
    found = foods.where("food.food_name is not null and food.food_name != ''").select(F.concat_ws(":", "source", "code").alias("id"), "food.food_name", "source", "food.food_group", "nutrients")
    for source, key, other in sums:
        found = found.withColumn("nutrients", F.when(F.col("source") == source, T.once(F.col("nutrients"), lambda n: _summed(n, key, other))).otherwise(F.col("nutrients")))
    return found.withColumn("nutrients", T.once(F.col("nutrients"), _with_vitamin_a))


def _put(nutrients: Column, key: str, unit: Column, value: Column, source_code: Column, when: Column) -> Column:
    cell = F.struct(unit.alias("unit"), value.alias("value"), source_code.alias("source_code"))
    others: Callable[[Column, Column], Column] = lambda k, _: k != key
    return F.when(when, F.map_concat(F.map_filter(nutrients, others), F.create_map(F.lit(key), cell))).otherwise(nutrients)


def _summed(nutrients: Column, key: str, other: str) -> Column:
    a, b = nutrients[key], nutrients[other]
    both = a.isNotNull() & b.isNotNull() & (a["unit"] == b["unit"])
    return _put(nutrients, key, a["unit"], F.bround(a["value"] + b["value"], SUM_DIGITS), F.concat_ws("+", a["source_code"], b["source_code"]), F.coalesce(both, F.lit(False)))


def _with_vitamin_a(nutrients: Column) -> Column:
    retinol, carotene = nutrients[RETINOL]["value"], nutrients[CAROTENE]["value"]
    value = F.bround(F.coalesce(retinol, F.lit(0.0)) / RETINOL_UG + F.coalesce(carotene, F.lit(0.0)) / CAROTENE_UG, IU_DIGITS)
    return _put(nutrients, VITAMIN_A, F.lit("IU"), value, F.lit("computed_from_retinol+beta_carotene"), retinol.isNotNull() | carotene.isNotNull())
