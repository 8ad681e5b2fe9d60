"""Queries: orders as meals of dishes, parts as dishes of foods, from wide sheets with numbered columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.operators import meals as M
from mirepoix.plans.registry import query
from mirepoix.plans.tables import table

# a part's foods: the names of its key's neighbours by columns; a meal's dishes: by its order, customer and price; some aren't there
_DISHES = """f AS (SELECT p_partkey AS dish, p_name || ' dish' AS dname, CASE WHEN p_size % 4 > 0 THEN 'cook ' || p_size END AS how, unnest([1, 2, 3]) AS pos,
  unnest([p_brand, CASE WHEN p_size % 3 > 0 THEN p_type END, p_name]) AS name, unnest([p_size || ' g', p_size || ',5ml', CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'some' END]) AS q, unnest([p_size + 0.0, NULL, CASE WHEN p_size % 2 = 0 THEN p_size + 0.0 END]) AS g FROM part),
i AS (SELECT * FROM f WHERE name IS NOT NULL)"""
_SLOTS = """s AS (SELECT o_orderkey AS meal, unnest([1, 2, 3]) AS position, unnest([CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END, o_orderkey % 500, CASE WHEN o_orderkey % 5 > 0 THEN floor(o_totalprice)::BIGINT % 300 ELSE -1 END]) AS dish FROM orders),
c AS (SELECT meal, position, dish, p_partkey IS NOT NULL AS found FROM s LEFT JOIN part ON p_partkey = dish WHERE dish IS NOT NULL)"""


def _dishes(spark, sf_dir):
    size = F.col("p_size").cast("string")
    wide = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("dish_id"), F.concat("p_name", F.lit(" dish")).alias("name"), F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("cook "), size)).otherwise("  ").alias("instructions"), F.lit(0).alias("row"),
        F.col("p_brand").alias("Food #1"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("Food #2"), F.col("p_name").alias("Food #3"),
        F.concat(size, F.lit(" g")).alias("Q"), F.concat(size, F.lit(",5ml")).alias("Q.1"), F.when(F.col("p_size") % 2 == 0, size).otherwise("some").alias("Q.2"), *(size.alias(f"ID{x}") for x in ("", ".1", ".2")),
    )
    return M.dishes(wide, [f"Food #{i}" for i in (1, 2, 3)], ["Q", "Q.1", "Q.2"], ["ID", "ID.1", "ID.2"])


def _components(spark, sf_dir):
    key = F.col("o_orderkey")
    wide = table(spark, sf_dir, "orders").select(
        key.alias("meal"), F.when(key % 7 > 0, F.col("o_custkey").cast("double")).cast("string").alias("ID.1"), (key % 500).cast("string").alias("ID.2"),
        F.when(key % 5 > 0, (F.floor("o_totalprice") % 300).cast("string")).otherwise("n.a.").alias("ID.3"), *(F.lit(f"dish {i}").alias(f"Dish #{i}") for i in (1, 2, 3)),
    )
    rows = M.slots(wide, ["meal"], {"dish_id": ["ID.1", "ID.2", "ID.3"], "dish_name": ["Dish #1", "Dish #2", "Dish #3"]})
    return M.components(rows, _dishes(spark, sf_dir), "meal")


@query("dish_ingredients", f"WITH {_DISHES} SELECT dish::DOUBLE AS dish_id, dname AS dish, how AS instructions, pos AS position, name, q AS measurement, g AS weight_g FROM i")
def dish_ingredients(spark, sf_dir):
    rows = _dishes(spark, sf_dir).select("dish_id", F.col("name").alias("dish"), "instructions", F.explode("ingredients").alias("i"))
    return rows.select("dish_id", "dish", "instructions", "i.position", "i.name", "i.measurement", "i.weight_g")


@query(
    "meal_components",
    f"""WITH {_DISHES}, {_SLOTS}, g AS (SELECT dish, any_value(dname) AS dname, any_value(how) AS how, count(*) AS n, sum(g) AS g, string_agg(name, ';' ORDER BY pos) AS names FROM i GROUP BY dish)
SELECT meal, count(*) FILTER (found) AS n_components, count(*) FILTER (NOT found) AS n_missing, coalesce(sum(n), 0)::BIGINT AS n_ingredients, coalesce(sum(g), 0) AS grams, coalesce(string_agg(names, ';' ORDER BY position) FILTER (found), '') AS names,
  coalesce(string_agg(dname || ': ' || how, '; ' ORDER BY position) FILTER (how IS NOT NULL), '') AS instructions FROM c LEFT JOIN g USING (dish) GROUP BY meal""",
)
def meal_components(spark, sf_dir):
    found = M.meals(_components(spark, sf_dir), "meal")
    grams = F.aggregate("ingredients", F.lit(0.0), lambda total, i: total + F.coalesce(i["weight_g"], F.lit(0.0)))
    sizes = [F.size(c).cast("long").alias(n) for c, n in (("components", "n_components"), ("missing", "n_missing"), ("ingredients", "n_ingredients"))]
    return found.select("meal", *sizes, grams.alias("grams"), F.array_join("ingredients.name", ";").alias("names"), F.array_join("instructions", "; ").alias("instructions"))
