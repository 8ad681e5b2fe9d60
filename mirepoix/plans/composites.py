"""Queries: one composition data set from three sources of cells, and how well its nutrients are covered."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.operators import composite as C
from mirepoix.plans.registry import query
from mirepoix.plans.tables import parts, steady, table

SOURCES = ["fr", "uk", "nl"]
MAPPING = [  # (column, key, unit, nth) of all sources; "uk" has no column 7
    ("c1", "Retinol", "ug", 1), ("c2", "Carotene, beta", None, 2), ("c3", "Protein", "g", 3), ("c4", "Lutein + zeaxanthin", "ug", 4), ("c5", "Zeaxanthin", "ug", 5), ("c6", None, "g", 6), ("c7", "Protein", "g", 7),
]
DROPPED = [("uk", "Brand#13"), ("nl", "Brand#5"), ("nl", None)]

_NULL = lambda x: "NULL" if x is None else f"'{x}'"
_CELLS = f"""cells AS (SELECT ['fr', 'uk', 'nl'][l_suppkey % 3 + 1] AS source, p_partkey AS code, p_name AS food_name, p_brand AS food_group, 'c' || l_linenumber AS col, l_orderkey * 10 + l_linenumber AS pos,
  CASE WHEN l_orderkey % 11 IN (0, 1, 2) THEN NULL ELSE l_quantity / 4 END AS value FROM lineitem JOIN part ON l_partkey = p_partkey),
m(col, k, unit, nth) AS (VALUES {", ".join(f"('{c}', {_NULL(k)}, {_NULL(u)}, {n})" for c, k, u, n in MAPPING)}), dropped(source, food_group) AS (VALUES {", ".join(f"('{s}', {_NULL(g)})" for s, g in DROPPED)}),
one AS (SELECT source, code, food_name, food_group, k, coalesce(unit, 'ug') AS unit, value, col FROM (SELECT *, row_number() OVER (PARTITION BY source, code, k ORDER BY nth DESC, pos DESC, col DESC, value DESC) AS r FROM cells c JOIN m USING (col)
  WHERE value IS NOT NULL AND k IS NOT NULL AND NOT (source = 'uk' AND col = 'c7') AND NOT EXISTS (SELECT 1 FROM dropped d WHERE d.source = c.source AND d.food_group = c.food_group)) WHERE r = 1),
lz AS (SELECT a.source, a.code, a.food_name, a.food_group, a.k, a.unit, CASE WHEN z.value IS NOT NULL THEN round_even(a.value + z.value, 4) ELSE a.value END AS value, CASE WHEN z.value IS NOT NULL THEN a.col || '+' || z.col ELSE a.col END AS col
  FROM one a LEFT JOIN one z ON a.source = 'nl' AND a.k = 'Lutein + zeaxanthin' AND z.k = 'Zeaxanthin' AND z.source = a.source AND z.code = a.code),
iu AS (SELECT source, code, any_value(food_name) AS food_name, any_value(food_group) AS food_group, 'Vitamin A, IU' AS k, 'IU' AS unit, round_even(coalesce(max(CASE k WHEN 'Retinol' THEN value END), 0) / 0.3::DOUBLE + coalesce(max(CASE k WHEN 'Carotene, beta' THEN value END), 0) / 0.6::DOUBLE, 2) AS value,
  'computed_from_retinol+beta_carotene' AS col FROM lz WHERE k IN ('Retinol', 'Carotene, beta') GROUP BY source, code),
allof AS (SELECT * FROM lz UNION ALL SELECT * FROM iu)"""


def _composite(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    number = (F.col("l_quantity") / 4).cast("string")
    forms = [F.lit("Tr"), F.lit(" n/a"), F.lit("-"), F.concat(F.lit("< "), number), F.replace(number, F.lit("."), F.lit(","))]
    value = F.coalesce(F.try_element_at(F.array(*forms), (F.col("l_orderkey") % 11 + 1).cast("int")), number)
    n = parts(spark, sf_dir, "lineitem")
    rows = line.repartition(n, "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("source"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("food_name"), F.col("p_brand").alias("food_group"),
        F.concat(F.lit("c"), "l_linenumber").alias("column"), value.alias("value"), F.lit("µg").alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
    )
    mapping = spark.createDataFrame([(s, *m) for s in SOURCES for m in MAPPING if (s, m[0]) != ("uk", "c7")], "source string, column string, key string, unit string, nth int")
    return C.composite(rows, mapping, spark.createDataFrame(DROPPED, "source string, food_group string"), [("nl", "Lutein + zeaxanthin", "Zeaxanthin")], n)


@query("composite_foods", f"WITH {_CELLS} SELECT source || ':' || code AS id, food_name, source, food_group, k AS nutrient, unit, floor(value * 100 + 0.3) / 100 AS value, col AS source_code FROM allof")
def composite_foods(spark, sf_dir):
    rows = _composite(spark, sf_dir).select("id", "food_name", "source", "food_group", F.explode("nutrients").alias("nutrient", "cell"))
    return rows.select("id", "food_name", "source", "food_group", "nutrient", "cell.unit", steady(F.col("cell.value"), 2).alias("value"), "cell.source_code")


@query("composite_coverage", f"WITH {_CELLS}, f AS (SELECT source, count(DISTINCT code) AS n_foods FROM allof GROUP BY source) SELECT source, k AS nutrient, count(*) AS n, n_foods FROM allof JOIN f USING (source) GROUP BY ALL")
def composite_coverage(spark, sf_dir):
    foods = _composite(spark, sf_dir)
    each = foods.select("source", F.explode(F.map_keys("nutrients")).alias("nutrient")).groupBy("source", "nutrient").agg(F.count("*").alias("n"))
    return each.join(foods.groupBy("source").agg(F.count("*").alias("n_foods")), "source")
