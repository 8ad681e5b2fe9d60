"""Queries: the first substitute of each item's heaviest component, and the item profiled again with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.functions import scoring
from mirepoix.operators import adapt, graph
from mirepoix.operators.rollup import best_row
from mirepoix.plans.nutrition import _sql_grade, _sql_points
from mirepoix.plans.registry import query
from mirepoix.plans.tables import LINES, lines, steady, table

MEASURES = ["energy_kcal", "fat_g", "salt_g"]

# curated substitutes: of every third size the parts that follow by one and two; else siblings by brand, then by type
_FIRST = """up AS (SELECT DISTINCT p_partkey AS food_id, 'brand ' || p_brand AS grp, 1 AS distance FROM part UNION SELECT a.p_partkey, 'type ' || b.p_type, 2 FROM part a JOIN part b USING (p_brand)),
shared AS (SELECT * FROM up JOIN (SELECT grp FROM up GROUP BY grp HAVING count(DISTINCT food_id) > 1) USING (grp)), near AS (SELECT food_id, arg_min(grp, (distance, grp)) AS grp FROM shared GROUP BY food_id),
curated AS (SELECT food_id, min(s) AS substitute FROM (SELECT p_partkey AS food_id, unnest([p_partkey + 1, p_partkey + 2]) AS s FROM part WHERE p_size % 3 = 0) JOIN part ON p_partkey = s GROUP BY food_id),
two AS (SELECT grp, list_sort(list(DISTINCT food_id)) AS m FROM shared GROUP BY grp), siblings AS (SELECT food_id, CASE WHEN m[1] <> food_id THEN m[1] ELSE m[2] END AS substitute FROM near JOIN two USING (grp)),
subs AS (SELECT p_partkey AS food_id, coalesce(c.substitute, s.substitute) AS substitute, CASE WHEN c.substitute IS NOT NULL THEN 'curated' ELSE 'taxonomy' END AS source FROM part LEFT JOIN curated c ON c.food_id = p_partkey LEFT JOIN siblings s ON s.food_id = p_partkey WHERE coalesce(c.substitute, s.substitute) IS NOT NULL)"""


def _first(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    food = F.col("p_partkey").alias("food_id")
    both = part.where("p_size % 3 = 0").select(food, F.explode(F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 2)).alias("substitute"))
    curated = both.join(part.select(F.col("p_partkey").alias("substitute")), "substitute", "left_semi").withColumn("rank", F.col("substitute"))
    node = F.col("p_partkey").cast("string")
    brand, kind = F.concat(F.lit("brand "), "p_brand"), F.concat(F.lit("type "), "p_type")
    edges = part.select(node.alias("c"), brand.alias("p")).union(part.select(brand, kind))
    found = graph.first_sibling(part.select(food), "food_id", graph.closure(edges, "c", "p", 2).where("depth > 0").select(F.col("desc").try_cast("long").alias("desc"), "anc", "depth").where("desc is not null"), 2)
    return adapt.first_substitutes([("curated", curated), ("taxonomy", found.withColumnRenamed("sibling", "substitute"))], "food_id")


@query("first_substitutes", f"WITH {_FIRST} SELECT * FROM subs")
def first_substitutes(spark, sf_dir):
    return _first(spark, sf_dir)


def _points(prefix: str) -> str:
    value = lambda x, factor: f"round({prefix}_{x} * {factor}, 6)"
    return f"({_sql_points(value('energy', 4.184 / 4), scoring.ENERGY_KJ)} + {_sql_points(value('fat', 1), scoring.SATURATED_G)} + {_sql_points(value('salt', 50), scoring.SODIUM_MG)})"


_OWN = ", ".join(f"sum(weight_g / 100 * {m}) / sum(weight_g) * 100 AS b_{m.split('_')[0]}" for m in MEASURES)
_NEW = ", ".join(f"sum(weight_g / 100 * {m}) AS t_{m.split('_')[0]}, sum(weight_g / 100 * {m}) / sum(weight_g) * 100 AS a_{m.split('_')[0]}" for m in MEASURES)
_SUBSTITUTED = f"""{LINES}, {_FIRST}, f AS (SELECT p_partkey AS substitute, p_retailprice / 4 AS energy, p_size / 2.0 AS fat, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 7 / 10 END AS salt FROM part),
w AS (SELECT item_id, food_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight_g DESC, position, food_id) AS nth FROM lines) WHERE nth = 1), swaps AS (SELECT * FROM w JOIN subs USING (food_id)),
n AS (SELECT l.item_id, position, coalesce(substitute, l.food_id) AS food_id, weight_g, CASE WHEN substitute IS NULL THEN energy_kcal ELSE coalesce(energy, 0) END AS energy_kcal, CASE WHEN substitute IS NULL THEN fat_g ELSE coalesce(fat, 0) END AS fat_g,
  CASE WHEN substitute IS NULL THEN salt_g ELSE coalesce(salt, 0) END AS salt_g, CASE WHEN substitute IS NOT NULL THEN l.food_id END AS replaces FROM lines l LEFT JOIN swaps s ON s.item_id = l.item_id AND s.food_id = l.food_id LEFT JOIN f USING (substitute))"""


def _substituted(spark, sf_dir):
    rows, part = lines(spark, sf_dir, placed=True), table(spark, sf_dir, "part")
    heaviest = best_row(rows, ["item_id"], [F.desc("weight_g"), F.col("position"), F.col("food_id")]).select("item_id", "food_id")
    swaps = heaviest.join(_first(spark, sf_dir), "food_id")
    key = F.col("p_partkey")
    foods = part.select(key.alias("substitute"), (F.col("p_retailprice") / 4).alias("energy_kcal"), (F.col("p_size") / 2.0).alias("fat_g"), F.when(key % 7 > 0, key % 7 / 10).alias("salt_g"))
    return rows, swaps, adapt.substituted(rows, swaps, foods, "item_id", "food_id", "weight_g", MEASURES)


@query("substituted_lines", f"WITH {_SUBSTITUTED} SELECT item_id, position, food_id, replaces, floor(weight_g / 100 * fat_g * 1000 + 0.3) / 1000 AS fat_total FROM n WHERE replaces IS NOT NULL")
def substituted_lines(spark, sf_dir):
    new = _substituted(spark, sf_dir)[2].where("replaces is not null")
    return new.select("item_id", "position", "food_id", "replaces", steady(F.col("weight_g") / 100 * F.col("fat_g"), 3).alias("fat_total"))


@query(
    "substituted_profiles",
    f"""WITH {_SUBSTITUTED}, b AS (SELECT item_id, {_OWN} FROM lines GROUP BY item_id), a AS (SELECT item_id, sum(weight_g) AS total_weight_g, {_NEW} FROM n GROUP BY item_id),
s AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 6 ELSE 1 END AS serves FROM orders), p AS (SELECT *, {_points('b')} AS score_before, {_points('a')} AS score_after FROM swaps JOIN a USING (item_id) JOIN b USING (item_id) LEFT JOIN s USING (item_id))
SELECT item_id, food_id, substitute, source, floor(t_energy / coalesce(serves, 1) * 1000 + 0.3) / 1000 AS kcal_per_serving, floor(a_fat * 1000 + 0.3) / 1000 AS fat_per_100g, floor(t_salt * 1000 + 0.3) / 1000 AS salt_g, score_before, score_after, {_sql_grade('score_before')} AS grade_before, {_sql_grade('score_after')} AS grade_after FROM p""",
)
def substituted_profiles(spark, sf_dir):
    rows, swaps, new = _substituted(spark, sf_dir)
    key = F.col("o_orderkey")
    serves = table(spark, sf_dir, "orders").select(key.alias("item_id"), (key % 6).alias("serves"))
    # rounded, as sums in another order may pass a threshold that they meet
    score = lambda: sum(scoring.points(F.round(F.col(f"{m}_per_100g") * f, 6), t) for m, f, t in zip(MEASURES, (scoring.KJ_PER_KCAL / 4, 1, 50), (scoring.ENERGY_KJ, scoring.SATURATED_G, scoring.SODIUM_MG)))
    before = adapt.reprofiled(rows, "item_id", "weight_g", MEASURES, serves, "place").select("item_id", score().alias("score_before"))
    after = adapt.reprofiled(new, "item_id", "weight_g", MEASURES, serves, "place").withColumn("score_after", score())
    found = swaps.join(after, "item_id").join(before, "item_id")
    grades = [scoring.grade(F.col(f"score_{x}")).alias(f"grade_{x}") for x in ("before", "after")]
    values = [steady(F.col("energy_kcal_per_serving"), 3).alias("kcal_per_serving"), steady(F.col("fat_g_per_100g"), 3).alias("fat_per_100g"), steady(F.col("salt_g"), 3).alias("salt_g")]
    return found.select("item_id", "food_id", "substitute", "source", *values, "score_before", "score_after", *grades)
