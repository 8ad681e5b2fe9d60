"""Queries: component swaps and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.operators import adapt as A
from mirepoix.operators import rollup
from mirepoix.operators.report import top_n
from mirepoix.plans.registry import query
from mirepoix.plans.tables import LINES, lines, steady, table


def _candidates(spark, sf_dir):
    """(food_id, substitute, fat_g, salt_g): each food by the two that follow it."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("food_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    rows = part.select("food_id", (F.col("food_id") + F.col("step")).alias("substitute"))
    return rows.select("food_id", "substitute", (F.col("substitute") % 10).cast("double").alias("fat_g"), (F.col("substitute") % 7 / 10).alias("salt_g"))


_SWAPS = f"""{LINES}, c AS (SELECT p_partkey AS food_id, p_partkey + step AS substitute, CAST((p_partkey + step) % 10 AS DOUBLE) AS cfat, (p_partkey + step) % 7 / 10 AS csalt FROM part, (SELECT unnest([1, 2]) AS step)),
parts AS (SELECT item_id, food_id, sum(weight_g) AS w, sum(weight_g / 100 * fat_g) AS fat, sum(weight_g / 100 * salt_g) AS salt FROM lines GROUP BY ALL), totals AS (SELECT item_id, sum(fat) AS fat_before, sum(salt) AS salt_before FROM parts GROUP BY item_id),
swaps AS (SELECT item_id, food_id, substitute, fat, fat_before, salt_before, fat_before - fat + w / 100 * cfat AS fat_after, salt_before - salt + w / 100 * csalt AS salt_after FROM parts JOIN c USING (food_id) JOIN totals USING (item_id))"""


def _swaps(spark, sf_dir):
    return A.swapped(lines(spark, sf_dir), _candidates(spark, sf_dir), "item_id", "food_id", "weight_g", ["fat_g", "salt_g"])


@query("swap_simulation", f"WITH {_SWAPS} SELECT item_id, food_id, substitute, floor(fat_before * 1000 + 0.3) / 1000 AS fat_before, floor(fat_after * 1000 + 0.3) / 1000 AS fat_after, floor(salt_after * 1000 + 0.3) / 1000 AS salt_after FROM swaps WHERE item_id % 4 >= 0")
def swap_simulation(spark, sf_dir):
    return _swaps(spark, sf_dir).select("item_id", "food_id", "substitute", *(steady(F.col(f"fat_g_{x}"), 3).alias(f"fat_{x}") for x in ("before", "after")), steady(F.col("salt_g_after"), 3).alias("salt_after"))


@query(
    "swap_suggestions",
    f"""WITH {_SWAPS}, ok AS (SELECT *, round(fat_before - fat_after, 6) AS saved FROM swaps WHERE fat_before - fat_after >= 0.1 * fat_before + 0.00001 AND salt_after <= salt_before + 0.00001),
r AS (SELECT item_id, food_id, substitute, CAST(row_number() OVER (PARTITION BY item_id ORDER BY saved DESC, food_id, substitute) AS INT) AS suggestion FROM ok) SELECT * FROM r WHERE suggestion <= 3""",
)
def swap_suggestions(spark, sf_dir):
    saved = F.round(F.col("fat_g_before") - F.col("fat_g_after"), 6)
    gates = [F.col("fat_g_before") - F.col("fat_g_after") >= 0.1 * F.col("fat_g_before") + 0.00001, F.col("salt_g_after") <= F.col("salt_g_before") + 0.00001]
    good = A.improving(_swaps(spark, sf_dir), gates).withColumn("saved", saved)
    return A.ranked(good, "item_id", [F.desc("saved"), F.col("food_id"), F.col("substitute")], 3).select("item_id", "food_id", "substitute", "suggestion")


@query(
    "first_viable_offender",
    f"""WITH {_SWAPS}, o AS (SELECT item_id, food_id, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(weight_g / 100 * fat_g), 6) DESC, food_id) AS offender FROM lines GROUP BY item_id, food_id), v AS (SELECT s.item_id, food_id, substitute, offender, min(offender) OVER (PARTITION BY item_id) AS least FROM swaps s JOIN o USING (item_id, food_id) WHERE fat_after < fat_before * 0.9 - 0.00001)
SELECT item_id, food_id, substitute, CAST(offender AS INT) AS offender FROM v WHERE offender = least""",
)
def first_viable_offender(spark, sf_dir):
    sums = lines(spark, sf_dir).groupBy("item_id", "food_id").agg(F.round(F.sum(F.col("weight_g") / 100 * F.col("fat_g")), 6).alias("fat"))
    offenders = rollup.contribution_shares(sums, "item_id", "fat", ["food_id"]).select("item_id", "food_id", F.col("contribution_rank").alias("offender"))
    viable = A.improving(_swaps(spark, sf_dir), [F.col("fat_g_after") < F.col("fat_g_before") * 0.9 - 0.00001]).join(offenders, ["item_id", "food_id"])
    return A.first_viable(viable, "item_id", "offender").select("item_id", "food_id", "substitute", "offender")


@query(
    "smallest_reduction",
    f"""WITH {LINES}, t AS (SELECT item_id, sum(weight_g / 100 * fat_g) AS fat, max(weight_g / 100 * fat_g) AS top FROM lines GROUP BY item_id), s AS (SELECT item_id, kept, fat - top * (1 - kept) AS reduced, fat FROM t, (SELECT unnest([0.7, 0.5, 0.3]::DOUBLE[]) AS kept))
SELECT item_id, max(kept) AS kept FROM s WHERE reduced < 0.85 * fat - 0.00001 GROUP BY item_id""",
)
def smallest_reduction(spark, sf_dir):
    fat = F.col("weight_g") / 100 * F.col("fat_g")
    totals = lines(spark, sf_dir).groupBy("item_id").agg(F.sum(fat).alias("fat"), F.max(fat).alias("top"))
    return A.smallest_reduction(totals, "item_id", [0.7, 0.5, 0.3], F.col("fat") - F.col("top") * (1 - F.col("kept")), F.col("reduced") < 0.85 * F.col("fat") - 0.00001)


@query(
    "target_measure",
    f"""WITH {LINES}, t AS (SELECT item_id, sum(weight_g / 100 * fat_g) / sum(weight_g) * 100 AS fat, sum(weight_g / 100 * salt_g) / sum(weight_g) * 100 AS salt FROM lines GROUP BY item_id), u AS (SELECT item_id, 'fat' AS measure, CAST(floor(fat + 0.0001) AS INT) AS points FROM t UNION ALL SELECT item_id, 'salt', CAST(floor(salt * 12 + 0.0001) AS INT) FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY points DESC, measure) AS nth FROM u WHERE points >= 3) SELECT item_id, measure, points FROM r WHERE nth = 1""",
)
def target_measure(spark, sf_dir):
    totals = rollup.weighted_totals(lines(spark, sf_dir), "item_id", "weight_g", ["fat_g", "salt_g"])
    per = lambda m: F.col(m) / F.col("total_weight_g") * 100
    wide = totals.select("item_id", F.floor(per("fat_g") + 0.0001).cast("int").alias("fat"), F.floor(per("salt_g") * 12 + 0.0001).cast("int").alias("salt"))
    long = wide.unpivot(["item_id"], ["fat", "salt"], "measure", "points").where("points >= 3")
    return top_n(long, ["item_id"], [F.desc("points"), F.col("measure")], 1).drop("nth")


@query("curated_wins_merge", "WITH u AS (SELECT p_brand AS src, p_name AS name, 0 AS pri FROM part WHERE p_size > 40 UNION ALL SELECT p_brand, p_name, 1 FROM part WHERE p_size <= 10) SELECT src, lower(name) AS name, min(pri) AS pri FROM u GROUP BY 1, 2")
def curated_wins_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    curated = part.where("p_size > 40").select(F.col("p_brand").alias("src"), F.lower("p_name").alias("name"), F.lit(0).alias("pri"))
    derived = part.where("p_size <= 10").select(F.col("p_brand").alias("src"), F.lower("p_name").alias("name"), F.lit(1).alias("pri"))
    return curated.unionByName(derived).groupBy("src", "name").agg(F.min("pri").alias("pri"))


@query("new_flags_difference", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: NOT list_contains(string_split('red ring ' || lower(p_brand), ' '), x)))), ',') AS added FROM part")
def new_flags_difference(spark, sf_dir):
    have, old = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "), F.split(F.concat(F.lit("red ring "), F.lower("p_brand")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(F.array_except(have, old)), ",").alias("added"))
