"""Queries: a taxonomy of any depth with a cycle, groups and allergens that foods have from it, statuses set by id or condition."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.functions import rules as R
from mirepoix.operators import graph, merge
from mirepoix.plans.registry import query
from mirepoix.plans.rules import _has
from mirepoix.plans.tables import table
from mirepoix.plans.weights import _N, FOODS, _food, _list

# each part is under that of half its key; the first is under the third again
_EDGES = "edges AS (SELECT DISTINCT p_partkey AS c, CASE p_partkey WHEN 1 THEN 3 ELSE p_partkey // 2 END AS p FROM part WHERE p_partkey >= 1)"
_CLOSED = f"""{_EDGES}, walk AS (SELECT n AS "desc", n AS anc, 0 AS depth FROM (SELECT c AS n FROM edges UNION SELECT p FROM edges) UNION SELECT walk."desc", p, depth + 1 FROM walk JOIN edges ON anc = c WHERE depth < 40),
closed AS (SELECT "desc", anc, min(depth) AS depth FROM walk GROUP BY ALL)"""
GROUPS = {4: "dairy", 9: "dairy", 5: "grains", 12: "fruit", 13: "meat", 7: "sweets"}
ROOTS = {8: "milk", 10: "egg", 11: "celery", 14: "fish", 18: "milk"}


def _closed(spark, sf_dir):
    key = F.col("p_partkey")
    edges = table(spark, sf_dir, "part").where("p_partkey >= 1").select(key.alias("c"), F.when(key == 1, 3).otherwise(F.floor(key / 2)).cast("long").alias("p"))
    return graph.reachable(edges, "c", "p")


@query("deep_closure", f'WITH RECURSIVE {_CLOSED} SELECT "desc", anc, depth FROM closed')
def deep_closure(spark, sf_dir):
    return _closed(spark, sf_dir)


@query(
    "food_group_evidence",
    f"""WITH RECURSIVE {_CLOSED}, g(anc, grp) AS (VALUES {", ".join(f"({a}, '{g}')" for a, g in GROUPS.items())}), n AS (SELECT DISTINCT "desc" AS food_id, anc, grp FROM closed JOIN g USING (anc)),
m AS (SELECT DISTINCT l_orderkey AS item_id, l_partkey AS food_id FROM lineitem)
SELECT item_id, grp AS food_group, 'taxonomy_derived' AS method, array_to_string(list_sort(list(DISTINCT anc)), ',') AS classes, count(DISTINCT food_id) AS n_foods FROM m JOIN n USING (food_id) GROUP BY item_id, grp""",
)
def food_group_evidence(spark, sf_dir):
    groups = spark.createDataFrame(list(GROUPS.items()), "anc long, group string")
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("food_id"))
    found = graph.derived_groups(members, _closed(spark, sf_dir), groups, "item_id", "food_id")
    return found.select("item_id", F.col("evidence.value").alias("food_group"), "evidence.method", F.array_join("evidence.classes", ",").alias("classes"), F.size("evidence.nodes").cast("long").alias("n_foods"))


_KEYWORDS = ["celery", "egg", "fish", "milk", "soy"]


@query(
    "allergen_evidence_merged",
    f"""WITH RECURSIVE {_CLOSED}, r(anc, label) AS (VALUES {", ".join(f"({a}, '{g}')" for a, g in ROOTS.items())}), named AS (SELECT p_partkey AS node, p_name || ' ' || {_list(FOODS)}[p_partkey % {_N} + 1] AS name FROM part),
e AS (SELECT "desc" AS node, label, 'taxonomy' AS source, anc::VARCHAR AS term FROM closed JOIN r USING (anc) JOIN part ON p_partkey = "desc" UNION ALL {" UNION ALL ".join(f"SELECT node, '{a}', 'keyword', name FROM named WHERE {_has('name', a)}" for a in _KEYWORDS)})
SELECT node, label, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT term)), '; ') AS terms FROM e GROUP BY node, label""",
)
def allergen_evidence_merged(spark, sf_dir):
    roots = spark.createDataFrame(list(ROOTS.items()), "anc long, label string")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.concat_ws(" ", "p_name", _food("p_partkey")).alias("name"))
    known = _closed(spark, sf_dir).join(roots, "anc").select(F.col("desc").alias("node"), "label", F.lit("taxonomy").alias("source"), F.col("anc").cast("string").alias("term"))
    told = part.select("node", "name", F.explode(F.array_intersect(R.allergens(F.col("name")), F.array(*map(F.lit, _KEYWORDS)))).alias("label")).select("node", "label", F.lit("keyword").alias("source"), F.col("name").alias("term"))
    merged = graph.merged_evidence(known.join(part.select("node").hint("merge"), "node", "left_semi"), told)
    return merged.select("node", "label", F.array_join("sources", ",").alias("sources"), F.array_join("terms", "; ").alias("terms"))


_STATUS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'disabled' WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'active' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'old' END AS reason FROM orders"


@query(
    "disabled_with_counts",
    f"""WITH r AS ({_STATUS}), a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice < 50000 UNION SELECT o_orderkey + 100000000 FROM orders WHERE o_orderkey % 11 = 0),
j AS (SELECT CASE WHEN o_orderkey IS NULL THEN 'not_found' WHEN k IS NULL THEN 'kept' WHEN coalesce(status, 'active') = 'disabled' THEN 'unchanged' ELSE 'updated' END AS outcome, o_orderkey, status, reason FROM r FULL JOIN a ON k = o_orderkey)
SELECT outcome, CASE outcome WHEN 'updated' THEN 'disabled' WHEN 'not_found' THEN NULL ELSE coalesce(status, 'active') END AS status, CASE outcome WHEN 'updated' THEN 'cheap' ELSE reason END AS reason, count(*) AS n FROM j GROUP BY ALL""",
)
def disabled_with_counts(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = orders.select("o_orderkey", F.when(key % 5 == 0, "disabled").when(key % 5 != 1, "active").alias("status"), F.when(key % 5 == 0, "old").alias("reason"))
    asked = orders.where("o_totalprice < 50000").select("o_orderkey").union(orders.where("o_orderkey % 11 = 0").select(key + 100000000))
    return merge.with_status(rows, asked, "o_orderkey", "disabled", "cheap").groupBy("outcome", "status", "reason").agg(F.count("*").alias("n"))
