"""Queries: a plan of renames over the names of parts, its collisions, and lines under their final names."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.operators import renames
from mirepoix.plans.registry import query
from mirepoix.plans.tables import table

# a part's name and size: each size is renamed to its half, 48 and 49 to each other, 1 is final
_NEXT = "CASE p_size WHEN 48 THEN 49 WHEN 49 THEN 48 ELSE p_size // 2 END"
_RENAMES = f"""renames AS (SELECT old, min(new) AS new FROM (SELECT p_name || ' ' || p_size AS old, p_name || ' ' || {_NEXT} AS new FROM part WHERE p_size > 1) GROUP BY old),
edges AS (SELECT DISTINCT l_orderkey AS item_id, p_name || ' ' || p_size AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_PLAN = f"""{_RENAMES}, walk AS (SELECT old, new AS dest, 1 AS n FROM renames UNION ALL SELECT walk.old, renames.new, n + 1 FROM walk JOIN renames ON walk.dest = renames.old WHERE n < 70),
plan AS (SELECT r.old, w.dest AS final, CASE WHEN w.dest IS NULL THEN 'cycle' ELSE 'final' END AS status FROM renames r LEFT JOIN (SELECT old, dest FROM walk WHERE dest NOT IN (SELECT old FROM renames)) w ON w.old = r.old),
applied AS (SELECT item_id, coalesce(final, name) AS name, name AS was FROM edges LEFT JOIN plan ON old = name AND status = 'final')"""


def _edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_size").alias("name"))


def _plan(spark, sf_dir):
    size = F.when(F.col("p_size") == 48, 49).when(F.col("p_size") == 49, 48).otherwise(F.floor(F.col("p_size") / 2))
    part = table(spark, sf_dir, "part").where("p_size > 1")
    return renames.resolved(part.select(F.concat_ws(" ", "p_name", "p_size").alias("old"), F.concat_ws(" ", "p_name", size).alias("new")))


@query("rename_plan", f"WITH RECURSIVE {_PLAN}, used AS (SELECT name, count(*) AS n_items FROM edges GROUP BY name) SELECT old, final, status, coalesce(n_items, 0) AS n_items FROM plan LEFT JOIN used ON name = old")
def rename_plan(spark, sf_dir):
    used = _edges(spark, sf_dir).distinct().groupBy(F.col("name").alias("old")).agg(F.count("*").alias("n_items"))
    return _plan(spark, sf_dir).join(used, "old", "left").select("old", "final", "status", F.coalesce("n_items", F.lit(0)).alias("n_items"))


@query("rename_collisions", f"WITH RECURSIVE {_PLAN} SELECT item_id, name, count(*) AS n_names FROM applied GROUP BY ALL HAVING count(*) > 1")
def rename_collisions(spark, sf_dir):
    return renames.collisions(_edges(spark, sf_dir), _plan(spark, sf_dir), "item_id", "name")


@query("renamed_lines", f"WITH RECURSIVE {_PLAN} SELECT name, count(DISTINCT item_id) AS n_items, count(DISTINCT was) AS n_names FROM applied GROUP BY name")
def renamed_lines(spark, sf_dir):
    return renames.applied(_edges(spark, sf_dir), _plan(spark, sf_dir), "item_id", "name").groupBy("name").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("was").alias("n_names"))
