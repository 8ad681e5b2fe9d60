"""Queries: graph predicates, taxonomies, suitability and edge rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.operators import graph
from mirepoix.plans.registry import query
from mirepoix.plans.tables import parts, table


def _foods(spark, sf_dir) -> DataFrame:
    """(item_id, food_id, name, food_class, brand, size) for each edge from an item to a food."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("food_id"), F.col("p_name").alias("name"), F.col("p_type").alias("food_class"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("food_id")).distinct()
    return edges.join(part, "food_id")


_FOODS = """foods AS (SELECT DISTINCT l_orderkey AS item_id, l_partkey AS food_id, p_name AS name, p_type AS food_class, p_brand AS brand, p_size AS size FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _taxonomy(spark, sf_dir) -> DataFrame:
    """(child, parent): foods under head nouns under classes under one root; brands under the root too."""
    part = table(spark, sf_dir, "part")
    head = F.concat(F.lit("head:"), F.element_at(F.split("p_name", " "), -1))
    kind = F.concat(F.lit("size:"), F.floor(F.col("p_size") / 20))
    food = F.concat(F.lit("food:"), "p_partkey")
    leaves = part.select(food.alias("child"), head.alias("parent")).union(part.select(food, kind))
    inner = part.select(head.alias("child"), F.lit("root").alias("parent")).union(part.select(kind, F.lit("root")))
    return leaves.union(inner).distinct()


_TAXONOMY = """taxonomy AS (SELECT 'food:' || p_partkey AS child, 'head:' || string_split(p_name, ' ')[-1] AS parent FROM part UNION SELECT 'food:' || p_partkey, 'size:' || (p_size // 20) FROM part
  UNION SELECT 'head:' || string_split(p_name, ' ')[-1], 'root' FROM part UNION SELECT 'size:' || (p_size // 20), 'root' FROM part),
closure AS (SELECT n AS "desc", n AS anc, 0 AS depth FROM (SELECT child AS n FROM taxonomy UNION SELECT parent FROM taxonomy)
  UNION SELECT child, parent, 1 FROM taxonomy UNION SELECT a.child, b.parent, 2 FROM taxonomy a JOIN taxonomy b ON a.parent = b.child)"""


@query("include_all_terms", f"WITH {_FOODS} SELECT item_id FROM foods GROUP BY item_id HAVING bool_or(contains(name, 'red')) AND bool_or(contains(name, 'bolt')) AND bool_or(size > 40)")
def include_all_terms(spark, sf_dir):
    return graph.having_all(_foods(spark, sf_dir), "item_id", [F.col("name").contains("red"), F.col("name").contains("bolt"), F.col("size") > 40])


@query("exclude_any_term", f"WITH {_FOODS} SELECT o_orderkey AS item_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM foods WHERE item_id = o_orderkey AND (contains(name, 'red') OR contains(name, 'ring')))")
def exclude_any_term(spark, sf_dir):
    bad = _foods(spark, sf_dir).where(F.col("name").contains("red") | F.col("name").contains("ring")).select("item_id")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")).join(bad, "item_id", "left_anti")


@query(
    "two_hop_exclusion",
    """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_orderkey = o_orderkey AND n_name IN ('NATION_3', 'NATION_7', 'CHINA', 'FRANCE') OR l_orderkey = o_orderkey AND n_nationkey < 4)""",
)
def two_hop_exclusion(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where(F.col("n_name").isin("NATION_3", "NATION_7", "CHINA", "FRANCE") | (F.col("n_nationkey") < 4))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_suppkey").alias("l_suppkey"))
    bad = table(spark, sf_dir, "lineitem").join(supplier, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(bad, "o_orderkey", "left_anti")


@query("all_tags_required", f"WITH {_FOODS} SELECT item_id FROM foods WHERE food_class IN (SELECT min(p_type) FROM part UNION SELECT max(p_type) FROM part) GROUP BY item_id HAVING count(DISTINCT food_class) = 2")
def all_tags_required(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tags = part.agg(F.min("p_type").alias("food_class")).union(part.agg(F.max("p_type")))
    hits = _foods(spark, sf_dir).join(tags, "food_class", "left_semi")
    return hits.select("item_id", "food_class").distinct().groupBy("item_id").count().where("count = 2").select("item_id")


@query("any_tag_semi", f"WITH {_FOODS} SELECT DISTINCT item_id FROM foods WHERE brand IN ('Brand#11', 'Brand#12', 'Brand#21')")
def any_tag_semi(spark, sf_dir):
    hits = _foods(spark, sf_dir).where(F.col("brand").isin("Brand#11", "Brand#12", "Brand#21")).select("item_id")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")).join(hits, "item_id", "left_semi")


@query("taxonomy_closure", f"WITH {_TAXONOMY} SELECT \"desc\", anc, min(depth) AS depth FROM closure GROUP BY ALL")
def taxonomy_closure(spark, sf_dir):
    return graph.closure(_taxonomy(spark, sf_dir), "child", "parent", 3)


@query(
    "ancestor_exclusion",
    f"WITH {_TAXONOMY}, bad AS (SELECT DISTINCT \"desc\" FROM closure WHERE contains(anc, 'bolt') OR anc = 'size:0') SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN bad ON \"desc\" = 'food:' || l_partkey WHERE l_orderkey = o_orderkey)",
)
def ancestor_exclusion(spark, sf_dir):
    closed = graph.closure(_taxonomy(spark, sf_dir), "child", "parent", 2)
    bad = closed.where(F.col("anc").contains("bolt") | (F.col("anc") == "size:0")).select(F.col("desc").alias("food")).distinct()
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("food:"), "l_partkey").alias("food"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(edges.join(bad, "food", "left_semi"), "o_orderkey", "left_anti")


@query(
    "common_ancestor",
    f"""WITH {_TAXONOMY}, pairs AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part), near AS (SELECT * FROM closure WHERE depth <= 1)
SELECT a, b, CASE WHEN a > (SELECT max(p_partkey) FROM part) OR b > (SELECT max(p_partkey) FROM part) THEN NULL ELSE EXISTS (SELECT 1 FROM near x JOIN near y ON x.anc = y.anc WHERE x."desc" = 'food:' || a AND y."desc" = 'food:' || b) END AS related FROM pairs""",
)
def common_ancestor(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")).withColumns({"x": F.concat(F.lit("food:"), "a"), "y": F.concat(F.lit("food:"), "b")})
    closed = graph.closure(_taxonomy(spark, sf_dir), "child", "parent", 1)
    return graph.common_ancestor(pairs, "x", "y", closed, 1).select("a", "b", "related")


@query(
    "nearest_siblings",
    """WITH e AS (SELECT n_name AS node, r_name AS anc FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT a.node, b.node AS sibling, 1 AS distance FROM e a JOIN e b ON a.anc = b.anc AND a.node <> b.node""",
)
def nearest_siblings(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    edges = edges.union(region.select("r_name", F.lit("world")))
    return graph.nearest_siblings(nation.select(F.col("n_name").alias("node")), "node", graph.closure(edges, "child", "parent", 2), 2)


_STATUS = "CASE WHEN size % 13 = 0 THEN 'not_suitable' WHEN size % 3 = 0 THEN NULL ELSE 'suitable' END"


@query(
    "three_state_rollup",
    f"""WITH {_FOODS}, s AS (SELECT item_id, coalesce({_STATUS}, 'unknown') AS st FROM foods), c AS (SELECT item_id, count(*) AS n, count(*) FILTER (st = 'not_suitable') AS n_blocking, count(*) FILTER (st = 'unknown') AS n_unknown FROM s GROUP BY item_id)
SELECT item_id, CASE WHEN n_blocking > 0 THEN 'not_suitable' WHEN n_unknown = 0 THEN 'suitable' ELSE 'unknown' END AS status, n, n_blocking, n_unknown FROM c""",
)
def three_state_rollup(spark, sf_dir):
    return graph.three_state(_foods(spark, sf_dir).withColumn("status", F.expr(_STATUS)), "item_id", "status")


@query("one_hop_expansion", f"WITH {_FOODS} SELECT item_id, count(*) AS n, string_agg(DISTINCT food_class, '|' ORDER BY food_class) AS classes FROM foods GROUP BY item_id")
def one_hop_expansion(spark, sf_dir):
    return _foods(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("food_class")), "|").alias("classes"))


@query("bulk_id_expansion", f"WITH {_FOODS} SELECT id AS item_id, count(food_id) AS n FROM (SELECT unnest([1, 2, 3, 5, 8, 13, 21, 999999999]) AS id) LEFT JOIN foods ON item_id = id GROUP BY id")
def bulk_id_expansion(spark, sf_dir):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13, 21, 999999999)], "item_id int")
    wanted = ids.select(F.col("item_id").cast("long").alias("item_id"))
    counts = _foods(spark, sf_dir).join(wanted, "item_id", "left_semi").groupBy("item_id").agg(F.count("food_id").alias("n"))
    return ids.join(counts, "item_id", "left").select(F.col("item_id").cast("int").alias("item_id"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "repointed_edges",
    f"""WITH {_FOODS}, m AS (SELECT name, min(food_id) AS keep FROM (SELECT p_name AS name, p_partkey AS food_id FROM part) GROUP BY name), e AS (SELECT DISTINCT item_id, keep AS food_id FROM foods JOIN m USING (name))
SELECT food_id, count(*) AS n FROM e GROUP BY food_id""",
)
def repointed_edges(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("old"), "p_name")
    mapping = part.join(part.groupBy("p_name").agg(F.min("old").alias("new")), "p_name").select("old", "new")
    edges = _foods(spark, sf_dir).select("item_id", "food_id")
    return graph.repointed(edges, "food_id", mapping, "old", "new").groupBy("food_id").agg(F.count("*").alias("n"))


@query(
    "replacement_collisions",
    f"""WITH {_FOODS}, m AS (SELECT p_partkey AS o, p_partkey + 1 AS n FROM part WHERE p_partkey % 2 = 1), b AS (SELECT o AS "old", n AS "new", x.item_id FROM m JOIN foods x ON x.food_id = o JOIN foods y ON y.food_id = n AND y.item_id = x.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY "old" ORDER BY item_id) AS nth FROM b) SELECT "old", "new", count(*) AS n_items, string_agg(CASE WHEN nth <= 3 THEN CAST(item_id AS VARCHAR) END, ',' ORDER BY item_id) AS examples FROM r GROUP BY ALL""",
)
def replacement_collisions(spark, sf_dir):
    mapping = table(spark, sf_dir, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1).alias("new"))
    return graph.collisions(_foods(spark, sf_dir), "item_id", "food_id", mapping, "old", "new", parts=parts(spark, sf_dir, "lineitem"))


@query("orphan_nodes", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem)")
def orphan_nodes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return graph.orphans(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", [(line.where("l_quantity > 45"), "l_partkey"), (line, "l_suppkey")])


@query("stale_derived_rows", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 3000)")
def stale_derived_rows(spark, sf_dir):
    live = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(live, "l_suppkey", "left_anti").select("l_orderkey", "l_suppkey")


@query(
    "self_join_eligibility",
    """WITH s AS (SELECT l_orderkey, l_suppkey, bool_or(l_returnflag = 'R') AS late FROM lineitem GROUP BY ALL)
SELECT l_suppkey, count(*) AS n FROM s a WHERE late AND EXISTS (SELECT 1 FROM s b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM s c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.late) GROUP BY l_suppkey""",
)
def self_join_eligibility(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("late"))
    # both conditions are counts over the order: one aggregation in the place of two self-joins
    per = s.groupBy("l_orderkey").agg(F.count("*").alias("n_all"), F.count_if("late").alias("n_late"))
    return s.where("late").join(per, "l_orderkey").where("n_all > 1 and n_late = 1").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(
    "diet_from_absence",
    f"""WITH {_FOODS} SELECT item_id, concat_ws(',', CASE WHEN NOT bool_or(contains(name, 'ring')) THEN 'ringless' END, CASE WHEN NOT bool_or(size % 13 = 0) THEN 'plain' END) AS tags FROM foods GROUP BY item_id""",
)
def diet_from_absence(spark, sf_dir):
    flags = _foods(spark, sf_dir).groupBy("item_id").agg(F.bool_or(F.col("name").contains("ring")).alias("ring"), F.bool_or(F.col("size") % 13 == 0).alias("odd"))
    return flags.select("item_id", F.array_join(F.array_compact(F.array(F.when(~F.col("ring"), "ringless"), F.when(~F.col("odd"), "plain"))), ",").alias("tags"))


@query(
    "keyword_evidence",
    f"""WITH {_FOODS}, k(allergen, kw) AS (VALUES ('metal', 'bolt'), ('metal', 'gear'), ('round', 'ring'), ('colour', 'red'), ('colour', 'blue'))
SELECT item_id, string_agg(DISTINCT allergen, ',' ORDER BY allergen) AS found FROM foods JOIN k ON regexp_matches(name, '(^|[^a-z0-9])' || kw || '(e?s)?([^a-z0-9]|$)') GROUP BY item_id""",
)
def keyword_evidence(spark, sf_dir):
    words = {"metal": ["bolt", "gear"], "round": ["ring"], "colour": ["red", "blue"]}
    hit = lambda kws: F.col("name").rlike(f"(^|[^a-z0-9])({'|'.join(kws)})(e?s)?([^a-z0-9]|$)")
    # names first: there are far fewer of them than edges, and each is matched once
    foods = _foods(spark, sf_dir)
    named = foods.select("name").distinct().select("name", F.array_compact(F.array(*(F.when(hit(k), a) for a, k in sorted(words.items())))).alias("found")).where(F.size("found") > 0)
    flat = foods.join(named, "name").select("item_id", F.explode("found").alias("one")).distinct()
    return flat.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("one")), ",").alias("found"))


@query(
    "suitability_precedence",
    """SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 'not_suitable' WHEN p_size < 20 OR p_type LIKE 'S%' THEN 'suitable' ELSE 'unknown' END AS status,
  CASE WHEN p_name LIKE '%red%' THEN 'name' WHEN p_size < 20 THEN 'size' WHEN p_type LIKE 'S%' THEN 'class' END AS reason FROM part""",
)
def suitability_precedence(spark, sf_dir):
    bad, small, kind = F.col("p_name").contains("red"), F.col("p_size") < 20, F.col("p_type").startswith("S")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(bad, "not_suitable").when(small | kind, "suitable").otherwise("unknown").alias("status"), F.when(bad, "name").when(small, "size").when(kind, "class").alias("reason"))


@query(
    "document_projection",
    f"""WITH {_FOODS}, i AS (SELECT item_id, count(DISTINCT name) AS n_names, string_agg(DISTINCT name, ';' ORDER BY name) AS names FROM foods GROUP BY item_id), b AS (SELECT item_id, string_agg(DISTINCT brand, ';' ORDER BY brand) AS brands FROM foods WHERE size > 25 GROUP BY item_id)
SELECT o_orderkey AS item_id, coalesce(n_names, 0) AS n_names, coalesce(names, '') AS names, coalesce(brands, '') AS brands FROM orders LEFT JOIN i ON i.item_id = o_orderkey LEFT JOIN b ON b.item_id = o_orderkey""",
)
def document_projection(spark, sf_dir):
    foods = _foods(spark, sf_dir)
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ";")
    # one aggregation for all lists of an edge type, never a product of edge types
    per = foods.groupBy("item_id").agg(F.count_distinct("name").alias("n_names"), listed("name").alias("names"), listed(F.when(F.col("size") > 25, F.col("brand"))).alias("brands"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")).join(per, "item_id", "left")
    return items.select("item_id", F.coalesce("n_names", F.lit(0)).alias("n_names"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("names", "brands")))
