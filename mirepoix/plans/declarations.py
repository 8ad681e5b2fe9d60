"""Queries: suitability of foods for consumer groups, allergen declarations brought up to their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.functions import suitability as S
from mirepoix.operators import declarations as D
from mirepoix.plans.registry import query
from mirepoix.plans.tables import table
from mirepoix.plans.taxonomy import _CLOSED, ROOTS, _closed
from mirepoix.plans.weights import _N, FOODS, _food, _list

#: The rules over the parts' taxonomy, whose classes are numbers.
RULES = [r.on(bad, good) for r, bad, good in zip(S.RULES, (["8", "10", "13"], ["13"], ["12"]), (["9"], ["9", "10"], []))]
# each fourth part's evidence of the taxonomy comes from keywords alone
_EVIDENCE = f"""ev AS (SELECT "desc" AS node, label AS allergen, CASE WHEN "desc" % 4 = 0 THEN 'keyword' ELSE 'taxonomy' END AS source, list_sort(list(DISTINCT anc::VARCHAR)) AS classes
FROM closed JOIN (VALUES {", ".join(f"({a}, '{g}')" for a, g in ROOTS.items())}) r(anc, label) USING (anc) JOIN part ON p_partkey = "desc" GROUP BY ALL)"""


def _text(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def _like(patterns) -> str:
    return f"regexp_matches(lower(name), '{S.any_of(patterns)}')"


def _hits(words) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(name), '{S.word_pattern(w)}') THEN '{w}' END" for w in words) + "], lambda w: w IS NOT NULL)"


def _verdicts(rule: S.Rule) -> str:
    of = lambda have, wanted: f"list_filter({have}, lambda x: list_contains({_text(wanted)}, x))"
    return f"""SELECT node, '{rule.group}' AS grp, {of("allergens", rule.allergens)} AS ba, {of("roots", rule.roots)} AS br, {_hits(rule.words)} AS bw, {_like(rule.safe)} AS safe, len(allergens) > 0 AS told,
  {of("roots", rule.good_roots)} AS gr, len({_hits(rule.good_words)}) > 0 AS gw, {_like(S.NO_EVIDENCE)} AS taken_back FROM n"""


def _evidence(spark, sf_dir, closed):
    roots = spark.createDataFrame(list(ROOTS.items()), "anc long, allergen string")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    found = closed.join(roots, "anc").select(F.col("desc").alias("node"), "allergen", F.col("anc").cast("string").alias("anc")).join(parts.hint("merge"), "node", "left_semi")
    source = F.when(F.col("node") % 4 == 0, "keyword").otherwise("taxonomy")
    return found.groupBy("node", "allergen").agg(F.sort_array(F.collect_set("anc")).alias("classes")).select("node", "allergen", F.array(source).alias("sources"), "classes", F.array("allergen").alias("terms"))


def _names(spark, sf_dir):
    """Foods under names that are partly explicit about a group."""
    key = F.col("p_partkey")
    said = F.when(key % 9 == 0, "vegan").when(key % 9 == 1, "gluten-free").when(key % 9 == 2, "check the label: vegan").when(key % 9 == 3, "oat milk and")
    return table(spark, sf_dir, "part").select(key.alias("node"), F.concat_ws(" ", said, "p_name", _food("p_partkey")).alias("name"))


_SUITABILITY = f"""{_CLOSED}, {_EVIDENCE}, a AS (SELECT node, list_sort(list(DISTINCT allergen)) AS allergens FROM ev WHERE source = 'taxonomy' GROUP BY node),
k AS (SELECT "desc" AS node, list_sort(list(DISTINCT anc::VARCHAR)) AS roots FROM closed WHERE anc::VARCHAR IN ('8', '9', '10', '12', '13') GROUP BY "desc"),
n AS (SELECT p_partkey AS node, coalesce(['vegan ', 'gluten-free ', 'check the label: vegan ', 'oat milk and '][p_partkey % 9 + 1], '') || p_name || ' ' || {_list(FOODS)}[p_partkey % {_N} + 1] AS name,
  coalesce(allergens, []::VARCHAR[]) AS allergens, coalesce(roots, []::VARCHAR[]) AS roots FROM part LEFT JOIN a ON a.node = p_partkey LEFT JOIN k ON k.node = p_partkey),
v AS ({" UNION ALL ".join(map(_verdicts, RULES))}),
s AS (SELECT node, grp, 'not_suitable' AS status, list_concat(list_concat(ba, br), bw) AS reasons, 'rules' || CASE WHEN len(br) > 0 THEN ',taxonomy' ELSE '' END || CASE WHEN told THEN ',allergen_evidence' ELSE '' END AS sources FROM v WHERE len(ba) + len(br) + len(bw) > 0 AND NOT safe
  UNION ALL SELECT node, grp, 'suitable', CASE WHEN len(gr) > 0 THEN gr ELSE ['{S.EXPLICIT}'] END, CASE WHEN len(gr) > 0 THEN 'taxonomy,rules' ELSE 'rules' END FROM v WHERE (len(ba) + len(br) + len(bw) = 0 OR safe) AND (len(gr) > 0 OR gw) AND NOT taken_back)"""


def _suitability(spark, sf_dir):
    closed = _closed(spark, sf_dir)
    return D.suitability(_names(spark, sf_dir), _evidence(spark, sf_dir, closed), closed, "node", "name", RULES)


@query("group_suitability", f"WITH RECURSIVE {_SUITABILITY} SELECT node, grp AS consumer_group, status, array_to_string(reasons, ',') AS reasons, sources FROM s")
def group_suitability(spark, sf_dir):
    return _suitability(spark, sf_dir).select("node", F.col("group").alias("consumer_group"), "status", F.array_join("reasons", ",").alias("reasons"), F.array_join("sources", ",").alias("sources"))


@query(
    "item_suitability",
    f"""WITH RECURSIVE {_SUITABILITY}, l AS (SELECT DISTINCT l_orderkey AS item_id, l_partkey AS node FROM lineitem), g AS (SELECT item_id, grp, count(*) FILTER (status = 'not_suitable') AS bad, count(*) FILTER (status = 'suitable') AS good FROM l JOIN s USING (node) GROUP BY ALL),
t AS (SELECT item_id, count(*) AS n FROM l GROUP BY item_id), x AS (SELECT unnest(['vegan', 'vegetarian', 'coeliac']) AS grp)
SELECT item_id, grp AS consumer_group, CASE WHEN bad > 0 THEN 'not_suitable' WHEN good = n THEN 'suitable' ELSE 'unknown' END AS status FROM t CROSS JOIN x LEFT JOIN g USING (item_id, grp)""",
)
def item_suitability(spark, sf_dir):
    """Each item's status for each group: one blocking food is enough against it, all foods must speak for it."""
    wide = _suitability(spark, sf_dir).groupBy("node").pivot("group", [r.group for r in RULES]).agg(F.first("status"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("node")).distinct().join(wide, "node", "left")
    status = lambda g: F.when(F.bool_or(F.coalesce(F.col(g) == "not_suitable", F.lit(False))), "not_suitable").when(F.bool_and(F.coalesce(F.col(g) == "suitable", F.lit(False))), "suitable").otherwise("unknown")
    groups = [r.group for r in RULES]
    return edges.groupBy("item_id").agg(*(status(g).alias(g) for g in groups)).unpivot(["item_id"], groups, "consumer_group", "status")


@query(
    "declaration_outcomes",
    f"""WITH RECURSIVE {_CLOSED}, {_EVIDENCE}, pick AS (SELECT *, CASE WHEN node % 5 = 0 THEN 'new' WHEN node % 5 = 1 THEN 'changed' WHEN node % 5 = 2 THEN 'other' ELSE 'same' END AS how FROM ev),
o AS (SELECT node, allergen, CASE how WHEN 'new' THEN 'created' WHEN 'changed' THEN 'updated' WHEN 'other' THEN 'created' ELSE 'unchanged' END AS outcome, 'v1' AS version, source, CASE WHEN how IN ('new', 'other') THEN 'now' ELSE 'then' END AS created_at, CASE WHEN how = 'same' THEN 'then' ELSE 'now' END AS updated_at FROM pick
  UNION ALL SELECT node, allergen, 'kept', 'v0', source, 'then', 'then' FROM pick WHERE how = 'other'
  UNION ALL SELECT p_partkey, 'lupin', 'stale', 'v1', 'keyword', 'then', 'then' FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT p_partkey, 'soy', 'kept', 'v1', 'keyword', 'then', 'then' FROM part WHERE p_partkey % 6 = 1)
SELECT outcome, allergen, version, source, created_at, updated_at, count(*) AS n, sum(node)::BIGINT AS nodes FROM o GROUP BY ALL""",
)
def declaration_outcomes(spark, sf_dir):
    """What becomes of declarations: some stored before as they are, changed, under another version, without evidence, or given by a label."""
    evidence, key = _evidence(spark, sf_dir, _closed(spark, sf_dir)), F.col("node")
    how = key % 5
    before = lambda rows, kind, version: rows.select(
        F.concat_ws(":", F.lit("ingredient"), F.col("node").cast("string"), F.lit("allergen"), "allergen", F.lit("version"), version).alias("declaration_id"), "node", "allergen", F.lit(kind).alias("declaration_type"),
        version.alias("classification_version"), F.lit("contains").alias("presence"), F.lit("inferred").alias("evidence_status"), "sources", "classes", "terms", F.lit("then").alias("created_at"), F.lit("then").alias("updated_at"),
    )
    old = before(evidence.where(how != 0).withColumn("terms", F.when(how == 1, F.array(F.lit("older"))).otherwise(F.col("terms"))), D.INFERRED, F.when(how == 2, "v0").otherwise("v1"))
    part, none = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "node"), F.array().cast("array<string>")
    extra = lambda at, name, kind: before(part.where(key % 6 == at).select("node", F.lit(name).alias("allergen"), F.array(F.lit("keyword")).alias("sources"), none.alias("classes"), none.alias("terms")), kind, F.lit("v1"))
    found = D.declared(old.unionByName(extra(0, "lupin", D.INFERRED)).unionByName(extra(1, "soy", "label_claim")), evidence, "node", "v1", "now")
    by = ["outcome", "allergen", F.col("classification_version").alias("version"), F.col("sources")[0].alias("source"), "created_at", "updated_at"]
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.sum("node").alias("nodes"))
