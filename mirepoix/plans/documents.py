"""Queries: documents, cards, profiles of one item, conversions, keys and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.functions import scoring as G
from mirepoix.functions import text as T
from mirepoix.functions import vocabulary as V
from mirepoix.operators import documents as D
from mirepoix.operators import graph
from mirepoix.operators import match as X
from mirepoix.operators.report import top_n
from mirepoix.plans.graphs import _TAXONOMY, _foods, _taxonomy
from mirepoix.plans.registry import query
from mirepoix.plans.rules import _raw, _raw_sql, _rx
from mirepoix.plans.tables import LINES, SCORES, lines, scores, steady, table

_REGIONS = {"EUROPE": "europe", "ASIA": "asia", "AMERICA": "america"}


@query(
    "profile_attachment",
    f"""WITH {SCORES} SELECT item_id, string_agg(DISTINCT region, ',' ORDER BY region) AS sources, min(score) AS best, {", ".join(f"arg_max(score, (updated_at, score)) FILTER (region = '{r}') AS score_{c}" for r, c in _REGIONS.items())},
  bool_or(region = 'EUROPE' AND score < 0) AS has_ground_truth, max(updated_at) AS profiled_at FROM scores GROUP BY item_id""",
)
def profile_attachment(spark, sf_dir):
    newest = lambda r: F.max_by(F.when(F.col("region") == r, F.col("score")), F.when(F.col("region") == r, F.struct("updated_at", "score")))
    return scores(spark, sf_dir).groupBy("item_id").agg(
        F.array_join(F.sort_array(F.collect_set("region")), ",").alias("sources"), F.min("score").alias("best"), *(newest(r).alias(f"score_{c}") for r, c in _REGIONS.items()),
        F.bool_or((F.col("region") == "EUROPE") & (F.col("score") < 0)).alias("has_ground_truth"), F.max("updated_at").alias("profiled_at"),
    )


@query(
    "card_details",
    f"""WITH {LINES}, wanted AS (SELECT o_orderkey AS item_id FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT -1), cached AS (SELECT o_orderkey AS item_id, floor(o_totalprice) AS kcal FROM orders WHERE o_orderstatus = 'F'),
fresh AS (SELECT item_id, sum(weight_g / 100 * energy_kcal) / greatest(count(DISTINCT food_id), 1) AS kcal FROM lines GROUP BY item_id)
SELECT item_id, floor(coalesce(c.kcal, f.kcal) * 10 + 0.3) / 10 AS kcal_per_serving, CASE WHEN c.kcal IS NOT NULL THEN 'cache' ELSE 'fresh' END AS origin FROM wanted LEFT JOIN cached c USING (item_id) LEFT JOIN fresh f USING (item_id) WHERE coalesce(c.kcal, f.kcal) IS NOT NULL""",
)
def card_details(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wanted = orders.where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("item_id")).union(spark.range(1).select(F.lit(-1).cast("long")))
    cached = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id"), F.floor("o_totalprice").cast("double").alias("cached"))
    total = lines(spark, sf_dir).join(wanted, "item_id", "left_semi").groupBy("item_id")
    fresh = total.agg((F.sum(F.col("weight_g") / 100 * F.col("energy_kcal")) / F.greatest(F.count_distinct("food_id"), F.lit(1))).alias("fresh"))
    cards = wanted.join(cached, "item_id", "left").join(fresh, "item_id", "left").where("coalesce(cached, fresh) is not null")
    return cards.select("item_id", steady(F.coalesce("cached", "fresh"), 1).alias("kcal_per_serving"), F.when(F.col("cached").isNotNull(), "cache").otherwise("fresh").alias("origin"))


_TAGS = "['  Main-Dish', lower(o_orderpriority), 'main dish', o_orderstatus, '']"


@query(
    "document_assembly",
    f"""SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS title_normalized, array_to_string(list_sort(list_distinct(list_filter(list_transform({_TAGS}, lambda t: regexp_replace(trim(replace(lower(t), '-', ' ')), '\\s+', '_', 'g')), lambda t: t <> ''))), ',') AS courses,
  CASE WHEN o_orderstatus = 'F' THEN 'inactive' ELSE 'active' END AS status, CASE WHEN o_totalprice > 0 AND o_orderpriority <> '' THEN '' WHEN o_orderpriority <> '' THEN 'price' ELSE 'title' END AS problem FROM orders""",
)
def document_assembly(spark, sf_dir):
    tags = T.slugs(F.array(F.lit("  Main-Dish"), F.lower("o_orderpriority"), F.lit("main dish"), F.col("o_orderstatus"), F.lit("")))
    problem = F.when(F.col("o_orderpriority") == "", "title").when(~(F.col("o_totalprice") > 0), "price").otherwise("")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.title_form(F.col("o_orderpriority")).alias("title_normalized"), F.array_join(F.sort_array(tags), ",").alias("courses"), F.when(F.col("o_orderstatus") == "F", "inactive").otherwise("active").alias("status"), problem.alias("problem")
    )


@query("redacted_documents", """SELECT event_id, '{"event_id":' || event_id || ',"detail":{"event_type":"' || event_type || '"},"steps":[{"n":1},{"n":' || event_id % 7 || '}]}' AS document FROM events""")
def redacted_documents(spark, sf_dir):
    step = lambda n: F.struct(n.cast("long").alias("n"), F.col("value").alias("value"))
    nested = table(spark, sf_dir, "events").select("event_id", F.struct("user_id", "event_type", "value").alias("detail"), F.array(step(F.lit(1)), step(F.col("event_id") % 7)).alias("steps"), "user_id")
    return D.redacted(nested, {"user_id", "value"}).select("event_id", F.to_json(F.struct("event_id", "detail", "steps")).alias("document"))


@query("nutrient_rows", f"WITH {LINES} SELECT item_id, position, unnest(['energy', 'fat', 'salt']) AS nutrient, round(unnest([energy_kcal, fat_g, salt_g]), 4) AS amount, unnest(['kcal', 'g', 'g']) AS unit FROM lines")
def nutrient_rows(spark, sf_dir):
    row = lambda name, value, unit: F.struct(F.lit(name).alias("nutrient"), F.round(value, 4).alias("amount"), F.lit(unit).alias("unit"))
    return lines(spark, sf_dir).select("item_id", "position", F.inline(F.array(row("energy", "energy_kcal", "kcal"), row("fat", "fat_g", "g"), row("salt", "salt_g", "g"))))


@query("vitamin_a_iu", f"WITH {LINES}, v AS (SELECT item_id, position, nullif(fat_g, 0) AS retinol, nullif(salt_g, 0) AS beta FROM lines) SELECT item_id, position, CASE WHEN retinol IS NOT NULL OR beta IS NOT NULL THEN floor((coalesce(retinol, 0) / 0.3 + coalesce(beta, 0) / 0.6) * 100 + 0.3) / 100 END AS iu FROM v")
def vitamin_a_iu(spark, sf_dir):
    retinol, beta = F.nullif("fat_g", F.lit(0.0)), F.nullif("salt_g", F.lit(0.0))
    iu = F.when(retinol.isNotNull() | beta.isNotNull(), steady(F.coalesce(retinol, F.lit(0.0)) / 0.3 + F.coalesce(beta, F.lit(0.0)) / 0.6, 2))
    return lines(spark, sf_dir).select("item_id", "position", iu.alias("iu"))


@query("reference_totals", f"WITH {LINES} SELECT item_id, floor(sum(salt_g * weight_g / 100) / 2.5 * 1000 * 10 + 0.3) / 10 AS sodium_mg, floor(sum(energy_kcal * weight_g / 100) * 4.184 + 0.3) AS energy_kj FROM lines GROUP BY item_id")
def reference_totals(spark, sf_dir):
    part = lambda c: F.sum(F.col(c) * F.col("weight_g") / 100)
    return lines(spark, sf_dir).groupBy("item_id").agg(steady(part("salt_g") / 2.5 * 1000, 1).alias("sodium_mg"), steady(part("energy_kcal") * 4.184, 0).alias("energy_kj"))


@query("authoritative_grade", f"WITH {SCORES} SELECT item_id, region, coalesce(nullif(trim(CASE WHEN score % 3 = 0 THEN ' B ' WHEN score % 3 = 1 THEN ' ' END), ''), CASE WHEN score <= 0 THEN 'A' WHEN score <= 2 THEN 'B' WHEN score <= 10 THEN 'C' WHEN score <= 18 THEN 'D' ELSE 'E' END) AS grade FROM (SELECT item_id, region, max(score) AS score FROM scores GROUP BY ALL)")
def authoritative_grade(spark, sf_dir):
    rows = scores(spark, sf_dir).groupBy("item_id", "region").agg(F.max("score").alias("score"))
    stored = F.when(F.col("score") % 3 == 0, " B ").when(F.col("score") % 3 == 1, " ")
    return rows.select("item_id", "region", F.coalesce(F.nullif(F.trim(stored), F.lit("")), G.grade(F.col("score"))).alias("grade"))


@query("serves_from_yield", f"WITH {LINES} SELECT item_id, CAST(greatest(round_even(sum(weight_g) * 0.9 / 350, 0), 1) AS BIGINT) AS serves FROM lines GROUP BY item_id")
def serves_from_yield(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("item_id").agg(F.greatest(F.bround(F.sum("weight_g") * 0.9 / 350), F.lit(1)).cast("long").alias("serves"))


@query("serves_inference", f"WITH {LINES}, t AS (SELECT item_id, sum(weight_g) AS total, max(weight_g) AS one FROM lines GROUP BY item_id) SELECT item_id, CASE WHEN round(total / one) BETWEEN 1 AND 24 AND abs(total / one - round(total / one)) <= 0.15 THEN CAST(round(total / one) AS BIGINT) END AS serves FROM t")
def serves_inference(spark, sf_dir):
    t = lines(spark, sf_dir).groupBy("item_id").agg(F.sum("weight_g").alias("total"), F.max("weight_g").alias("one"))
    ratio = F.col("total") / F.nullif("one", F.lit(0.0))
    return t.select("item_id", F.when(F.round(ratio).between(1, 24) & (F.abs(ratio - F.round(ratio)) <= 0.15), F.round(ratio).cast("long")).alias("serves"))


_SHA = "0"
for _at in range(0, 40, 7):
    _SHA = f"(({_SHA}::HUGEINT * {16 ** min(7, 40 - _at)} + CAST('0x' || substr(sha1(CAST(user_id AS VARCHAR)), {_at + 1}, {min(7, 40 - _at)}) AS HUGEINT)) % 1000)"


@query(
    "hashed_ids",
    f"""WITH h AS (SELECT user_id, {_SHA} AS h FROM (SELECT DISTINCT user_id FROM events)), i AS (SELECT user_id, h, row_number() OVER (ORDER BY h, user_id) - 1 AS i FROM h),
m AS (SELECT user_id, i, max(h - i) OVER (ORDER BY i) AS m FROM i), w AS (SELECT count(*) AS w FROM m WHERE i + m >= 1000),
ids AS (SELECT user_id, CAST((i + greatest(m, w)) % 1000 AS BIGINT) AS new_id FROM m, w) SELECT user_id, CASE WHEN (SELECT count(DISTINCT new_id) = count(*) FROM ids) THEN new_id END AS new_id FROM ids""",
)
def hashed_ids(spark, sf_dir):
    return D.free_ids(table(spark, sf_dir, "events").select("user_id").distinct(), "user_id", 3, refuse=False)


@query(
    "reference_against_calculated",
    f"""WITH {LINES}, {SCORES}, r AS (SELECT item_id, avg(score) AS reference FROM scores WHERE region = 'EUROPE' GROUP BY item_id), c AS (SELECT source_id % 3 AS source, item_id, avg(fat_g) AS calculated FROM lines GROUP BY ALL)
SELECT source, count(*) AS n, floor(avg(abs(reference - calculated)) * 1000 + 0.3) / 1000 AS deviation FROM r JOIN c USING (item_id) GROUP BY source""",
)
def reference_against_calculated(spark, sf_dir):
    reference = scores(spark, sf_dir).where("region = 'EUROPE'").groupBy("item_id").agg(F.avg("score").alias("reference"))
    calculated = lines(spark, sf_dir).groupBy((F.col("source_id") % 3).alias("source"), "item_id").agg(F.avg("fat_g").alias("calculated"))
    both = reference.join(calculated, "item_id").groupBy("source")
    return both.agg(F.count("*").alias("n"), steady(F.avg(F.abs(F.col("reference") - F.col("calculated"))), 3).alias("deviation"))


@query(
    "suitability_gate",
    """WITH c AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS position FROM lineitem GROUP BY ALL), u AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n_items FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY position, l_partkey)::INT AS nth, n_items FROM c JOIN u USING (l_partkey) JOIN part ON p_partkey = l_partkey WHERE p_size <= 40 AND p_name NOT LIKE '%red%'""",
)
def suitability_gate(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size <= 40 and p_name not like '%red%'")
    used = line.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n_items"))
    candidates = line.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("position"))  # in the order that the item lists them
    suitable = candidates.join(part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").join(used, "l_partkey")
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("position", "l_partkey"))
    return suitable.select("l_orderkey", "l_partkey", nth.alias("nth"), "n_items")


@query(
    "best_equivalent",
    """WITH p AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id IN (1, 2, 3))
SELECT vec_id, arg_max(other, (s, -other)) AS equivalent, round(max(s), 6) AS similarity FROM p GROUP BY vec_id""",
)
def best_equivalent(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # the edges to the candidates are given: here the three ids that follow
    edges = rows.select("vec_id", "embedding", F.explode(F.array(*(F.col("vec_id") + k for k in (1, 2, 3)))).alias("other"))
    pairs = edges.join(rows.select(F.col("vec_id").alias("other"), F.col("embedding").alias("its")), "other").withColumn("s", X.cosine(F.col("embedding"), F.col("its")))
    return pairs.groupBy("vec_id").agg(F.max_by("other", F.struct("s", -F.col("other"))).alias("equivalent"), F.round(F.max("s"), 6).alias("similarity"))


@query(
    "positional_merge",
    f"""WITH {LINES}, a AS (SELECT item_id, position, min(energy_kcal) AS kcal, min(weight_g) AS weight_g FROM lines WHERE source_id % 2 = 0 GROUP BY ALL), b AS (SELECT item_id, position, min(fat_g) AS fat, min(weight_g) AS weight_g FROM lines WHERE source_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.position, b.position) AS position, kcal, a.weight_g, fat, b.weight_g AS b_weight_g FROM a FULL JOIN b ON a.item_id = b.item_id AND a.position = b.position""",
)
def positional_merge(spark, sf_dir):
    least = lambda odd, value, name: lines(spark, sf_dir).where(F.col("source_id") % 2 == odd).groupBy("item_id", "position").agg(F.min(value).alias(name), F.min("weight_g").alias("weight_g"))
    second = least(1, "fat_g", "fat").withColumnRenamed("weight_g", "b_weight_g")  # a name that both have gets the second's prefix
    return least(0, "energy_kcal", "kcal").join(second, ["item_id", "position"], "full")


@query(
    "key_type_fallback",
    """WITH k AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '00' || user_id ELSE c_name END AS key FROM events LEFT JOIN customer ON c_custkey = user_id),
s AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS stored FROM customer)
SELECT event_id, coalesce(a.c_custkey, b.c_custkey) AS custkey, CASE WHEN a.c_custkey IS NOT NULL THEN 'string' WHEN b.c_custkey IS NOT NULL THEN 'number' ELSE 'none' END AS matched_by FROM k LEFT JOIN s a ON a.stored = key LEFT JOIN s b ON try_cast(b.stored AS BIGINT) = try_cast(key AS BIGINT)""",
)
def key_type_fallback(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    users = table(spark, sf_dir, "events").join(customer, F.col("c_custkey") == F.col("user_id"), "left")
    key = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("00"), "user_id")).otherwise(F.col("c_name"))
    stored = customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")).alias("stored"))
    steps = [("string", F.col("key"), stored, "stored", "c_custkey"), ("number", F.col("key").try_cast("long"), stored.select("c_custkey", F.col("stored").try_cast("long").alias("stored")), "stored", "c_custkey")]
    found = X.cascade(users.select("event_id", key.alias("key")), steps)
    return found.select("event_id", F.col("value").alias("custkey"), "matched_by")


@query("occurrence_counter", "SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_extendedprice) AS occurrence FROM lineitem")
def occurrence_counter(spark, sf_dir):
    nth = F.row_number().over(W.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", nth.cast("long").alias("occurrence"))


@query("structured_find", f"WITH {SCORES}, s AS (SELECT item_id, min(score) AS score FROM scores WHERE region = 'ASIA' GROUP BY item_id) SELECT o_orderkey, score FROM orders LEFT JOIN s ON item_id = o_orderkey WHERE o_totalprice > 1000 ORDER BY score ASC NULLS LAST, o_orderpriority, o_orderkey LIMIT 40")
def structured_find(spark, sf_dir):
    least = scores(spark, sf_dir).where("region = 'ASIA'").groupBy(F.col("item_id").alias("o_orderkey")).agg(F.min("score").alias("score"))
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 1000").join(least, "o_orderkey", "left")
    return rows.orderBy(F.asc_nulls_last("score"), "o_orderpriority", "o_orderkey").limit(40).select("o_orderkey", "score")


_GOALS = {"lower_sodium": "sodium", "less_salt": "sodium", "low_fat": "fat", "less_fat": "fat", "more_fibre": "fibre", "less_sugar": "sugar"}
_WISH = "[CASE o_orderkey % 3 WHEN 0 THEN 'less_salt' WHEN 1 THEN 'low_fat' ELSE 'unknown' END, 'lower_sodium', CASE o_custkey % 2 WHEN 0 THEN 'less_fat' ELSE 'less_sugar' END]"


@query("goal_aliases", f"WITH g AS (SELECT o_orderkey, list_filter(list_transform({_WISH}, lambda x: CASE x {' '.join(f'WHEN {_rx(k)} THEN {_rx(v)}' for k, v in _GOALS.items())} END), lambda x: x IS NOT NULL) AS g FROM orders) SELECT o_orderkey, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), ',') AS measures FROM g")
def goal_aliases(spark, sf_dir):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey") % 2
    wish = F.array(F.when(k == 0, "less_salt").when(k == 1, "low_fat").otherwise("unknown"), F.lit("lower_sodium"), F.when(c == 0, "less_fat").otherwise("less_sugar"))
    known = F.create_map(*(F.lit(x) for kv in _GOALS.items() for x in kv))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_distinct(F.array_compact(F.transform(wish, lambda g: known[g]))), ",").alias("measures"))


@query(
    "one_status_per_group",
    """WITH r AS (SELECT l_orderkey AS item_id, CASE l_returnflag WHEN 'R' THEN 'vegan' WHEN 'A' THEN 'vegetarian' END AS grp, min(l_linestatus) AS status FROM lineitem GROUP BY ALL)
SELECT i.item_id, g.grp, coalesce(r.status, 'unknown') AS status FROM (SELECT o_orderkey AS item_id FROM orders) i CROSS JOIN (VALUES ('vegan'), ('vegetarian')) g(grp) LEFT JOIN r ON r.item_id = i.item_id AND r.grp = g.grp""",
)
def one_status_per_group(spark, sf_dir):
    group = F.when(F.col("l_returnflag") == "R", "vegan").when(F.col("l_returnflag") == "A", "vegetarian")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), group.alias("grp"), F.col("l_linestatus").alias("status")).where("grp is not null")
    return D.one_per_group(rows, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")), "item_id", "grp", "status", ["vegan", "vegetarian"], "unknown")


@query("appended_tags", "SELECT o_orderkey, array_to_string(CASE WHEN list_contains([o_orderstatus, 'P'], 'F') THEN [o_orderstatus, 'P'] ELSE list_append([o_orderstatus, 'P'], 'F') END, ',') AS tags FROM orders")
def appended_tags(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(D.appended(F.array("o_orderstatus", F.lit("P")), "F"), ",").alias("tags"))


@query("sorted_evidence", "SELECT l_orderkey, string_agg(DISTINCT l_linestatus || ':' || lower(l_returnflag), ',' ORDER BY l_linestatus || ':' || lower(l_returnflag)) AS evidence FROM lineitem GROUP BY l_orderkey")
def sorted_evidence(spark, sf_dir):
    one = F.struct(F.col("l_linestatus").alias("a"), F.lower("l_returnflag").alias("b"))
    listed = F.array_sort(F.collect_set(one))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["a"], x["b"])), ",").alias("evidence"))


@query("aligned_concat", f"WITH {SCORES} SELECT item_id, CAST(score AS DOUBLE) AS value, 'reference' AS origin, region FROM scores WHERE region = 'EUROPE' UNION ALL SELECT l_orderkey, l_tax, 'calculated', NULL FROM lineitem WHERE l_discount = 0")
def aligned_concat(spark, sf_dir):
    reference = scores(spark, sf_dir).where("region = 'EUROPE'").select("item_id", F.col("score").cast("double").alias("value"), F.lit("reference").alias("origin"), "region")
    calculated = table(spark, sf_dir, "lineitem").where("l_discount = 0").select(F.lit("calculated").alias("origin"), F.col("l_tax").alias("value"), F.col("l_orderkey").alias("item_id"))
    return reference.unionByName(calculated, allowMissingColumns=True)


@query("batch_profile_summary", f"WITH {SCORES} SELECT region, count(*) AS n, floor(avg(score) * 1000 + 0.3) / 1000 AS mean, floor(stddev_pop(score) * 1000 + 0.3) / 1000 AS deviation, count(*) FILTER (score <= 0) AS grade_a FROM scores GROUP BY region")
def batch_profile_summary(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("region").agg(F.count("*").alias("n"), steady(F.avg("score"), 3).alias("mean"), steady(F.stddev_pop("score"), 3).alias("deviation"), F.count_if(F.col("score") <= 0).alias("grade_a"))


_FLAGS = {"no_words": "p_size % 7 = 0", "class_clash": "p_type = 'PROMO' AND p_name LIKE '%ring'", "far": "p_retailprice < 905"}


@query("audit_summary", "WITH f AS (SELECT p_partkey % 4 AS confidence, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FLAGS.items()) + "] || ['all'], lambda x: x IS NOT NULL)) AS flag FROM part) SELECT flag, count(*) AS n, count(*) FILTER (confidence = 0) AS low, floor(100.0 * count(*) / (SELECT count(*) FROM part) * 100 + 0.3) / 100 AS pct FROM f GROUP BY flag")
def audit_summary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    flags = part.select((F.col("p_partkey") % 4).alias("confidence"), F.explode(F.array_compact(F.array(*(F.when(F.expr(c), n) for n, c in _FLAGS.items()), F.lit("all")))).alias("flag"))
    total = part.agg(F.count("*").alias("total"))
    each = flags.groupBy("flag").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == 0).alias("low")).crossJoin(F.broadcast(total))
    return each.select("flag", "n", "low", steady(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


@query("derived_tags", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size <= 30 THEN '30_minutes_or_less' END, CASE WHEN p_name NOT LIKE '%red%' OR p_type = 'PROMO' THEN 'vegetarian_or_vegan' END) AS tags FROM part")
def derived_tags(spark, sf_dir):
    vegan, vegetarian = ~F.col("p_name").contains("red"), F.col("p_type") == "PROMO"
    tags = F.array_compact(F.array(F.when(F.col("p_size") <= 30, "30_minutes_or_less"), F.when(vegan | vegetarian, "vegetarian_or_vegan")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query("graph_export", "SELECT DISTINCT 'item:' || l_orderkey AS start_id, 'food:' || l_partkey AS end_id, 'HAS_FOOD' AS type FROM lineitem UNION ALL SELECT DISTINCT 'food:' || p_partkey, 'brand:' || p_brand, 'HAS_BRAND' FROM part")
def graph_export(spark, sf_dir):
    edge = lambda rows, a, start, b, end, kind: rows.select(F.concat(F.lit(f"{a}:"), start).alias("start_id"), F.concat(F.lit(f"{b}:"), end).alias("end_id"), F.lit(kind).alias("type")).distinct()
    return edge(table(spark, sf_dir, "lineitem"), "item", "l_orderkey", "food", "l_partkey", "HAS_FOOD").union(edge(table(spark, sf_dir, "part"), "food", "p_partkey", "brand", "p_brand", "HAS_BRAND"))


@query(
    "carry_over",
    """WITH old AS (SELECT p_partkey AS id, p_brand AS note, p_type AS course FROM part WHERE p_partkey % 3 <> 0), fresh AS (SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN '' ELSE p_name END AS note, CASE WHEN p_partkey % 5 <> 0 THEN 'x' END AS course FROM part)
SELECT f.id, CASE WHEN coalesce(f.note, '') = '' THEN o.note ELSE f.note END AS note, CASE WHEN coalesce(f.course, '') = '' THEN o.course ELSE f.course END AS course,
  CASE WHEN o.id IS NULL THEN 'new' WHEN (coalesce(f.note, '') = '' AND o.note IS NOT NULL) OR (coalesce(f.course, '') = '' AND o.course IS NOT NULL) THEN 'carried' ELSE 'kept' END AS outcome FROM fresh f LEFT JOIN old o ON o.id = f.id""",
)
def carry_over(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("note"), F.col("p_type").alias("course"))
    fresh = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_name")).alias("note"), F.when(F.col("p_partkey") % 5 != 0, "x").alias("course"))
    return D.carried_over(fresh, old, "id", ["note", "course"])


#: Stores and their columns, numbers with fractions in cents and moments in seconds: (name, in Spark, in SQL).
_STORES = {
    "orders": [("o_orderkey",) * 2, ("o_custkey",) * 2, ("o_orderstatus",) * 2, ("cast(round(o_totalprice * 100) as bigint)",) * 2, ("timestampdiff(SECOND, timestamp_ntz'1970-01-01', cast(o_orderdate as timestamp_ntz))", "epoch_us(o_orderdate::TIMESTAMP) // 1000000"), ("o_orderpriority",) * 2],
    "part": [("p_partkey",) * 2, ("p_name",) * 2, ("p_brand",) * 2, ("p_type",) * 2, ("p_size",) * 2, ("cast(round(p_retailprice * 100) as bigint)",) * 2],
    "events": [("event_id",) * 2, ("user_id",) * 2, ("event_type",) * 2, ("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))", "epoch_us(ts::TIMESTAMP)"), ("props",) * 2],
    "documents": [("doc_id",) * 2, ("text",) * 2, ("lang",) * 2, ("source",) * 2],
}


def _checksum_sql(store: str) -> str:
    row = ", ".join(f"coalesce('=' || replace(({c})::VARCHAR, chr(31), chr(31) || chr(31)), '-')" for _, c in _STORES[store])
    half = lambda at: f"coalesce(sum(CAST('0x' || substr(d, {at}, 15) AS HUGEINT)), 0)::VARCHAR"
    return f"SELECT '{store}' AS store, count(*) AS n, {half(1)} || ':' || {half(16)} AS checksum FROM (SELECT md5(concat_ws(chr(31), {row})) AS d FROM {store})"


@query("store_checksums", " UNION ALL ".join(map(_checksum_sql, _STORES)))
def store_checksums(spark, sf_dir):
    sums = []
    for store, columns in _STORES.items():
        rows = table(spark, sf_dir, store).selectExpr(*(f"{c} as c{i}" for i, (c, _) in enumerate(columns)))
        sums.append(D.content_checksum(rows, rows.columns).select(F.lit(store).alias("store"), "n", "checksum"))
    return reduce(DataFrame.union, sums)


@query("composition_lookup", "SELECT l_orderkey, l_linenumber, l_extendedprice, p_name, p_retailprice FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def composition_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_partkey").alias("p_partkey"))
    return wanted.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "p_partkey", "left").drop("p_partkey")


@query("leading_quantity_strip", f"WITH {_raw_sql()} SELECT raw, regexp_replace(ltrim(lower(raw)), {_rx(V.LEADING_QUANTITY)}, '') AS stripped FROM raw")
def leading_quantity_strip(spark, sf_dir):
    return _raw(spark, sf_dir).select("raw", F.regexp_replace(F.ltrim(F.lower("raw")), V.LEADING_QUANTITY, "").alias("stripped"))


@query(
    "ranked_candidates",
    """WITH c AS (SELECT p_type AS q, p_partkey, p_size % 3 AS tier, len(string_split(p_name, ' ')) AS n_tokens, p_retailprice AS rank FROM part), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY tier, n_tokens DESC, rank, p_partkey) AS INT) AS nth FROM c) SELECT q, p_partkey, nth FROM r WHERE nth <= 5""",
)
def ranked_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("q"), "p_partkey", (F.col("p_size") % 3).alias("tier"), F.size(F.split("p_name", " ")).alias("n_tokens"), F.col("p_retailprice").alias("rank"))
    return top_n(rows, ["q"], [F.col("tier"), F.desc("n_tokens"), F.col("rank"), F.col("p_partkey")], 5).select("q", "p_partkey", "nth")


@query("head_mismatch", "WITH n AS (SELECT p_partkey, string_split(p_name, ' ')[-1] AS h, string_split(p_name, ' ')[1] AS f FROM part) SELECT a.p_partkey, a.h <> b.h AND a.f <> b.f AS mismatch FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1")
def head_mismatch(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_name", " ", -1).alias("h"), F.split("p_name", " ")[0].alias("f"))
    after = n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("h").alias("h2"), F.col("f").alias("f2"))
    return n.join(after, "p_partkey").select("p_partkey", ((F.col("h") != F.col("h2")) & (F.col("f") != F.col("f2"))).alias("mismatch"))


@query(
    "taxonomy_free_tag",
    f"""WITH {_TAXONOMY}, bad AS (SELECT DISTINCT p_partkey, p_name FROM part JOIN closure ON "desc" = 'food:' || p_partkey AND anc IN ('head:ring', 'size:2') WHERE NOT EXISTS (SELECT 1 FROM closure x WHERE x."desc" = 'food:' || p_partkey AND x.anc = 'size:0'))
SELECT o_orderkey AS item_id, NOT EXISTS (SELECT 1 FROM lineitem JOIN bad ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_name LIKE 'red %') AS free FROM orders""",
)
def taxonomy_free_tag(spark, sf_dir):
    closed = graph.closure(_taxonomy(spark, sf_dir), "child", "parent", 2).where(F.col("desc").startswith("food:"))
    per = closed.groupBy("desc").agg(F.bool_or(F.col("anc").isin("head:ring", "size:2")).alias("hit"), F.bool_or(F.col("anc") == "size:0").alias("excused"))
    bad = per.where("hit and not excused").select(F.substring_index("desc", ":", -1).try_cast("long").alias("food_id"), F.lit(True).alias("bad"))
    edges = _foods(spark, sf_dir).select("item_id", "food_id", "name").join(bad, "food_id", "left")
    blocked = edges.groupBy("item_id").agg(F.bool_or(F.coalesce("bad", F.lit(False)) | F.col("name").startswith("red ")).alias("blocked"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"))
    return items.join(blocked, "item_id", "left").select("item_id", (~F.coalesce("blocked", F.lit(False))).alias("free"))
