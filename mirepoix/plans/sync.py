"""Queries: merges, reconciliation, audits and JSON fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.operators import merge as M
from mirepoix.plans.registry import query
from mirepoix.plans.tables import table


def _stored(spark, sf_dir):
    """(user_id, kind, value): the state before the last day: each user's first event of each kind."""
    rows = table(spark, sf_dir, "events").where("event_id % 3 <> 0")
    return rows.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.round(F.min_by("value", "event_id"), 3).alias("value"))


def _wanted(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_id % 3 <> 1")
    return rows.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.round(F.min_by("value", "event_id"), 3).alias("value"))


_STATES = """h AS (SELECT user_id, event_type AS kind, round(arg_min(value, event_id), 3) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY ALL),
w AS (SELECT user_id, event_type AS kind, round(arg_min(value, event_id), 3) AS value FROM events WHERE event_id % 3 <> 1 GROUP BY ALL)"""


@query("diff_plan", f"WITH {_STATES} SELECT user_id, kind, CASE WHEN h.value IS NULL THEN 'insert' WHEN w.value IS NULL THEN 'missing' WHEN h.value <> w.value THEN 'update' ELSE 'unchanged' END AS action FROM h FULL JOIN w USING (user_id, kind)")
def diff_plan(spark, sf_dir):
    return M.diff_plan(_stored(spark, sf_dir), _wanted(spark, sf_dir), ["user_id", "kind"], ["value"])


@query(
    "upsert_merge",
    f"""WITH {_STATES}, u AS (SELECT user_id, event_type AS kind, round(value, 3) AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_id % 4 = 0), l AS (SELECT user_id, kind, value FROM u WHERE nth = 1)
SELECT user_id, kind, coalesce(l.value, h.value) AS value FROM h FULL JOIN l USING (user_id, kind)""",
)
def upsert_merge(spark, sf_dir):
    updates = table(spark, sf_dir, "events").where("event_id % 4 = 0").select("user_id", F.col("event_type").alias("kind"), F.round("value", 3).alias("value"), "ts", "event_id")
    return M.upserted(_stored(spark, sf_dir), updates, ["user_id", "kind"], [F.desc("ts"), F.desc("event_id")])


@query("insert_missing", f"WITH {_STATES} SELECT * FROM h UNION ALL SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = w.user_id AND h.kind = w.kind)")
def insert_missing(spark, sf_dir):
    return M.inserted_missing(_stored(spark, sf_dir), _wanted(spark, sf_dir), ["user_id", "kind"])


@query("partial_update", f"WITH {_STATES} SELECT h.user_id, h.kind, coalesce(CASE WHEN w.value > 20 THEN w.value END, h.value) AS value FROM h LEFT JOIN w USING (user_id, kind)")
def partial_update(spark, sf_dir):
    patch = _wanted(spark, sf_dir).withColumn("value", F.when(F.col("value") > 20, F.col("value")))
    return M.patched(_stored(spark, sf_dir), patch, ["user_id", "kind"], ["value"])


@query("null_preserving_sync", f"WITH {_STATES} SELECT 'value' AS field, count(*) FILTER (w.value > 20 AND w.value <> h.value) AS n_changed FROM h JOIN w USING (user_id, kind)")
def null_preserving_sync(spark, sf_dir):
    patch = _wanted(spark, sf_dir).withColumn("value", F.when(F.col("value") > 20, F.col("value")))
    return M.patch_counts(_stored(spark, sf_dir), patch, ["user_id", "kind"], ["value"])


@query(
    "reconcile_full_outer",
    """WITH o AS (SELECT o_orderkey AS id, sha256(o_orderstatus || '|' || o_orderpriority) AS digest FROM orders WHERE o_orderkey % 10 <> 3), i AS (SELECT o_orderkey AS id, sha256(o_orderstatus || '|' || CASE WHEN o_orderkey % 10 = 5 THEN 'x' ELSE o_orderpriority END) AS digest, CASE WHEN o_orderkey % 10 <> 7 THEN 1 END AS stamp FROM orders WHERE o_orderkey % 10 <> 4)
SELECT id, CASE WHEN i.digest IS NULL THEN 'missing' WHEN o.digest IS NULL THEN 'orphan' WHEN stamp IS NULL THEN 'unstamped' WHEN o.digest <> i.digest THEN 'stale' ELSE 'in_sync' END AS state FROM o FULL JOIN i USING (id)""",
)
def reconcile_full_outer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    digest = lambda p: F.sha2(F.concat_ws("|", "o_orderstatus", p), 256).alias("digest")
    owner = orders.where("id % 10 <> 3").select("id", digest(F.col("o_orderpriority")))
    drift = F.when(F.col("id") % 10 == 5, "x").otherwise(F.col("o_orderpriority"))
    index = orders.where("id % 10 <> 4").select("id", digest(drift), F.when(F.col("id") % 10 != 7, 1).alias("stamp"))
    return M.reconciled(owner, index, ["id"], "digest", "stamp")


@query(
    "audit_append",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN 'status:O>P' ELSE '' END AS log FROM orders",
)
def audit_append(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = F.when(F.col("status") == "O", "P").otherwise(F.col("status"))
    done = M.audited(rows, "status", new, "review")
    return done.select("o_orderkey", "status", F.array_join(F.transform("enhancements", lambda e: F.concat(e["field"], F.lit(":"), e["before"], F.lit(">"), e["after"])), ";").alias("log"))


@query("resume_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def resume_pending(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("purge_keep_list", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') GROUP BY 1")
def purge_keep_list(spark, sf_dir):
    kept = M.purged(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "AUTOMOBILE"])
    return kept.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("fill_only_missing", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END, n_name) AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def fill_only_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("segment"))
    return M.filled(rows, names, "c_nationkey", ["segment"]).select("c_custkey", "segment")


@query(
    "json_path_stats",
    "SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS mean_k, CAST(max(CAST(json_extract_string(props, '$.k') AS INT)) AS INT) AS max_k, count(*) FILTER (json_extract_string(props, '$.none') IS NULL) AS absent FROM events GROUP BY event_type",
)
def json_path_stats(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg(k.try_cast("double")), 4).alias("mean_k"), F.max(k.try_cast("int")).alias("max_k"), F.count_if(F.get_json_object("props", "$.none").isNull()).alias("absent")
    )


@query("array_sum", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, round(list_max(embedding)::DOUBLE, 5) AS most FROM embeddings")
def array_sum(spark, sf_dir):
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 5).alias("total"), F.round(F.array_max("embedding").cast("double"), 5).alias("most"))


@query("map_first_present", "SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN value END, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END, -1.0) AS picked FROM events")
def map_first_present(spark, sf_dir):
    facts = F.map_filter(F.map_from_arrays(F.array(F.lit("price"), F.lit("k")), F.array(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k").try_cast("double")))), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", facts.alias("m")).select("event_id", F.coalesce(F.col("m")["price"], F.col("m")["k"], F.lit(-1.0)).alias("picked"))


@query("set_difference_counts", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS unlabelled, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS labelled")
def set_difference_counts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(1))
    docs = table(spark, sf_dir, "documents").select("doc_id").distinct().join(labels, "doc_id", "left")
    return docs.agg(F.count_if(F.col("known").isNull()).alias("unlabelled"), F.count("known").alias("labelled"))


@query("url_suffix_crosswalk", "SELECT p.page_id, d.doc_id, d.lang FROM (SELECT page_id, try_cast(nullif(regexp_extract(url, '/([0-9]+)(?:[/.?#]|$)', 1), '') AS BIGINT) AS doc_id FROM pages) p JOIN documents d USING (doc_id)")
def url_suffix_crosswalk(spark, sf_dir):
    key = F.nullif(F.regexp_extract("url", r"/([0-9]+)(?:[/.?#]|$)", 1), F.lit("")).try_cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "pages").select("page_id", key.alias("doc_id")).join(docs, "doc_id").select("page_id", "doc_id", "lang")


@query("all_or_nothing_map", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 THEN o_totalprice ELSE o_totalprice / 2 END AS total FROM orders")
def all_or_nothing_map(spark, sf_dir):
    canonical = F.struct(F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("b"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", canonical.alias("c"), (F.col("o_totalprice") / 2).alias("legacy"))
    return rows.select("o_orderkey", F.coalesce(F.when(F.col("c.a").isNotNull() & F.col("c.b").isNotNull(), F.col("c.a")), "legacy").alias("total"))


@query("multi_key_lookup", "SELECT c_custkey, coalesce(s.s_name, n.n_name, 'none') AS found FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey AND c_nationkey < 20")
def multi_key_lookup(spark, sf_dir):
    by_id = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    by_nation = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(by_id, "c_custkey", "left").join(by_nation, "c_nationkey", "left")
    return rows.select("c_custkey", F.coalesce("s_name", "n_name", F.lit("none")).alias("found"))
