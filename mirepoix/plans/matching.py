"""Queries: lookups, fuzzy and containment joins, BM25, vectors, hybrid ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.functions import text as T
from mirepoix.operators import match as X
from mirepoix.operators.report import top_n
from mirepoix.plans.registry import query
from mirepoix.plans.tables import steady, table


@query(
    "cascade_lookup",
    """WITH p AS (SELECT p_partkey, p_name, string_split(p_name, ' ')[-1] AS head FROM part), o(k, v) AS (VALUES ('red ring', 9.5), ('old gear', 1.25)), e AS (SELECT p_name AS k, min(p_retailprice) AS v FROM part WHERE p_size > 45 GROUP BY p_name), a AS (SELECT string_split(p_name, ' ')[-1] AS k, min(p_retailprice) AS v FROM part WHERE p_size = 7 GROUP BY 1)
SELECT p_partkey, coalesce(CAST(o.v AS DOUBLE), e.v, a.v) AS value, CASE WHEN o.v IS NOT NULL THEN 'override' WHEN e.v IS NOT NULL THEN 'exact' WHEN a.v IS NOT NULL THEN 'head' ELSE 'none' END AS matched_by FROM p LEFT JOIN o ON o.k = p_name LEFT JOIN e ON e.k = p_name LEFT JOIN a ON a.k = head""",
)
def cascade_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    overrides = spark.createDataFrame([("red ring", 9.5), ("old gear", 1.25)], "k string, v double")
    exact = part.where("p_size > 45").select(F.col("p_name").alias("k"), F.col("p_retailprice").alias("v"))
    heads = part.where("p_size = 7").select(F.substring_index("p_name", " ", -1).alias("k"), F.col("p_retailprice").alias("v"))
    rows = part.select("p_partkey", "p_name")
    steps = [("override", F.col("p_name"), overrides, "k", "v"), ("exact", F.col("p_name"), exact, "k", "v"), ("head", F.substring_index("p_name", " ", -1), heads, "k", "v")]
    return X.cascade(rows, steps).select("p_partkey", "value", "matched_by")


@query(
    "fallback_join",
    """SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(coalesce(a.s_acctbal, b.s_acctbal, 0.0)), 2) AS total FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) a ON a.s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 12) b ON b.s_suppkey = l_suppkey GROUP BY ALL""",
)
def fallback_join(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    first = supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("a"))
    second = supplier.where("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("b"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(first, "l_suppkey", "left").join(second, "l_suppkey", "left")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("a", "b", F.lit(0.0))), 2).alias("total"))


@query(
    "fuzzy_block_join",
    """WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM benchmark), p AS (SELECT conv_id * 100 + turn AS msg, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM conversations),
s AS (SELECT item_id, msg, count(*) AS shared FROM q JOIN p USING (word) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, msg) AS INT) AS nth FROM s) SELECT * FROM r WHERE nth <= 5""",
)
def fuzzy_block_join(spark, sf_dir):
    pool = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("msg"), F.col("text").alias("said"))
    return X.token_candidates(table(spark, sf_dir, "benchmark"), "item_id", "text", pool, "msg", "said", 5)


@query(
    "containment_resolve",
    """WITH q AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS w FROM part), c(c_id, c_text) AS (VALUES (1, 'red'), (2, 'red ring'), (3, 'ring'), (4, 'small promo'), (5, 'promo'), (6, 'bolt'), (7, 'bolt old')),
m AS (SELECT p_partkey, c_id, len(list_distinct(regexp_extract_all(c_text, '[a-z0-9]+'))) AS n_tokens, length(c_text) AS l FROM q JOIN c ON list_has_all(w, regexp_extract_all(c_text, '[a-z0-9]+'))),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n_tokens DESC, l, c_id) AS nth FROM m) SELECT p_partkey, c_id, CAST(n_tokens AS INT) AS n_tokens FROM r WHERE nth = 1""",
)
def containment_resolve(spark, sf_dir):
    pool = spark.createDataFrame([(1, "red"), (2, "red ring"), (3, "ring"), (4, "small promo"), (5, "promo"), (6, "bolt"), (7, "bolt old")], "c_id int, c_text string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("full"))
    return X.contained(rows, "p_partkey", "full", pool, "c_id", "c_text")


@query(
    "qualifier_variant",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), h AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS head FROM part) SELECT head, name FROM h JOIN n ON suffix(name, ' ' || head) AND len(string_split(name, ' ')) = 2""",
)
def qualifier_variant(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.substring_index("p_name", " ", -1).alias("head")).distinct()
    return names.select("head").distinct().join(names.where(F.size(F.split("name", " ")) == 2), "head").select("head", "name")


_BM25_TERMS = ("the", "thst", "erea", "ththou")


_BM25 = f"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), f AS (SELECT count(*) AS n, avg(len(w)) AS avg_len, {", ".join(f"count(*) FILTER (list_contains(w, '{x}')) AS df{i}" for i, x in enumerate(sorted(_BM25_TERMS)))} FROM t),
s AS (SELECT doc_id, {" + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * l / avg_len))" for i in range(len(_BM25_TERMS)))} AS score
  FROM (SELECT doc_id, len(w) AS l, {", ".join(f"len(list_filter(w, lambda x: x = '{x}')) AS tf{i}" for i, x in enumerate(sorted(_BM25_TERMS)))} FROM t), f),
top AS (SELECT doc_id, round(score / (SELECT max(score) FROM s), 5) AS score FROM s WHERE score > 0 ORDER BY round(score / (SELECT max(score) FROM s), 5) DESC, doc_id LIMIT 25)"""


@query("bm25_topk", f"WITH {_BM25} SELECT * FROM top")
def bm25_topk(spark, sf_dir):
    scored = X.bm25(table(spark, sf_dir, "documents"), "doc_id", T.words(F.col("text")), _BM25_TERMS)
    return scored.select("doc_id", F.round("score", 5).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@query(
    "multi_field_score",
    """SELECT p_partkey, round(greatest(6.0 * contains(p_name, 'bolt')::INT, 3.0 * contains(lower(p_type), 'promo')::INT, 1.0 * (p_brand = 'Brand#11')::INT), 3) AS score FROM part WHERE contains(p_name, 'bolt') OR contains(lower(p_type), 'promo') OR p_brand = 'Brand#11'""",
)
def multi_field_score(spark, sf_dir):
    best = F.greatest(6.0 * F.col("p_name").contains("bolt").cast("int"), 3.0 * F.lower("p_type").contains("promo").cast("int"), 1.0 * (F.col("p_brand") == "Brand#11").cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(best, 3).alias("score")).where("score > 0")


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).select("embedding").first()[0]  # one request's vector


_SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_Q = "q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@query("cosine_topk", f"WITH {_Q} SELECT vec_id, round({_SIM}, 6) AS similarity, round(1 - {_SIM}, 6) AS distance FROM embeddings e, q ORDER BY {_SIM} DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    found = X.cosine_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 20)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"), F.round(1 - F.col("similarity"), 6).alias("distance"))


@query(
    "rrf_hybrid",
    f"""WITH {_Q}, v AS (SELECT vec_id, row_number() OVER (ORDER BY {_SIM} DESC, vec_id) AS r FROM embeddings e, q), {_BM25}, l AS (SELECT doc_id AS vec_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM top)
SELECT vec_id, round(sum(1.0 / (60 + r)), 8) AS rrf FROM (SELECT * FROM v WHERE r <= 25 UNION ALL SELECT * FROM l WHERE r <= 25) GROUP BY vec_id""",
)
def rrf_hybrid(spark, sf_dir):
    vector = X.cosine_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 25).select("vec_id", F.col("similarity").alias("score"))
    lexical = bm25_topk(spark, sf_dir).withColumnRenamed("doc_id", "vec_id")
    return X.fused([vector, lexical], "vec_id", [F.desc("score"), F.col("vec_id")]).select("vec_id", F.round("rrf", 8).alias("rrf"))


@query("normalized_by_max", "SELECT p_partkey, floor(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand) * 100000 + 0.3) / 100000 AS share FROM part")
def normalized_by_max(spark, sf_dir):
    return X.normalised(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "share").select("p_partkey", steady(F.col("share"), 5).alias("share"))


@query(
    "rerank_gate",
    """WITH s AS (SELECT p_partkey, p_retailprice / 1000 AS sim, p_size / 50.0 AS lex, (p_partkey % 25) / 25.0 AS rrf, p_partkey % 3 AS ov, 2 AS nq, p_brand = 'Brand#11' AS cur, contains(p_name, 'new') AS raw, p_type = 'PROMO' AS clash FROM part),
t AS (SELECT *, 0.60 * sim + 0.30 * lex + 0.10 * rrf + 0.15 * least(1.0, ov / nq) + CASE WHEN ov = 0 AND sim < 0.9 THEN -0.5 ELSE 0 END + CASE WHEN clash THEN -1.0 ELSE 0 END + CASE WHEN cur THEN 0.06 ELSE 0 END + CASE WHEN raw THEN 0.06 ELSE 0 END AS score FROM s)
SELECT p_partkey, CASE WHEN score < 0.30 THEN 'none' WHEN score >= 0.50 AND sim >= 0.95 AND (ov > 0 OR sim >= 0.9) THEN 'strong' ELSE 'weak' END AS verdict, floor(score * 10000 + 0.3) / 10000 AS score FROM t""",
)
def rerank_gate(spark, sf_dir):
    sim, ov = F.col("p_retailprice") / 1000, F.col("p_partkey") % 3
    score = X.rerank_score(sim, F.col("p_size") / 50, (F.col("p_partkey") % 25) / 25, ov, F.lit(2), F.col("p_brand") == "Brand#11", F.col("p_name").contains("new"), F.col("p_type") == "PROMO")
    rows = table(spark, sf_dir, "part").select("p_partkey", sim.alias("sim"), ov.alias("ov"), score.alias("s"))
    return rows.select("p_partkey", X.verdict(F.col("s"), F.col("sim"), F.col("ov"), 0.95).alias("verdict"), steady(F.col("s"), 4).alias("score"))


@query("best_per_pair", "SELECT l_partkey, l_suppkey, max(l_extendedprice) AS best, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS item_id FROM lineitem GROUP BY ALL")
def best_per_pair(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("best"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("item_id"))


@query("embedding_validation", "SELECT label, count(*) FILTER (len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0) AS valid, count(*) AS n FROM embeddings GROUP BY label")
def embedding_validation(spark, sf_dir):
    ok = (F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(ok).alias("valid"), F.count("*").alias("n"))


@query("collection_page", "SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 10 OFFSET 5")
def collection_page(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("label = 3").select("vec_id", "label").orderBy("vec_id").offset(5).limit(10)


@query("sequence_ratio_rerank")
def sequence_ratio_rerank(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return top_n(names.withColumn("ratio", X.sequence_ratio(F.lit("red bolts"), F.col("name"))).withColumn("q", F.lit(1)), ["q"], [F.desc("ratio"), F.col("name")], 10).drop("q")


@query("greedy_one_to_one")
def greedy_one_to_one(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    # the last digits are the turn: two, or as many as the longest conversation needs, so that no two messages have one id
    digits = F.broadcast(turns.agg(F.greatest(F.lit(2), F.max(F.length(F.col("turn").cast("string")))).alias("digits")))
    pool = turns.crossJoin(digits).select((F.col("conv_id") * F.pow(F.lit(10.0), "digits").cast("long") + F.col("turn")).alias("msg"), F.col("text").alias("said"))
    return X.token_matches(table(spark, sf_dir, "benchmark"), "item_id", "text", pool, "msg", "said")
