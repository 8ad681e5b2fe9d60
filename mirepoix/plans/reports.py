"""Queries: subtotals, facets, distributions, outliers, deviations, agreement, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mirepoix.functions import scoring
from mirepoix.operators import report
from mirepoix.plans.nutrition import _sql_grade
from mirepoix.plans.registry import query
from mirepoix.plans.tables import LINES, REGIONS, SCORES, lines, parts, regions, scores, steady, table


@query(
    "subtotal_all_rows",
    f"""WITH {LINES}, {REGIONS}, g AS (SELECT CASE WHEN grouping(region) = 1 THEN 'ALL' ELSE region END AS region, l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 2) AS quantity
  FROM lineitem JOIN regions ON l_suppkey = source_id GROUP BY GROUPING SETS ((region, l_returnflag), (l_returnflag))) SELECT * FROM g""",
)
def subtotal_all_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("flag"), "l_quantity").join(regions(spark, sf_dir), "source_id")
    return report.with_subtotals(rows, "region", ["flag"], [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")])


@query(
    "topn_per_scope",
    f"""WITH {REGIONS}, g AS (SELECT CASE WHEN grouping(region) = 1 THEN 'ALL' ELSE region END AS region, p_name, count(DISTINCT l_orderkey) AS n
  FROM lineitem JOIN regions ON l_suppkey = source_id JOIN part ON l_partkey = p_partkey GROUP BY GROUPING SETS ((region, p_name), (p_name))),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY n DESC, p_name) AS INT) AS nth FROM g) SELECT * FROM r WHERE nth <= 5""",
)
def topn_per_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("source_id"))
    rows = rows.join(regions(spark, sf_dir), "source_id").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    # distinct (region, name, item) first: then plain counts, without a distinct expansion over the grouping sets
    pairs = rows.select("region", "p_name", "l_orderkey").distinct()
    scoped = pairs.groupBy("region", "p_name").agg(F.count("*").alias("n")).unionByName(pairs.select("p_name", "l_orderkey").distinct().groupBy("p_name").agg(F.count("*").alias("n")).withColumn("region", F.lit("ALL")))
    return report.top_n(scoped, ["region"], [F.desc("n"), F.col("p_name")], 5)


@query(
    "facet_counts",
    """WITH f AS (SELECT 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'word', unnest(string_split(p_name, ' ')) FROM part),
c AS (SELECT field, value, count(*) AS n FROM f GROUP BY field, value), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS nth FROM c) SELECT field, value, n FROM r WHERE nth <= 10""",
)
def facet_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.split("p_name", " ").alias("word"))
    return report.facet_counts(rows, ["brand", "type", "word"], 10)


@query(
    "facet_folded",
    """WITH c AS (SELECT 'priority' AS field, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY o_orderpriority)
SELECT field, CASE WHEN value IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN value IN ('4-NOT SPECIFIED', '5-LOW') THEN 'low' ELSE value END AS value, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2""",
)
def facet_folded(spark, sf_dir):
    counts = report.facet_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")), ["priority"])
    folds = [("1-URGENT", "high"), ("2-HIGH", "high"), ("4-NOT SPECIFIED", "low"), ("5-LOW", "low")]
    return report.folded(counts, "value", spark.createDataFrame(folds, "variant string, canonical string"), "variant", "canonical")


@query(
    "facet_union_all",
    """SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'flag', l_returnflag, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 2""",
)
def facet_union_all(spark, sf_dir):
    status = table(spark, sf_dir, "orders").groupBy(F.lit("status").alias("facet"), F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n"))
    flag = table(spark, sf_dir, "lineitem").groupBy(F.lit("flag").alias("facet"), F.col("l_returnflag").alias("value")).agg(F.count_distinct("l_orderkey").alias("n"))
    return status.unionByName(flag)


@query("count_total", "SELECT count(*) AS n_total FROM part WHERE p_size BETWEEN 10 AND 30 AND p_type <> 'PROMO'")
def count_total(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size between 10 and 30 and p_type <> 'PROMO'").agg(F.count("*").alias("n_total"))


@query("row_count_union", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("part", "orders", "lineitem", "events", "documents", "labels")))
def row_count_union(spark, sf_dir):
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("part", "orders", "lineitem", "events", "documents", "labels")]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query(
    "summary_stats",
    f"""WITH {REGIONS}, l AS (SELECT region, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem JOIN regions ON l_suppkey = source_id),
u AS (UNPIVOT l ON quantity, price INTO NAME measure VALUE value)
SELECT region, measure, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(min(value), 4) AS least, round(max(value), 4) AS most FROM u GROUP BY region, measure""",
)
def summary_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return report.summary(rows.join(regions(spark, sf_dir), "source_id"), ["region"], ["quantity", "price"])


@query(
    "median_pct_deviation",
    f"""WITH {REGIONS}, d AS (SELECT region, l_extendedprice AS calc, l_quantity * p_retailprice AS ref FROM lineitem JOIN regions ON l_suppkey = source_id JOIN part ON l_partkey = p_partkey)
SELECT region, round(median(CASE WHEN ref = 0 AND calc = 0 THEN 0.0 WHEN ref = 0 THEN NULL ELSE abs(calc - ref) / abs(ref) * 100 END), 4) AS median_deviation, count(*) AS n FROM d GROUP BY region""",
)
def median_pct_deviation(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "source_id").join(regions(spark, sf_dir), "source_id").join(part, "l_partkey")
    deviation = report.deviation_pct(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))
    rows = rows.select("region", deviation.alias("deviation"))
    medians = report.distribution(rows, ["region"], "deviation", {"median": 0.5}).select("region", F.round("median", 4).alias("median_deviation"))
    return rows.groupBy("region").agg(F.count("*").alias("n")).join(medians, "region", "left")


@query(
    "grade_distribution_filled",
    f"""WITH {SCORES}, g AS (SELECT region, {_sql_grade('score % 3')} AS grade FROM scores), c AS (SELECT region, grade, count(*) AS n FROM g GROUP BY ALL),
f AS (SELECT r.region, d.grade, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT region FROM g) r CROSS JOIN (SELECT unnest(['A','B','C','D','E']) AS grade) d LEFT JOIN c ON c.region = r.region AND c.grade = d.grade)
SELECT region, grade, n, round(n / nullif(sum(n) OVER (PARTITION BY region), 0) * 100, 4) AS pct FROM f""",
)
def grade_distribution_filled(spark, sf_dir):
    rows = scores(spark, sf_dir).select("region", scoring.grade(F.col("score") % 3).alias("grade"))
    return report.filled_distribution(rows, "region", "grade", spark.createDataFrame([(g,) for g in "ABCDE"], "grade string"))


@query(
    "confusion_matrix",
    """WITH p AS (SELECT l.quality AS actual, CAST(d.n_chars > 1500 AS INT) AS predicted FROM labels l JOIN documents d USING (doc_id)), v AS (SELECT unnest([0, 1]) AS v),
c AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY ALL), f AS (SELECT a.v AS actual, b.v AS predicted, coalesce(n, 0) AS n FROM v a CROSS JOIN v b LEFT JOIN c ON c.actual = a.v AND c.predicted = b.v)
SELECT actual, predicted, n, CAST(sum(n) OVER (PARTITION BY actual) AS BIGINT) AS row_total, round(n / nullif(sum(n) OVER (PARTITION BY actual), 0) * 100, 4) AS row_pct FROM f""",
)
def confusion_matrix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("predicted"))
    pairs = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("actual")).join(docs, "doc_id")
    return report.confusion(pairs, "actual", "predicted", [0, 1])


@query(
    "tukey_outliers",
    """WITH p AS (SELECT l_returnflag AS flag, CAST(l_extendedprice AS DOUBLE) * (1 + (l_partkey % 97 = 0)::INT * 9) AS v FROM lineitem WHERE l_extendedprice > 0),
s AS (SELECT flag, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM p GROUP BY flag)
SELECT flag, n, round(mean, 3) AS mean, round(q1, 3) AS q1, round(median, 3) AS median, round(q3, 3) AS q3, round(q3 + 1.5 * (q3 - q1), 3) AS high,
  (SELECT count(*) FROM p WHERE p.flag = s.flag AND v > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM s""",
)
def tukey_outliers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") * F.when(F.col("l_partkey") % 97 == 0, 10).otherwise(1)).alias("v"))
    found = report.outliers(rows, ["flag"], "v", parts=parts(spark, sf_dir, "lineitem"))
    return found.select("flag", "n", *(F.round(c, 3).alias(c) for c in ("mean", "q1", "median", "q3", "high")), "n_outliers")


@query(
    "over_cap_rejects",
    """WITH i AS (SELECT o_orderkey, nullif(o_totalprice, 0) AS kcal FROM orders)
SELECT o_orderkey, round(kcal, 2) AS kcal FROM i WHERE kcal IS NOT NULL AND kcal > 100000 ORDER BY kcal DESC, o_orderkey LIMIT 20""",
)
def over_cap_rejects(spark, sf_dir):
    kcal = F.nullif(F.col("o_totalprice"), F.lit(0.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kcal.alias("kcal")).where("kcal > 100000")
    return rows.orderBy(F.desc("kcal"), "o_orderkey").limit(20).select("o_orderkey", F.round("kcal", 2).alias("kcal"))


@query("keep_null_or_under_cap", "SELECT count(*) AS n, round(sum(kcal), 2) AS kcal FROM (SELECT nullif(o_totalprice, o_totalprice * (o_orderkey % 5 = 0)::INT) AS kcal FROM orders) WHERE kcal IS NULL OR kcal <= 100000")
def keep_null_or_under_cap(spark, sf_dir):
    kcal = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select(kcal.alias("kcal")).where(F.col("kcal").isNull() | (F.col("kcal") <= 100000))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("kcal"), 2).alias("kcal"))


@query("status_counts", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("usage_frequency", "SELECT p_name, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name HAVING count(DISTINCT l_orderkey) >= 10")
def usage_frequency(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy("p_name").agg(F.count_distinct("l_orderkey").alias("n")).where("n >= 10")


@query(
    "cleanup_impact",
    """WITH per AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n, count(DISTINCT CASE WHEN p_size <= 10 THEN l_partkey END) AS dropped FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT count(*) FILTER (dropped > 0) AS touched, count(*) FILTER (n >= 3 AND n - dropped < 3) AS below_minimum, count(*) AS items FROM per""",
)
def cleanup_impact(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") <= 10).alias("bad"))
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().join(part, "l_partkey")
    per = pairs.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if("bad").alias("dropped"))
    return per.agg(F.count_if(F.expr("dropped > 0")).alias("touched"), F.count_if(F.expr("n >= 3 and n - dropped < 3")).alias("below_minimum"), F.count("*").alias("items"))


@query("few_components_tag", "SELECT o_orderkey, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(DISTINCT l_partkey) <= 3")
def few_components_tag(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_partkey").alias("n"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(counted, "o_orderkey", "left").where("n > 0 and n <= 3")


@query(
    "co2_summary",
    f"""WITH {REGIONS}, c AS (SELECT region, CASE WHEN l_partkey % 10 = 0 THEN 0.0 ELSE l_quantity * l_discount END AS co2 FROM lineitem JOIN regions ON l_suppkey = source_id)
SELECT region, count(*) AS n, round(avg(co2), 4) AS mean, round(median(CAST(co2 AS DOUBLE)), 4) AS median, round(max(co2), 4) AS most, count(*) FILTER (co2 = 0) AS zeros, round(stddev_pop(co2), 4) AS spread FROM c GROUP BY region""",
)
def co2_summary(spark, sf_dir):
    co2 = F.when(F.col("l_partkey") % 10 == 0, 0.0).otherwise(F.col("l_quantity") * F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), co2.alias("co2")).join(regions(spark, sf_dir), "source_id")
    medians = report.distribution(rows, ["region"], "co2", {"median": 0.5}).select("region", F.round("median", 4).alias("median"))
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.round(F.avg("co2"), 4).alias("mean"), F.round(F.max("co2"), 4).alias("most"), F.count_if(F.expr("co2 = 0")).alias("zeros"), F.round(F.stddev_pop("co2"), 4).alias("spread")).join(medians, "region")


@query(
    "kcal_buckets",
    """WITH b AS (SELECT CASE WHEN v IS NULL THEN 'missing' WHEN v < 1000 THEN '<1k' WHEN v < 50000 THEN '1k-50k' WHEN v < 150000 THEN '50k-150k' ELSE 'more' END AS bucket, v
  FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)) SELECT bucket, count(*) AS n, round(avg(v), 3) AS mean FROM b GROUP BY bucket""",
)
def kcal_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"))
    bucket = report.bucketed(F.col("v"), [1000, 50000, 150000], ["<1k", "1k-50k", "50k-150k", "more"])
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 3).alias("mean"))


@query(
    "upper_median",
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(value, 5) AS upper_median FROM r WHERE nth = n // 2 + 1""",
)
def upper_median(spark, sf_dir):
    from pyspark.sql import Window as W

    of = W.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(of.orderBy("value", "event_id")).alias("nth"), F.count("*").over(of).alias("n"))
    return rows.where(F.col("nth") == F.floor(F.col("n") / 2) + 1).select("user_id", F.round("value", 5).alias("upper_median"))


@query(
    "pairwise_agreement",
    """WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \n]+'), lambda x: x <> '')) AS b FROM benchmark)
SELECT item_id, len(list_intersect(a, b)) AS shared, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 5) AS jaccard, len(a) = len(b) AS exact FROM w""",
)
def pairwise_agreement(spark, sf_dir):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    rows = table(spark, sf_dir, "benchmark").select("item_id", words("text").alias("a"), F.array_distinct(F.filter(F.split(F.lower("text"), "[ \n]+"), lambda x: x != "")).alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return rows.select("item_id", shared.cast("long").alias("shared"), F.round(shared / F.size(F.array_union("a", "b")), 5).alias("jaccard"), (F.size("a") == F.size("b")).alias("exact"))


@query(
    "canonical_aliases",
    """WITH n AS (SELECT doc_id, lower(trim(source)) AS canonical, lang FROM documents) SELECT canonical, string_agg(DISTINCT lang, ',' ORDER BY lang) AS aliases, count(DISTINCT doc_id) AS n_docs FROM n GROUP BY canonical""",
)
def canonical_aliases(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source")).alias("canonical"), "lang")
    return rows.groupBy("canonical").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("aliases"), F.count_distinct("doc_id").alias("n_docs"))


@query(
    "ordered_distinct",
    """SELECT conv_id, string_agg(role, '>' ORDER BY first_turn, role) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""",
)
def ordered_distinct(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("first_turn", "role"))), lambda x: x["role"])
    return first.groupBy("conv_id").agg(F.array_join(ordered, ">").alias("roles"))


@query("median_density", "SELECT p_brand, round(median(CAST(p_retailprice / p_size AS DOUBLE)), 4) AS density, count(*) AS n FROM part WHERE p_size > 4 GROUP BY p_brand")
def median_density(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_size > 4").select("p_brand", (F.col("p_retailprice") / F.col("p_size")).alias("density"))
    found = report.distribution(rows, ["p_brand"], "density", {"median": 0.5})
    return found.select("p_brand", F.round("median", 4).alias("density"), "n")


@query("null_audit", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(*) FILTER ({e}) AS n_missing, round((count(*) - count(*) FILTER ({e})) / count(*) * 100, 4) AS pct_complete FROM documents" for c, e in (("text", "text IS NULL OR trim(text) = ''"), ("lang", "lang IS NULL OR trim(lang) = '' OR lang = 'fr'"), ("n_chars", "n_chars IS NULL OR n_chars < 100"))))
def null_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("text", F.nullif("lang", F.lit("fr")).alias("lang"), F.when(F.col("n_chars") >= 100, F.col("n_chars")).alias("n_chars"))
    return report.completeness(rows, ["text", "lang", "n_chars"])


@query(
    "completeness_issues",
    """SELECT issues, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN source IN ('src0', 'src1') THEN 'hot' END) AS issues FROM documents) GROUP BY issues""",
)
def completeness_issues(spark, sf_dir):
    issues = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "foreign"), F.when(F.col("source").isin("src0", "src1"), "hot")))
    return table(spark, sf_dir, "documents").groupBy(F.array_join(issues, ",").alias("issues")).agg(F.count("*").alias("n"))


@query(
    "grouped_examples",
    """WITH d AS (SELECT DISTINCT p_type, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_name) AS nth FROM d)
SELECT p_type, count(*) AS n_distinct, string_agg(CASE WHEN nth <= 3 THEN p_name END, ',' ORDER BY p_name) AS examples FROM r GROUP BY p_type""",
)
def grouped_examples(spark, sf_dir):
    return report.samples(table(spark, sf_dir, "part"), ["p_type"], "p_name", 3)


@query(
    "day_totals_complete",
    """SELECT CAST(o_orderdate AS DATE) AS day, floor(sum(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END) * 10 + 0.3) / 10 AS total, bool_and(o_orderkey % 9 <> 0) AS complete, count(*) AS n FROM orders GROUP BY 1""",
)
def day_totals_complete(spark, sf_dir):
    known = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), known.alias("v"))
    return rows.groupBy("day").agg(steady(F.sum("v"), 1).alias("total"), F.bool_and(F.col("v").isNotNull()).alias("complete"), F.count("*").alias("n"))


@query(
    "percentile_by_index",
    """SELECT lang, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n_chars, 0.9) AS BIGINT) AS p90 FROM documents GROUP BY lang""",
)
def percentile_by_index(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    rows.createOrReplaceTempView("mirepoix_documents")
    return spark.sql("SELECT lang, percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY n_chars) AS p90 FROM mirepoix_documents GROUP BY lang").select("lang", F.col("p50").cast("long").alias("p50"), F.col("p90").cast("long").alias("p90"))


@query(
    "quantity_coverage",
    f"""WITH {LINES} SELECT item_id, round(count(*) FILTER (weight_g > 100) / count(*) * 100, 4) AS quantity_pct, round(sum(CASE WHEN fat_g > 2 THEN weight_g END) / nullif(sum(CASE WHEN weight_g > 100 THEN weight_g END), 0) * 100, 4) AS measure_pct FROM lines GROUP BY item_id""",
)
def quantity_coverage(spark, sf_dir):
    heavy = F.col("weight_g") > 100
    measured = F.sum(F.when(F.col("fat_g") > 2, F.col("weight_g"))) / F.nullif(F.sum(F.when(heavy, F.col("weight_g"))), F.lit(0.0)) * 100
    return lines(spark, sf_dir).groupBy("item_id").agg(F.round(F.count_if(heavy) / F.count("*") * 100, 4).alias("quantity_pct"), F.round(measured, 4).alias("measure_pct"))
