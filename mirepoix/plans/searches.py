"""Queries: catalog search, relaxation, selection and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.operators import search as S
from mirepoix.plans.registry import query
from mirepoix.plans.tables import table


def _catalog(spark, sf_dir):
    """(id, title, family, class, brand, minutes, price, rank): parts as a catalog; every ninth has no time."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.substring_index("p_name", " ", -1).alias("family"), F.col("p_type").alias("class"), F.col("p_brand").alias("brand"),
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("minutes"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 5).cast("int").alias("rank"),
    )


_CATALOG = """catalog AS (SELECT p_partkey AS id, p_name AS title, string_split(p_name, ' ')[-1] AS family, p_type AS class, p_brand AS brand, CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS minutes, p_retailprice AS price, CAST(p_partkey % 5 AS INT) AS rank FROM part)"""


@query("bool_query", f"WITH {_CATALOG} SELECT id FROM catalog WHERE minutes <= 40 AND price > 905 AND NOT contains(title, 'red') AND (brand = 'Brand#11' OR class LIKE 'S%' OR rank <= 1)")
def bool_query(spark, sf_dir):
    c = S.Constraints(hard=[F.col("minutes") <= 40, F.col("price") > 905], excluded=[F.col("title").contains("red")], any_of=[F.col("brand") == "Brand#11", F.col("class").startswith("S"), F.col("rank") <= 1])
    return _catalog(spark, sf_dir).where(S.predicate(c)).select("id")


@query("missing_is_active", "SELECT o_orderkey FROM orders WHERE coalesce(nullif(o_orderstatus, 'O'), 'active') NOT IN ('F', 'deleted')")
def missing_is_active(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(S.active(F.nullif("o_orderstatus", F.lit("O")), ("F", "deleted"))).select("o_orderkey")


@query("null_passes_bounds", f"WITH {_CATALOG} SELECT id FROM catalog WHERE (minutes IS NULL OR minutes BETWEEN 5 AND 20) AND (price IS NULL OR price <= 1500)")
def null_passes_bounds(spark, sf_dir):
    return _catalog(spark, sf_dir).where(S.within(F.col("minutes"), 5, 20) & S.within(F.col("price"), None, 1500)).select("id")


@query(
    "relaxation_ladder",
    f"""WITH {_CATALOG}, l AS (SELECT id, CASE WHEN NOT coalesce(rank = 0, false) THEN 3 WHEN NOT coalesce(brand = 'Brand#11', false) THEN 2 WHEN NOT coalesce(minutes <= 10, false) THEN 1 ELSE 0 END AS level FROM catalog WHERE NOT contains(title, 'red')),
c AS (SELECT level, sum(count(*)) OVER (ORDER BY level) AS upto FROM l GROUP BY level), t AS (SELECT coalesce(min(CASE WHEN upto >= 10 THEN level END), 3) AS taken FROM c)
SELECT id, level, CASE taken WHEN 0 THEN '' WHEN 1 THEN 'minutes' WHEN 2 THEN 'brand,minutes' ELSE 'rank,brand,minutes' END AS dropped FROM l, t WHERE level <= taken""",
)
def relaxation_ladder(spark, sf_dir):
    c = S.Constraints(excluded=[F.col("title").contains("red")], soft={"rank": F.col("rank") == 0, "brand": F.col("brand") == "Brand#11", "minutes": F.col("minutes") <= 10})
    return S.relaxed(_catalog(spark, sf_dir), c, 10).select("id", "level", "dropped")


@query(
    "diverse_topk",
    f"WITH {_CATALOG}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rank, price DESC, id) AS nth FROM catalog) SELECT id, family FROM r ORDER BY (family <> '' AND nth > 2), rank, price DESC, id LIMIT 25",
)
def diverse_topk(spark, sf_dir):
    return S.diverse(_catalog(spark, sf_dir), "family", [F.col("rank"), F.desc("price"), F.col("id")], 25, 2).select("id", "family")


@query("catalog_sort_page", f"WITH {_CATALOG} SELECT id, minutes FROM catalog ORDER BY minutes ASC NULLS LAST, title DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def catalog_sort_page(spark, sf_dir):
    order = [*S.sort_columns("minutes:asc,title:desc", ["minutes", "title"]), F.col("id")]
    return S.page(_catalog(spark, sf_dir), order, 40, 20).select("id", "minutes")


@query("boosted_sort", f"WITH {_CATALOG} SELECT id, price / 100 + CASE WHEN id % 7 = 0 THEN 10.0 ELSE 0.0 END + CASE WHEN contains(title, 'bolt') THEN 5.0 ELSE 0.0 END AS score FROM catalog ORDER BY score DESC, id LIMIT 30")
def boosted_sort(spark, sf_dir):
    score = S.boosted(F.col("price") / 100, [(F.col("id") % 7 == 0, 10.0), (F.col("title").contains("bolt"), 5.0)])
    return _catalog(spark, sf_dir).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(30)


@query("quota_after_filter", f"WITH {_CATALOG}, r AS (SELECT id, family, row_number() OVER (PARTITION BY family ORDER BY rank, id) AS nth FROM catalog WHERE minutes > 5) SELECT id, family FROM r WHERE nth <= 3")
def quota_after_filter(spark, sf_dir):
    from mirepoix.operators.report import top_n

    return top_n(_catalog(spark, sf_dir).where("minutes > 5"), ["family"], [F.col("rank"), F.col("id")], 3).select("id", "family")


@query(
    "tier_assignment",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'excluded' WHEN o_orderstatus = 'F' AND o_totalprice < 20000 THEN 'excluded' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'preferred' ELSE 'standard' END AS tier, CASE WHEN o_orderkey % 11 = 0 THEN 'manual' WHEN o_orderstatus = 'F' AND o_totalprice < 20000 THEN 'small' END AS reason FROM orders",
)
def tier_assignment(spark, sf_dir):
    manual, small = F.col("o_orderkey") % 11 == 0, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 20000)
    good = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(manual | small, "excluded").when(good, "preferred").otherwise("standard").alias("tier"), F.when(manual, "manual").when(small, "small").alias("reason"))


@query("vocab_accept_reject", "SELECT value, value IN (SELECT p_brand FROM part) AS accepted FROM (SELECT DISTINCT 'Brand#' || (p_partkey % 60) AS value FROM part)")
def vocab_accept_reject(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    values = part.select(F.concat(F.lit("Brand#"), F.col("p_partkey") % 60).alias("value")).distinct()
    return S.accepted(values, "value", part, "p_brand")


@query("autocomplete", "SELECT p_name AS suggestion FROM (SELECT DISTINCT p_name FROM part WHERE contains(' ' || p_name || ' ', ' bo')) ORDER BY length(p_name), p_name LIMIT 10")
def autocomplete(spark, sf_dir):
    return S.prefix_suggestions(_catalog(spark, sf_dir), "title", "bo")


@query("worst_grade_filter", f"WITH {_CATALOG} SELECT id, rank FROM catalog WHERE rank <= 2 AND class IS NOT NULL")
def worst_grade_filter(spark, sf_dir):
    return _catalog(spark, sf_dir).where(F.col("class").isNotNull() & (F.col("rank") <= 2)).select("id", "rank")


@query("visible_to_role", """WITH r(role, status) AS (VALUES ('admin', 'F'), ('admin', 'O'), ('admin', 'P'), ('member', 'O'), ('member', 'P'))
SELECT role, status, count(*) AS n FROM orders JOIN r ON o_orderstatus = status GROUP BY ALL""")
def visible_to_role(spark, sf_dir):
    roles = {"admin": ["F", "O", "P"], "member": ["O", "P"]}
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    may = F.explode(F.array_compact(F.array(*(F.when(F.col("status").isin(seen), role) for role, seen in roles.items()))))
    return counts.select(may.alias("role"), "status", "n")


@query(
    "meal_plan_slots",
    f"""WITH {_CATALOG}, r AS (SELECT id, (row_number() OVER (ORDER BY rank, price DESC, id) - 1) AS pos FROM catalog WHERE family <> 'ring') SELECT CAST(pos // 3 AS INT) AS slot, id FROM r WHERE pos < 21""",
)
def meal_plan_slots(spark, sf_dir):
    best = _catalog(spark, sf_dir).where("family <> 'ring'").orderBy("rank", F.desc("price"), "id").limit(21)
    from pyspark.sql import Window as W

    # 21 rows: a plan takes its slots from one ranked list, so no slot can repeat another's item
    pos = F.row_number().over(W.orderBy("rank", F.desc("price"), "id")) - 1
    return best.select(F.floor(pos / 3).cast("int").alias("slot"), "id")


def _day_plan(spark, sf_dir, days: int = 3, per_day: int = 2):
    """Days are filled in turn from what the days before left, at most one of a family a day: a fold over few days."""
    pool, chosen = _catalog(spark, sf_dir).where(F.col("minutes").isNotNull()), None
    for day in range(days):
        left = pool if chosen is None else pool.join(F.broadcast(chosen.select("id")), "id", "left_anti")
        today = S.diverse(left, "family", [F.col("rank"), F.col("id")], per_day).select(F.lit(day).alias("day"), "id", "family")
        chosen = today if chosen is None else chosen.union(today)
    return chosen


@query(
    "cross_day_exclusion",
    f"""WITH {_CATALOG}, p AS (SELECT * FROM catalog WHERE minutes IS NOT NULL), d0 AS (SELECT id, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rank, id) AS nth FROM p) ORDER BY nth > 1, rank, id LIMIT 2),
d1 AS (SELECT id, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rank, id) AS nth FROM p WHERE id NOT IN (SELECT id FROM d0)) ORDER BY nth > 1, rank, id LIMIT 2),
d2 AS (SELECT id, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rank, id) AS nth FROM p WHERE id NOT IN (SELECT id FROM d0 UNION ALL SELECT id FROM d1)) ORDER BY nth > 1, rank, id LIMIT 2)
SELECT 0 AS day, * FROM d0 UNION ALL SELECT 1, * FROM d1 UNION ALL SELECT 2, * FROM d2""",
)
def cross_day_exclusion(spark, sf_dir):
    return _day_plan(spark, sf_dir)


@query("seeded_sample")
def seeded_sample(spark, sf_dir):
    return _catalog(spark, sf_dir).orderBy(*S.shuffled_order("id", 13)).limit(20).select("id")
