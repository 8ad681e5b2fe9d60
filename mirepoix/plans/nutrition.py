"""Queries: roll-ups, scores, coverage and preferred profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.functions import scoring
from mirepoix.operators import rollup
from mirepoix.plans.registry import query
from mirepoix.plans.tables import LINES, REGIONS, SCORES, lines, regions, rounded, scores, steady, table


def _sql_points(value: str, thresholds) -> str:
    return "(" + " + ".join(f"CAST({value} > {t} AS INT)" for t in thresholds) + ")"


def _sql_grade(score: str) -> str:
    return "CASE WHEN " + score + " IS NULL THEN NULL " + " ".join(f"WHEN {score} <= {m} THEN '{g}'" for m, g in scoring.GRADES) + f" ELSE '{scoring.LAST_GRADE}' END"


_TOTALS = f"""WITH {LINES}, totals AS (SELECT item_id, sum(weight_g) AS total_weight_g, sum(weight_g / 100 * energy_kcal) AS energy_kcal,
  sum(weight_g / 100 * fat_g) AS fat_g, sum(weight_g / 100 * salt_g) AS salt_g FROM lines GROUP BY item_id),
per AS (SELECT item_id, total_weight_g, energy_kcal, fat_g, salt_g, energy_kcal / total_weight_g * 100 AS kcal100, fat_g / total_weight_g * 100 AS fat100,
  salt_g / total_weight_g * 100 AS salt100 FROM totals)"""
_NEGATIVE = f"{_sql_points('kcal100 * 4.184 / 4', scoring.ENERGY_KJ)} + {_sql_points('fat100', scoring.SATURATED_G)} + {_sql_points('salt100 * 50', scoring.SODIUM_MG)}"


def _profiles(spark, sf_dir):
    totals = rollup.weighted_totals(lines(spark, sf_dir, placed=True), "item_id", "weight_g", ["energy_kcal", "fat_g", "salt_g"], "place")
    w = F.col("total_weight_g")
    return totals.withColumns({c: scoring.per_100g(F.col(m), w) for c, m in (("kcal100", "energy_kcal"), ("fat100", "fat_g"), ("salt100", "salt_g"))})


def _score():
    zero = F.lit(0.0)
    return scoring.score(F.col("kcal100") * scoring.KJ_PER_KCAL / 4, zero, F.col("fat100"), F.col("salt100") * 50, zero, zero, zero)


@query(
    "profile_rollup",
    f"""{_TOTALS}, scored AS (SELECT *, {_NEGATIVE} AS score FROM per)
SELECT item_id, round(total_weight_g, 4) AS total_weight_g, round(energy_kcal, 4) AS energy_kcal, round(fat_g, 4) AS fat_g, round(salt_g, 4) AS salt_g, score,
  {_sql_grade('score')} AS grade FROM scored""",
)
def profile_rollup(spark, sf_dir):
    scored = _profiles(spark, sf_dir).withColumn("score", _score())
    values = [rounded(F.col(c), 4).alias(c) for c in ("total_weight_g", "energy_kcal", "fat_g", "salt_g")]
    return scored.select("item_id", *values, "score", scoring.grade(F.col("score")).alias("grade"))


@query(
    "profile_per_serving",
    f"""{_TOTALS}, given AS (SELECT per.*, CAST(p.n AS DOUBLE) AS parsed FROM per LEFT JOIN (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 90 AS n FROM orders) p ON item_id = o_orderkey),
s AS (SELECT *, CASE WHEN parsed BETWEEN 1 AND 50 THEN round_even(parsed, 0) WHEN total_weight_g > 0 AND total_weight_g <= 7200 THEN greatest(1.0, least(16.0, round_even(total_weight_g / 450, 0)))
  WHEN total_weight_g > 0 THEN 4.0 ELSE 1.0 END AS serves, CASE WHEN parsed BETWEEN 1 AND 50 THEN 'given' ELSE 'estimated' END AS serves_source FROM given)
SELECT item_id, CAST(serves AS DOUBLE) AS serves, serves_source, floor(energy_kcal / serves * 1000 + 0.3) / 1000 AS kcal_per_serving, floor(fat_g / serves * 1000 + 0.3) / 1000 AS fat_per_serving FROM s""",
)
def profile_per_serving(spark, sf_dir):
    parsed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), (F.floor("o_totalprice") % 90).cast("double").alias("parsed"))
    count, source = scoring.serves(F.col("parsed"), F.col("total_weight_g"))
    rows = _profiles(spark, sf_dir).join(parsed, "item_id", "left").select("*", count.alias("serves"), source.alias("serves_source"))
    per = lambda c: steady(scoring.per_serving(F.col(c), F.col("serves")), 3)
    return rows.select("item_id", "serves", "serves_source", per("energy_kcal").alias("kcal_per_serving"), per("fat_g").alias("fat_per_serving"))


@query(
    "score_points",
    f"""{_TOTALS} SELECT item_id, {_sql_points('kcal100 * 4.184 / 4', scoring.ENERGY_KJ)} AS energy_points, {_sql_points('fat100', scoring.SATURATED_G)} AS fat_points,
  {_sql_points('salt100 * 50', scoring.SODIUM_MG)} AS sodium_points, CAST(({_NEGATIVE}) >= 11 AS BOOLEAN) AS protein_excluded FROM per""",
)
def score_points(spark, sf_dir):
    kj, fat, sodium = scoring.points(F.col("kcal100") * scoring.KJ_PER_KCAL / 4, scoring.ENERGY_KJ), scoring.points(F.col("fat100"), scoring.SATURATED_G), scoring.points(F.col("salt100") * 50, scoring.SODIUM_MG)
    return _profiles(spark, sf_dir).select("item_id", kj.alias("energy_points"), fat.alias("fat_points"), sodium.alias("sodium_points"), (kj + fat + sodium >= 11).alias("protein_excluded"))


@query(
    "score_grade",
    f"""WITH {SCORES}, g AS (SELECT item_id, region, score, {_sql_grade('score')} AS grade FROM scores)
SELECT item_id, region, score, grade, 'Nutriscore_' || grade AS label, CAST(strpos('ABCDE', grade) AS INT) AS grade_rank,
  CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.75 WHEN 'C' THEN 0.5 WHEN 'D' THEN 0.25 ELSE 0.0 END::DOUBLE AS grade_value,
  CASE grade WHEN 'A' THEN 'green' WHEN 'B' THEN 'light green' WHEN 'C' THEN 'yellow' WHEN 'D' THEN 'orange' ELSE 'red' END AS colour FROM g""",
)
def score_grade(spark, sf_dir):
    rows = scores(spark, sf_dir).select("item_id", "region", "score", scoring.grade(F.col("score")).alias("grade")).withColumn("label", F.concat(F.lit("Nutriscore_"), "grade"))
    return rows.select("*", scoring.grade_rank(F.col("label")).alias("grade_rank"), scoring.grade_value(F.col("grade")).alias("grade_value"), scoring.colour(F.col("grade")).alias("colour"))


@query(
    "coverage_ratio",
    f"""WITH {LINES} SELECT item_id, round_even(sum(CASE WHEN p_size > 10 THEN weight_g ELSE 0 END) / nullif(sum(weight_g), 0), 4) AS coverage,
  round_even(sum(CASE WHEN p_size > 10 THEN weight_g ELSE 0 END) / nullif(sum(weight_g), 0), 4) < 0.8 AS low_coverage FROM lines JOIN part ON food_id = p_partkey GROUP BY item_id""",
)
def coverage_ratio(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("food_id"), "p_size")
    return rollup.coverage(lines(spark, sf_dir).join(part, "food_id"), "item_id", "weight_g", F.col("p_size") > 10)


@query(
    "eligible_share_pct",
    f"""WITH {LINES} SELECT item_id, round(sum(CASE WHEN p_type LIKE 'S%' THEN weight_g ELSE 0 END) / nullif(sum(weight_g), 0) * 100, 4) AS eligible_pct,
  round(sum(CASE WHEN p_size > 5 THEN weight_g ELSE 0 END) / nullif(sum(weight_g), 0) * 100, 4) AS classified_pct FROM lines JOIN part ON food_id = p_partkey GROUP BY item_id""",
)
def eligible_share_pct(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("food_id"), "p_size", "p_type")
    rows = rollup.eligible_share(lines(spark, sf_dir).join(part, "food_id"), "item_id", "weight_g", F.col("p_type").startswith("S"), F.col("p_size") > 5)
    return rows.select("item_id", F.round("eligible_pct", 4).alias("eligible_pct"), F.round("classified_pct", 4).alias("classified_pct"))


@query(
    "carbon_rollup",
    f"""WITH {LINES} SELECT item_id, round(sum(weight_g / 1000 * p_retailprice), 4) AS co2e, round(sum(weight_g / 1000 * p_retailprice) / nullif(sum(weight_g), 0) * 1000, 4) AS co2e_per_kg
FROM lines JOIN part ON food_id = p_partkey GROUP BY item_id""",
)
def carbon_rollup(spark, sf_dir):
    factors = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("food_id"), (F.col("p_retailprice") / 10).alias("factor"))
    totals = rollup.weighted_totals(lines(spark, sf_dir).join(factors, "food_id", "left"), "item_id", "weight_g", ["factor"])
    return totals.select("item_id", F.round("factor", 4).alias("co2e"), F.round(F.col("factor") / F.nullif(F.col("total_weight_g"), F.lit(0)) * 1000, 4).alias("co2e_per_kg"))


@query(
    "open_unit_rollup",
    """WITH u AS (SELECT l_orderkey AS item_id, l_returnflag AS measure, l_linestatus AS unit, l_quantity AS value,
  first_value(l_linestatus) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS first_unit FROM lineitem)
SELECT item_id, measure, first_unit AS unit, round(sum(CASE WHEN unit = first_unit THEN value END), 4) AS total, CAST(sum(CASE WHEN unit <> first_unit THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped
FROM u GROUP BY item_id, measure, first_unit""",
)
def open_unit_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("measure"), F.col("l_linestatus").alias("unit"), F.col("l_quantity").alias("value"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    found = rollup.consistent_totals(rows, ["item_id", "measure"], "unit", "value", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return found.select("item_id", "measure", "unit", F.round("total", 4).alias("total"), "n_skipped")


@query(
    "capped_weights",
    f"""WITH {LINES}, s AS (SELECT *, 1 + item_id % 3 AS serves, sum(weight_g * 12) OVER (PARTITION BY item_id) AS total, max(weight_g * 12) OVER (PARTITION BY item_id) AS top,
  row_number() OVER (PARTITION BY item_id ORDER BY weight_g * 12 DESC, position, food_id, source_id, energy_kcal) AS nth FROM lines),
c AS (SELECT item_id, CASE WHEN total <= serves * 2500 THEN weight_g * 12 WHEN top > 0.55 * total THEN CASE WHEN nth = 1 THEN greatest(weight_g * 12 * 0.05, weight_g * 12 - (total - serves * 700)) ELSE weight_g * 12 END
  ELSE weight_g * 12 * serves * 2500 / total END AS w, total > serves * 2500 AS capped FROM s)
SELECT item_id, round(sum(w), 3) AS capped_total, bool_or(capped) AS was_capped, count(*) AS n_lines FROM c GROUP BY item_id""",
)
def capped_weights(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumns({"grams": F.col("weight_g") * 12, "serves": 1 + F.col("item_id") % 3})
    capped = rollup.capped_weights(rows, "item_id", "grams", "serves", ["position", "food_id", "source_id", "energy_kcal"])
    return capped.groupBy("item_id").agg(F.round(F.sum("capped_weight"), 3).alias("capped_total"), F.bool_or("was_capped").alias("was_capped"), F.count("*").alias("n_lines"))


@query(
    "nutrition_claims",
    """WITH p AS (SELECT p_partkey, p_retailprice / 20 AS kcal, p_size / 10.0 AS fat, p_size % 7 AS fibre, p_size % 11 AS protein FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN kcal <= 40 THEN 'low_calorie' END, CASE WHEN fat <= 3 THEN 'low_fat' END, CASE WHEN fibre >= 6 OR fibre / kcal * 100 >= 3 THEN 'high_fibre' END,
  CASE WHEN protein * 4 / kcal >= 0.2 THEN 'high_protein' END) AS claims FROM p""",
)
def nutrition_claims(spark, sf_dir):
    size = F.col("p_size")
    found = scoring.claims(F.col("p_retailprice") / 20, size / 10, size % 7, size % 11)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("claims"))


@query(
    "preferred_source_row",
    f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE region WHEN 'EUROPE' THEN 0 WHEN 'AMERICA' THEN 1 ELSE 2 END, region, updated_at DESC, score) AS nth FROM scores)
SELECT item_id, region, score FROM r WHERE nth = 1 AND score <= 0""",
)
def preferred_source_row(spark, sf_dir):
    rank = F.when(F.col("region") == "EUROPE", 0).when(F.col("region") == "AMERICA", 1).otherwise(2)
    best = rollup.best_row(scores(spark, sf_dir), ["item_id"], [rank, F.col("region"), F.desc("updated_at"), F.col("score")])
    return best.where("score <= 0").select("item_id", "region", "score")


@query(
    "latest_row",
    """SELECT user_id, event_type, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1""",
)
def latest_row(spark, sf_dir):
    best = rollup.best_row(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return best.select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query(
    "last_ok_attempt",
    """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def last_ok_attempt(spark, sf_dir):
    ok = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return ok.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query(
    "first_per_priority",
    f"""WITH {SCORES}, r AS (SELECT DISTINCT item_id, region FROM scores)
SELECT item_id, arg_min(region, CASE region WHEN 'ASIA' THEN 0 WHEN 'AFRICA' THEN 1 WHEN 'EUROPE' THEN 2 WHEN 'AMERICA' THEN 3 ELSE 4 END) AS region, count(*) AS n_regions FROM r GROUP BY item_id""",
)
def first_per_priority(spark, sf_dir):
    order = {"ASIA": 0, "AFRICA": 1, "EUROPE": 2, "AMERICA": 3}
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("region")], F.lit(4))
    return scores(spark, sf_dir).select("item_id", "region").distinct().groupBy("item_id").agg(F.min_by("region", rank).alias("region"), F.count("*").alias("n_regions"))


@query(
    "region_pivot",
    f"""WITH {SCORES} SELECT item_id, arg_max(score, (updated_at, score)) FILTER (region = 'EUROPE') AS europe, arg_max(score, (updated_at, score)) FILTER (region = 'ASIA') AS asia,
  arg_max(score, (updated_at, score)) FILTER (region = 'AMERICA') AS america FROM scores GROUP BY item_id""",
)
def region_pivot(spark, sf_dir):
    wide = rollup.pivot_latest(scores(spark, sf_dir), "item_id", "region", ["EUROPE", "ASIA", "AMERICA"], "score", "updated_at")
    return wide.select("item_id", F.col("EUROPE").alias("europe"), F.col("ASIA").alias("asia"), F.col("AMERICA").alias("america"))


@query(
    "default_score_pick",
    f"""WITH {SCORES}, w AS (SELECT item_id, arg_max(score, (updated_at, score)) FILTER (region = 'EUROPE') AS eu, arg_max(score, (updated_at, score)) FILTER (region = 'ASIA') AS asia,
  arg_max(score, (updated_at, score)) FILTER (region = 'AMERICA') AS america, min(score) AS lowest, max(updated_at) AS newest, string_agg(DISTINCT region, ',' ORDER BY region) AS regions FROM scores GROUP BY item_id)
SELECT item_id, coalesce(eu, asia, america) AS default_score, {_sql_grade('coalesce(eu, asia, america)')} AS default_grade, lowest, newest, regions FROM w""",
)
def default_score_pick(spark, sf_dir):
    rows = scores(spark, sf_dir)
    wide = rollup.pivot_latest(rows, "item_id", "region", ["EUROPE", "ASIA", "AMERICA"], "score", "updated_at")
    facts = rows.groupBy("item_id").agg(F.min("score").alias("lowest"), F.max("updated_at").alias("newest"), F.array_join(F.sort_array(F.collect_set("region")), ",").alias("regions"))
    pick = F.coalesce("EUROPE", "ASIA", "AMERICA")
    return wide.join(facts, "item_id").select("item_id", pick.alias("default_score"), scoring.grade(pick).alias("default_grade"), "lowest", "newest", "regions")


@query(
    "regional_coverage",
    f"""WITH {LINES}, {REGIONS}, per AS (SELECT region, item_id, count(*) AS n, count(*) FILTER (p_size > 10) AS matched FROM lines JOIN regions USING (source_id) JOIN part ON food_id = p_partkey GROUP BY region, item_id)
SELECT region, count(*) AS items, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(matched) AS BIGINT) AS matched, count(*) FILTER (n = matched) AS complete FROM per GROUP BY region""",
)
def regional_coverage(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("food_id"), (F.col("p_size") > 10).alias("found"))
    rows = lines(spark, sf_dir).join(regions(spark, sf_dir), "source_id").join(part, "food_id")
    per = rows.groupBy("region", "item_id").agg(F.count("*").alias("n"), F.count_if("found").alias("matched"))
    return per.groupBy("region").agg(F.count("*").alias("items"), F.sum("n").alias("lines"), F.sum("matched").alias("matched"), F.count_if(F.col("n") == F.col("matched")).alias("complete"))


@query(
    "offender_share",
    f"""WITH {LINES}, c AS (SELECT item_id, food_id, sum(weight_g / 100 * fat_g) AS fat FROM lines GROUP BY item_id, food_id)
SELECT item_id, food_id, CAST(floor(fat / nullif(sum(fat) OVER (PARTITION BY item_id), 0) * 1000000 + 0.3) AS BIGINT) AS share_ppm, row_number() OVER (PARTITION BY item_id ORDER BY round(fat, 6) DESC, food_id) AS contribution_rank FROM c""",
)
def offender_share(spark, sf_dir):
    rows = lines(spark, sf_dir).groupBy("item_id", "food_id").agg(F.sum(F.col("weight_g") / 100 * F.col("fat_g")).alias("fat")).withColumn("fat", F.round("fat", 6))
    ranked = rollup.contribution_shares(rows, "item_id", "fat", ["food_id"])
    return ranked.select("item_id", "food_id", F.floor(F.col("share") * 1_000_000 + 0.3).alias("share_ppm"), "contribution_rank")
