"""Queries: grams of units, portions found by name, and the weight cascade, over the names and quantities of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.functions import weight_rules as R
from mirepoix.operators import weights
from mirepoix.plans.registry import query
from mirepoix.plans.tables import exact_sum, rounded, table

#: What a food of the tables is made into, by its key: its own name, then one of these; with what each counts.
FOODS = {
    "butter": None, "large eggs": "egg", "egg whites": "egg", "fresh parsley leaves": "leaf", "baby spinach": None, "green onions": "onion", "yellow onion": "onion",
    "cherry tomatoes": "tomato", "cheddar cheese": None, "cream cheese": None, "chicken breast": "breast", "soy sauce": None, "vegetable stock": None, "olive oil": None,
    "black pepper": "pepper", "gelatin powder": None, "black beans": None, "english muffin": "muffin", "lemon juice": "lemon", "salmon fillets": "fillet", "wheat flour": None,
    "celery stalks": "celery", "fennel bulb": "bulb", "sea salt": None, "ground cumin": None, "maple syrup": None, "stock cubes": "cube",
}
_N = len(FOODS)


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _food(key: str):
    return F.element_at(F.array(*map(F.lit, FOODS)), (F.col(key) % _N + 1).cast("int"))


MEASURES = [" g", " cups", " large", "", "to taste", "", " (400 g) cans", " tbsp", " sprigs", " slices"]
_KIND = "(l_suppkey + l_linenumber) % 10"
_LINE = f"""line AS (SELECT p_name || CASE WHEN l_linenumber = 7 THEN '' ELSE ' ' || {_list(FOODS)}[l_partkey % {_N} + 1] END AS name, {_KIND} AS kind, CAST(l_quantity AS INT) AS q,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE {_list(FOODS.values())}[l_partkey % {_N} + 1] END AS counted, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey END AS food_id FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _lines(spark, sf_dir):
    """(name, measurement, food_id, herb): a line for each of the tables', in ten forms of measurement; a third knows no food."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = line.join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))  # foods grow with their lines: not broadcast
    kind, q = (F.col("l_suppkey") + F.col("l_linenumber")) % 10, F.col("l_quantity").cast("int").cast("string")
    forms = [F.lit("") if k == 3 else F.lit(m) if k == 4 else F.concat(q, F.lit(m)) for k, m in enumerate(MEASURES)]
    measurement = F.element_at(F.array(*forms), (kind + 1).cast("int"))
    name = F.when(F.col("l_linenumber") == 7, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", _food("l_partkey")))
    return rows.select(name.alias("name"), measurement.alias("measurement"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey")).alias("food_id"), F.lit(False).alias("herb"))


_DESC = ["cup", "slice", "1 tbsp, chopped", "sprig (recipe yields 2)", "2 sprigs", "can"]
_PORTIONS = f"""portions AS (SELECT p_partkey AS food_id, p_name || ', ' || {_list(FOODS)}[p_partkey % {_N} + 1] AS food_name, ['cup', 'slice', 'tablespoon', NULL, 'sprigs', 'can'][p_size % 6 + 1] AS unit, {_list(_DESC)}[p_size % 6 + 1] AS portion_desc,
  CASE WHEN p_size % 5 > 0 THEN p_retailprice / (p_size % 5) ELSE p_retailprice / 10 END AS grams_per_unit FROM part WHERE p_size % 6 <> 3)"""


def _portions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    desc = F.element_at(F.array(*map(F.lit, _DESC)), (F.col("p_size") % 6 + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("food_id"), F.concat_ws(", ", "p_name", _food("p_partkey")).alias("food_name"), desc.alias("portion_desc"), (F.col("p_size") % 5).cast("double").alias("amount"), F.col("p_retailprice").alias("grams"), (F.col("p_retailprice") / 10).alias("grams_per_unit"))


def _tokens(name: str) -> str:
    words = f"regexp_extract_all(lower({name}), '[a-z0-9]+')"
    one = """CASE WHEN length(x) <= 3 THEN x WHEN length(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN length(x) > 4 AND (x LIKE '%les' OR x LIKE '%ges') THEN x[:-2]
  WHEN x LIKE '%es' AND NOT regexp_matches(x, '(s|x|z|ch|sh)es$') THEN x[:-3] WHEN x LIKE '%s' AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END"""
    return f"list_concat({words}, list_transform({words}, lambda x: {one}))"


_SIZE = " ".join(f"WHEN '{s}' THEN {f}" for s, f in R.SIZES.items())
_RULES = (
    "rules(nth, units, words, phrases, nots, grams, label, sized) AS (VALUES "
    + ", ".join(
        f"({i}, {_list(r.units.split())}, [{', '.join(_list(g.split()) for g in r.words)}], {_list(r.phrases)}::VARCHAR[], {_list(r.not_phrases)}::VARCHAR[], {r.grams}::DOUBLE, '{r.label}', '{r.sized}')" for i, r in enumerate(R.RULES)
    )
    + ")"
)


def _fitted(pairs: str) -> str:
    """SQL of each pair's first rule, by comparing all pairs with all rules."""
    return f"""{_RULES}, tokened AS (SELECT *, {_tokens('name')} AS tokens, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS plain FROM (SELECT DISTINCT name, unit, size FROM {pairs})),
first AS (SELECT name, unit, size, any_value(tokens) AS tokens, arg_min({{'grams': grams, 'label': label, 'sized': sized}}, nth) AS r FROM tokened JOIN rules ON list_contains(units, unit) AND len(list_filter(words, lambda g: NOT list_has_any(g, tokens))) = 0
  AND (len(phrases) = 0 OR len(list_filter(phrases, lambda p: contains(plain, p))) > 0) AND len(list_filter(nots, lambda p: contains(plain, p))) = 0 GROUP BY name, unit, size),
fitted AS (SELECT name, unit, size, CASE WHEN r.sized = 'unit' AND unit IN ('small', 'medium', 'large') THEN r.grams * CASE unit {_SIZE} END WHEN r.sized = 'stated' THEN r.grams * CASE stated {_SIZE} END ELSE r.grams END AS unit_grams,
  CASE WHEN r.sized = 'unit' AND unit IN ('small', 'medium', 'large') THEN unit || ' ' || r.label WHEN r.sized = 'stated' THEN stated || ' ' || r.label ELSE r.label END AS label
  FROM (SELECT *, coalesce(size, list_filter(['small', 'medium', 'large'], lambda s: list_contains(tokens, s))[1], 'medium') AS stated FROM first))"""


UNITS = ["stick", "egg", "egg_white", "pinch", "packet", "leaf", "bunch", "whole", "large", "small", "medium", "breast", "fillet", "can", "cup", "tablespoon", "slice", "stalk", "bulb", "sprig", "cube", "muffin", "piece", "package", "onion"]
_PAIRS = f"pairs AS (SELECT l_orderkey, p_name || ' ' || {_list(FOODS)}[l_partkey % {_N} + 1] AS name, {_list(UNITS)}[l_orderkey % {len(UNITS)} + 1] AS unit, NULL::VARCHAR AS size FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("reference_unit_grams", f"WITH {_PAIRS}, {_fitted('pairs')} SELECT name, unit, label, unit_grams, count(*) AS n_lines FROM pairs JOIN fitted USING (name, unit) GROUP BY ALL")
def reference_unit_grams(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("l_orderkey") % len(UNITS) + 1).cast("int"))
    pairs = rows.select(F.concat_ws(" ", "p_name", _food("l_partkey")).alias("name"), unit.alias("unit"))
    used = pairs.groupBy("name", "unit").agg(F.count("*").alias("n_lines"))
    return used.join(weights.reference_grams(pairs), ["name", "unit"]).select("name", "unit", "label", "unit_grams", "n_lines")


def _searched(names: str) -> str:
    """SQL of the portion that each of the names (key, unit) finds, by comparing all names with all foods."""
    words = lambda c: f"list_distinct(list_transform(regexp_extract_all(lower({c}), '[a-z]+'), lambda x: CASE WHEN length(x) <= 3 THEN x WHEN x LIKE '%ies' THEN x[:-4] || 'y' WHEN x LIKE '%es' THEN x[:-3] WHEN x LIKE '%s' AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END))"
    return f"""tiers AS (SELECT key, n.unit, food_name, food_id, portion_desc, grams_per_unit, CASE WHEN lower(food_name) = key THEN 1 WHEN starts_with(lower(food_name), key || ',') OR starts_with(lower(food_name), key || ' ') THEN 2 ELSE 3 END AS tier,
  -len(list_intersect({words('portion_desc')}, {words('key')})) AS less FROM {names} n JOIN portions p ON n.unit = p.unit AND contains(lower(food_name), key)),
searched AS (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY key, unit ORDER BY tier, CASE WHEN tier > 1 THEN length(food_name) ELSE 0 END, food_id, less, portion_desc) = 1)"""


_WANTED = f"""asked AS (SELECT DISTINCT lower(key) AS key, unit FROM (SELECT unnest([p_name, p_name || ', ' || {_list(FOODS)}[p_partkey % {_N} + 1], substr(p_name, 3), string_split(p_name, ' ')[-1], upper(p_name[:2]), 'no such food']) AS key FROM part), (SELECT unnest(['cup', 'slice', 'tablespoon', 'sprig']) AS unit))"""


@query("portion_search", f"WITH {_PORTIONS}, {_WANTED}, {_searched('asked')} SELECT key AS name, unit, tier, food_name, food_id, portion_desc, grams_per_unit FROM searched")
def portion_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    forms = F.array("p_name", F.concat_ws(", ", "p_name", _food("p_partkey")), F.substring("p_name", 3, 1000), F.substring_index("p_name", " ", -1), F.upper(F.left("p_name", F.lit(2))), F.lit("no such food"))
    wanted = part.select(F.explode(forms).alias("name")).select("name", F.explode(F.array(*map(F.lit, ["cup", "slice", "tablespoon", "sprig"]))).alias("unit"))
    return weights.portion_search(wanted, _portions(spark, sf_dir))


_ML = " ".join(f"WHEN '{u}' THEN {v}" for u, v in R.VOLUME_ML.items())
_MASS = " ".join(f"WHEN '{u}' THEN {v}" for u, v in R.MASS_G.items())
_SURE = " ".join(f"WHEN '{u}' THEN {v}" for u, v in weights.CONFIDENCE.items())
_WORDS = "regexp_extract_all(lower(name), '[a-z]+')"
_DENSITY = (
    f"CASE WHEN list_has_any({_WORDS}, {_list(R.WATER_LIKE.split())}) THEN CASE WHEN list_has_any({_WORDS}, {_list(R.NOT_LIQUID.split())}) THEN NULL ELSE 1.0 END WHEN list_has_all({_WORDS}, ['maple', 'syrup']) THEN 1.37 WHEN list_has_all({_WORDS}, ['soy', 'sauce']) THEN 1.19 "
    + " ".join(f"WHEN list_contains({_WORDS}, '{t}') THEN {d}" for t, d in R.DENSITY.items())
    + " END"
)


@query(
    "weight_cascade",
    f"""WITH {_LINE}, {_PORTIONS},
parsed AS (SELECT *, coalesce(CASE kind WHEN 0 THEN 'g' WHEN 1 THEN 'cup' WHEN 2 THEN 'large' WHEN 6 THEN 'can' WHEN 7 THEN 'tbsp' WHEN 8 THEN 'sprig' WHEN 9 THEN 'slice' END, CASE WHEN kind = 5 AND q >= 50 THEN 'gram' END, counted) AS unit, CASE WHEN kind IN (3, 4) THEN CASE WHEN counted IS NOT NULL THEN 1 END ELSE q END AS qty,
  kind IN (3, 4, 5) AS no_unit, {_DENSITY} AS density, CASE WHEN kind = 2 THEN 'large' END AS size FROM line),
{_fitted('parsed')},
offline AS (SELECT p_name || ' ' || {_list(FOODS)}[p_partkey % {_N} + 1] AS name, 'cup' AS unit, min(p_retailprice) AS offline_g FROM part WHERE p_size = 1 GROUP BY ALL),
ones AS (SELECT p_name || ' ' || {_list(FOODS)}[p_partkey % {_N} + 1] AS name, min(p_retailprice / 10) AS one_g FROM part WHERE p_size = 2 GROUP BY ALL),
densities AS (SELECT food_id, grams_per_unit / CASE unit {_ML} END AS portion_density FROM portions WHERE unit IN ({", ".join(f"'{u}'" for u in R.VOLUME_ML)})),
known AS (SELECT p.*, unit_grams AS rule_g, offline_g, one_g, o.grams_per_unit AS portion_g, portion_density, CASE p.unit {_ML} END AS ml FROM parsed p LEFT JOIN fitted f ON f.name = p.name AND f.unit = p.unit AND f.size IS NOT DISTINCT FROM p.size LEFT JOIN offline v ON v.name = p.name AND v.unit = p.unit
  LEFT JOIN ones n ON n.name = p.name LEFT JOIN portions o ON o.food_id = p.food_id AND o.unit = p.unit LEFT JOIN densities d ON d.food_id = p.food_id),
step AS (SELECT *, CASE WHEN kind = 4 THEN ['to_taste_min', '0.5'] WHEN qty * offline_g IS NOT NULL THEN ['offline_reference', (qty * offline_g)::VARCHAR] WHEN kind = 6 THEN ['explicit_package_size_fallback', (qty * 400.0)::VARCHAR] WHEN qty * rule_g IS NOT NULL THEN ['common_unit_reference_fallback', (qty * rule_g)::VARCHAR]
  WHEN density = 1.0 AND qty * ml IS NOT NULL THEN ['water_like_volume_fallback', (qty * ml)::VARCHAR] WHEN qty * ml * density IS NOT NULL THEN ['liquid_density_volume_fallback', (qty * ml * density)::VARCHAR]
  WHEN qty * one_g * CASE unit {_SIZE} END IS NOT NULL THEN ['size_adjusted_reference_unit_fallback', (qty * one_g * CASE unit {_SIZE} END)::VARCHAR] WHEN qty * CASE unit {_MASS} END IS NOT NULL THEN ['direct_mass', (qty * CASE unit {_MASS} END)::VARCHAR]
  WHEN qty IS NULL AND regexp_matches(name, 'salt|pepper|seasoning') AND NOT list_has_any({_WORDS}, {_list(R.PINCH_NOT.split())}) THEN ['pinch_default_missing_quantity_fallback', '0.3'] WHEN food_id IS NOT NULL AND no_unit AND contains(name, 'powder') AND qty IS NOT NULL THEN ['herb_pinch_fallback', (qty * 0.3)::VARCHAR]
  WHEN food_id IS NOT NULL AND no_unit AND qty * one_g IS NOT NULL THEN ['unit_grams_fallback', (qty * one_g)::VARCHAR] WHEN qty * portion_g IS NOT NULL THEN ['direct', (qty * portion_g)::VARCHAR] WHEN qty * ml * portion_density IS NOT NULL THEN ['density_fallback', (qty * ml * portion_density)::VARCHAR] END AS found FROM known),
names AS (SELECT DISTINCT name AS key, unit FROM step WHERE found IS NULL AND food_id IS NOT NULL AND qty IS NOT NULL AND unit IS NOT NULL), {_searched('names')},
closed AS (SELECT s.*, coalesce(found[1], CASE WHEN food_id IS NOT NULL AND qty * g IS NOT NULL THEN 'weight_name_portion_fallback' END) AS match_type, coalesce(found[2]::DOUBLE, CASE WHEN food_id IS NOT NULL THEN qty * g END) AS grams FROM step s LEFT JOIN (SELECT key, unit, grams_per_unit AS g FROM searched) f ON f.key = s.name AND f.unit = s.unit)
SELECT match_type, CASE WHEN match_type IS NULL THEN CASE WHEN food_id IS NULL THEN 'missing_food' WHEN qty IS NULL THEN 'missing_quantity' WHEN unit IS NULL THEN 'missing_unit' ELSE 'no_portion' END END AS error,
  round(greatest(0, coalesce(CASE match_type {_SURE} END, 0) - CASE WHEN no_unit AND unit IS NOT NULL THEN 0.15 ELSE 0 END), 2)::DOUBLE AS confidence, count(*) AS n_lines, round(sum(grams), 1)::DOUBLE AS grams FROM closed GROUP BY ALL""",
)
def weight_cascade(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", _food("p_partkey"))
    offline = part.where("p_size = 1").select(name.alias("name"), F.lit("cup").alias("unit"), F.col("p_retailprice").alias("grams_per_unit"))
    ones = part.where("p_size = 2").select(name.alias("name"), (F.col("p_retailprice") / 10).alias("grams_per_unit"))
    rows = weights.weighed(_lines(spark, sf_dir), _portions(spark, sf_dir), offline, ones)
    return rows.groupBy("match_type", "error", "confidence").agg(F.count("*").alias("n_lines"), rounded(exact_sum(F.col("grams")), 1).alias("grams"))
