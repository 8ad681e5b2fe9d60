"""Queries: allergens, diets, food queries and other food rules, over lines whose foods bear names of a recipe's ingredients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirepoix.functions import rules as R
from mirepoix.functions import vocabulary as V
from mirepoix.operators.report import top_n
from mirepoix.plans.registry import query
from mirepoix.plans.tables import table

#: Names that stand for the foods of the tables, by food_id modulo their number.
NAMES = [
    "Coconut milk", "whole milk", "Dijon mustard", "satay sauce", "gluten free flour", "wheat flour", "steamed mussels", "butter beans", "egg yolks", "eggplant",
    "buckwheat noodles", "celeriac mash", "lupini beans", "sodium metabisulphite", "tiger prawns", "salmon fillet", "soy milk", "sesame oil", "ground ginger",
    "cream sherry", "chicken breast", "tomato paste", "brazil nuts", "malt vinegar", "saté paste", "vegan cheese", "rye bread", "burger patties",
]


def name_of(food_id: str) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), (F.col(food_id) % len(NAMES) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _name(food_id: str) -> str:
    return f"{_list(NAMES)}[{food_id} % {len(NAMES)} + 1]"


_NAMED = f"named AS (SELECT DISTINCT l_orderkey AS item_id, {_name('l_partkey')} AS name FROM lineitem)"
_ALL = "names AS (SELECT unnest(" + _list(NAMES) + ") AS name)"


def _named(spark, sf_dir):
    """(item_id, name): the ingredients of each item, each once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), name_of("l_partkey").alias("name")).distinct()


def _by_name(spark, *columns: Column):
    """Columns computed once for each of the names: the closed list is a literal, whatever the tables hold."""
    return spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", *columns)


def _has(name: str, allergen: str) -> str:
    found = f"regexp_matches(lower({name}), {_rx(R.keyword_pattern(V.ALLERGENS[allergen]))})"
    guard = {"milk": V.PLANT_DAIRY, "gluten": V.GLUTEN_SAFE, "wheat": V.GLUTEN_SAFE}.get(allergen)
    return found + (f" AND NOT regexp_matches(lower({name}), {_rx(R.any_of(guard))})" if guard else "")


#: A turn of a conversation that names one of the foods after what it says.
_SAID = f"names AS (SELECT conv_id, turn, text || ' ' || {_name('(conv_id + turn)')} AS name FROM conversations)"


def _said(spark, sf_dir):
    """(conv_id, turn, name): each turn's whole text and a food's name."""
    turns = table(spark, sf_dir, "conversations").withColumn("food", F.col("conv_id") + F.col("turn"))
    return turns.select("conv_id", "turn", F.concat_ws(" ", "text", name_of("food")).alias("name"))


_FOUND = "found AS (SELECT name, list_filter([" + ", ".join(f"CASE WHEN {_has('name', a)} THEN '{a}' END" for a in sorted(V.ALLERGENS)) + "], lambda x: x IS NOT NULL) AS found FROM names)"


@query("allergen_names", f"WITH {_SAID}, {_FOUND.replace('SELECT name,', 'SELECT conv_id, turn,')} SELECT conv_id, turn, array_to_string(found, ',') AS allergens FROM found")
def allergen_names(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", F.array_join(R.allergens(F.col("name")), ",").alias("allergens"))


def _detected(spark, sf_dir):
    """(item_id, allergens): each item's allergens, sorted; items without any have an empty list."""
    known = _by_name(spark, R.allergens(F.col("name")).alias("found"))
    flat = _named(spark, sf_dir).join(F.broadcast(known), "name")  # a row for each name of a closed list
    return flat.groupBy("item_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("found")))).alias("allergens"))


_DETECTED = f"{_ALL}, {_FOUND}, {_NAMED}, each AS (SELECT item_id, unnest(found) AS a FROM named JOIN found USING (name)), detected AS (SELECT i.item_id, coalesce((SELECT list_sort(list(DISTINCT a)) FROM each e WHERE e.item_id = i.item_id), []) AS allergens FROM (SELECT DISTINCT item_id FROM named) i)"


@query("allergen_detect", f"WITH {_DETECTED} SELECT item_id, array_to_string(allergens, ',') AS allergens FROM detected")
def allergen_detect(spark, sf_dir):
    return _detected(spark, sf_dir).select("item_id", F.array_join("allergens", ",").alias("allergens"))


@query(
    "diet_tags_inferred",
    f"""WITH {_DETECTED} SELECT item_id, concat_ws(',', CASE WHEN NOT list_has_any(allergens, ['milk']) THEN 'dairy_free' END, CASE WHEN NOT list_has_any(allergens, ['peanut', 'tree_nut']) THEN 'nut_free' END,
  CASE WHEN NOT list_has_any(allergens, ['gluten', 'wheat']) THEN 'gluten_free' END, CASE WHEN NOT list_has_any(allergens, ['fish', 'crustacean_shellfish', 'molluscs']) THEN 'pescatarian_safe' END) AS tags FROM detected""",
)
def diet_tags_inferred(spark, sf_dir):
    return _detected(spark, sf_dir).select("item_id", F.array_join(R.diet_tags(F.col("allergens")), ",").alias("tags"))


@query("allergen_evidence", f"WITH {_ALL}, {_FOUND}, {_NAMED} SELECT a AS allergen, name, count(*) AS n_items FROM (SELECT item_id, name, unnest(found) AS a FROM named JOIN found USING (name)) GROUP BY ALL")
def allergen_evidence(spark, sf_dir):
    used = _named(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n_items"))
    return _by_name(spark, F.explode(R.allergens(F.col("name"))).alias("allergen")).join(used, "name").select("allergen", "name", "n_items")


@query("alternative_guards", f"WITH {_SAID} SELECT conv_id, turn, regexp_matches(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), {_rx(R.any_of(V.PLANT_DAIRY))}) AS plant_dairy, regexp_matches(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), {_rx(R.any_of(V.GLUTEN_SAFE))}) AS gluten_safe FROM names")
def alternative_guards(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", R.plant_dairy(F.col("name")).alias("plant_dairy"), R.gluten_safe(F.col("name")).alias("gluten_safe"))


_TOKENS = "trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "diet_exclusion",
    f"""WITH {_NAMED}, n AS (SELECT item_id, name FROM named UNION ALL SELECT o_orderkey, {_name('o_custkey')} FROM orders)
SELECT item_id, {", ".join(f"NOT bool_or(regexp_matches({_TOKENS}, {_rx(R.phrase_pattern(d))})) AS {d}" for d in V.DIETS)} FROM n GROUP BY item_id""",
)
def diet_exclusion(spark, sf_dir):
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), name_of("o_custkey").alias("name"))
    known = F.broadcast(_by_name(spark, *(R.contradicts(F.col("name"), d).alias(d) for d in V.DIETS)))  # the closed list of names
    rows = _named(spark, sf_dir).union(titles).join(known, "name")
    return rows.groupBy("item_id").agg(*((~F.bool_or(d)).alias(d) for d in V.DIETS))


@query(
    "diet_contradiction",
    f"WITH {_SAID}, d(diet, words) AS (VALUES {', '.join(f'({_rx(d)}, {_list(w)})' for d, w in V.DIETS.items())}) SELECT conv_id, turn, diet, list_filter(words, lambda w: contains(lower(name), w))[1] AS fragment FROM names, d WHERE len(list_filter(words, lambda w: contains(lower(name), w))) > 0",
)
def diet_contradiction(spark, sf_dir):
    each = F.explode(F.map_filter(F.create_map(*(x for d in V.DIETS for x in (F.lit(d), R.first_contradiction(F.col("name"), d)))), lambda k, v: v.isNotNull())).alias("diet", "fragment")
    return _said(spark, sf_dir).select("conv_id", "turn", each)


_KEPT_OUT = {a: R.exclusion_fragments(a) for a in ("tree_nut", "dairy", "shellfish", "mustard")}


@query(
    "allergen_exclusion",
    f"""WITH {_NAMED}, g AS (SELECT item_id, list(lower(name)) AS names FROM named GROUP BY item_id), i AS (SELECT item_id, names, CASE o_orderstatus WHEN 'F' THEN 'mustard' WHEN 'P' THEN 'tree_nut' ELSE '' END AS declared FROM g JOIN orders ON item_id = o_orderkey)
SELECT item_id, {", ".join(f"declared = '{a}' OR len(list_filter(names, lambda n: " + " OR ".join(f"contains(n, '{f}')" for f in fs) + f")) > 0 AS {a}" for a, fs in _KEPT_OUT.items())} FROM i""",
)
def allergen_exclusion(spark, sf_dir):
    declared = F.when(F.col("o_orderstatus") == "F", "mustard").when(F.col("o_orderstatus") == "P", "tree_nut").otherwise("")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.array(declared).alias("declared"))
    names = _named(spark, sf_dir).groupBy("item_id").agg(F.collect_list("name").alias("names"))
    return items.join(names, "item_id").select("item_id", *(R.excluded_by(F.col("names"), F.col("declared"), a).alias(a) for a in _KEPT_OUT))


_SPELLINGS = ["Vegan", " vegans", "Gluten-Free", "dairyfree", "nut free", "low_carb", "pescatarian_safe", "vegetarian or vegan", ""]


@query(
    "diet_spellings",
    f"""WITH s AS (SELECT o_orderkey, {_list(_SPELLINGS)}[o_orderkey % {len(_SPELLINGS)} + 1] AS spelling FROM orders), n AS (SELECT o_orderkey, spelling, replace(lower(trim(spelling)), ' ', '_') AS n FROM s),
c AS (SELECT spelling, CASE n {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.DIET_ALIASES.items())} ELSE n END AS d FROM n) SELECT CASE WHEN d IN ({", ".join(f"'{d}'" for d in V.DIETS)}) THEN d END AS diet, count(*) AS n FROM c GROUP BY 1""",
)
def diet_spellings(spark, sf_dir):
    spelling = F.element_at(F.array(*map(F.lit, _SPELLINGS)), (F.col("o_orderkey") % len(_SPELLINGS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(R.canonical_diet(spelling).alias("diet")).agg(F.count("*").alias("n"))


_RAW = ["{q} cups {n}, finely chopped", "{n} (optional)", "1 1/2 tbsp large ripe {n} to taste", "{q}g {n}/{n}", "store-bought {n}!", "{q} {q} oz. {n}"]


def _raw_sql() -> str:
    parts = ("'" + r.replace("{q}", f"' || CAST(l_quantity AS BIGINT) || '").replace("{n}", f"' || {_name('l_partkey')} || '") + "'" for r in _RAW)
    return f"raw AS (SELECT DISTINCT [{', '.join(parts)}][l_linenumber % {len(_RAW)} + 1] AS raw FROM lineitem)"


def _raw(spark, sf_dir):
    """(raw): ingredient names as recipes write them."""
    line = table(spark, sf_dir, "lineitem").select(F.floor("l_quantity").cast("string").alias("q"), name_of("l_partkey").alias("n"), "l_linenumber")
    forms = F.array(*(F.replace(F.replace(F.lit(r), F.lit("{q}"), F.col("q")), F.lit("{n}"), F.col("n")) for r in _RAW))
    return line.select(F.element_at(forms, (F.col("l_linenumber") % len(_RAW) + 1).cast("int")).alias("raw")).distinct()


_CLEAN = f"trim(regexp_replace(regexp_replace(ltrim(regexp_replace(regexp_replace(replace(regexp_replace(lower(raw), '\\([^)]*\\)', ' ', 'g'), ',', ' '), {_rx(V.QUERY_NOISE)}, ' ', 'g'), '[^a-z0-9\\s''/-]', ' ', 'g')), {_rx(V.LEADING_QUANTITY)}, ' '), '\\s+', ' ', 'g'), ' -''/')"


@query("clean_food_query", f"WITH {_raw_sql()} SELECT raw, {_CLEAN} AS cleaned FROM raw")
def clean_food_query(spark, sf_dir):
    return _raw(spark, sf_dir).select("raw", R.clean_query(F.col("raw")).alias("cleaned"))


_SINGULAR = """CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, '(ses|xes|zes|ches|shes|oes)$') THEN left(w, length(w) - 2) WHEN w LIKE '%ves' THEN left(w, length(w) - 3) || 'f'
  WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|as|os)$') THEN left(w, length(w) - 1) ELSE w END"""


@query(
    "food_query_tokens",
    f"""WITH {_raw_sql()}, e AS (SELECT raw, unnest(regexp_extract_all(lower(raw), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(raw), '[a-z0-9]+'), 1) AS i FROM raw), t AS (SELECT raw, i, w, {_SINGULAR} AS t FROM e WHERE length(w) > 1),
k AS (SELECT raw, i, t, coalesce(CASE w {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SYNONYMS.items())} END, CASE t {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SYNONYMS.items())} END) AS s FROM t WHERE t NOT IN ({", ".join(f"'{s}'" for s in V.QUERY_STOP)}) AND length(t) > 1),
a AS (SELECT raw, i * 2 AS i, t FROM k UNION ALL SELECT raw, i * 2 + 1, s FROM k WHERE s <> t) SELECT r.raw, coalesce(string_agg(t, ' ' ORDER BY i), '') AS tokens FROM raw r LEFT JOIN a ON a.raw = r.raw GROUP BY r.raw""",
)
def food_query_tokens(spark, sf_dir):
    return _raw(spark, sf_dir).select("raw", F.array_join(R.query_tokens(F.col("raw")), " ").alias("tokens"))


_OPTIONS = [" It can be made gluten-free.", " Use tamari for a gluten free bowl.", " Serve warm.", " Gluten-free version: swap the flour.", " Good as gluten free."]


def _evidence_sql() -> str:
    found = []
    for p in V.GLUTEN_FREE_OPTION:
        m = f"regexp_extract(t, {_rx('(?i)' + p)})"
        found.append(f"CASE WHEN {m} <> '' THEN substr(t, greatest(1, strpos(t, {m}) - 80), strpos(t, {m}) - greatest(1, strpos(t, {m}) - 80) + length({m}) + 80) END")
    return "coalesce(" + ", ".join(found) + ")"


@query("gluten_free_evidence", f"WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text || {_list(_OPTIONS)}[(conv_id + turn) % {len(_OPTIONS)} + 1], '\\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, {_evidence_sql()} AS evidence FROM t")
def gluten_free_evidence(spark, sf_dir):
    told = F.concat("text", F.element_at(F.array(*map(F.lit, _OPTIONS)), ((F.col("conv_id") + F.col("turn")) % len(_OPTIONS) + 1).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.option_evidence(told).alias("evidence"))


_MEASURES = ["{q} cup", "{q} lbs", "1 {q} tsp", "{q}-1 cups", "{q} oz", "{q}-{q} tbsp", "2 {q} pounds"]


def _repair_sql(s: str) -> str:
    for den, unit in (("[2348]", "cups?|tbsp|tablespoons?|tsp|teaspoons?"), ("[24]", "lbs?|pounds?")):
        for pattern, to in ((rf"^\s*(\d)({den})\s*-\s*(\d)({den})", r"\1/\2-\3/\4"), (rf"^\s*(\d)({den})\s*-\s*(\d+)", r"\1/\2-\3"), (rf"^\s*(\d+)\s+(\d)({den})", r"\1 \2/\3"), (rf"^\s*(\d)({den})", r"\1/\2")):
            last = to.count("\\") + 1
            s = f"regexp_replace({s}, {_rx(pattern + rf'(\s+(?i:{unit})\b)')}, {_rx(to + chr(92) + str(last))})"
    return s


@query("slashless_fractions", f"WITH m AS (SELECT DISTINCT [{', '.join(chr(39) + m.replace('{q}', chr(39) + ' || CAST(l_quantity AS BIGINT) || ' + chr(39)) + chr(39) for m in _MEASURES)}][l_linenumber % {len(_MEASURES)} + 1] AS m FROM lineitem) SELECT m AS measurement, {_repair_sql('m')} AS repaired FROM m")
def slashless_fractions(spark, sf_dir):
    q = F.floor("l_quantity").cast("string")
    forms = F.array(*(F.replace(F.lit(m), F.lit("{q}"), q) for m in _MEASURES))
    rows = table(spark, sf_dir, "lineitem").select(F.element_at(forms, (F.col("l_linenumber") % len(_MEASURES) + 1).cast("int")).alias("measurement")).distinct()
    return rows.select("measurement", R.repaired_fraction(F.col("measurement")).alias("repaired"))


_FIELDS = "SELECT p_partkey, 1 AS f, p_name AS field FROM part UNION ALL SELECT p_partkey, 2, lower(p_type) || ' ' || p_name FROM part UNION ALL SELECT p_partkey, 3, lower(p_type) FROM part"
_TARGETS = ["red ring", "promo", "old bolt", "ring small", "gear"]


@query(
    "name_subset_resolution",
    f"""WITH f AS ({_FIELDS}), t AS (SELECT unnest({_list(_TARGETS)}) AS target), w AS (SELECT *, list_distinct(regexp_extract_all(target, '[a-z0-9]+')) AS tw, list_distinct(regexp_extract_all(field, '[a-z0-9]+')) AS fw FROM t, f),
r AS (SELECT target, p_partkey, field = target AS exact, round(CASE WHEN field = target THEN 1 ELSE len(tw) / len(fw) END, 6) AS score, row_number() OVER (PARTITION BY target ORDER BY field = target DESC, CASE WHEN field = target THEN 1 ELSE len(tw) / len(fw) END DESC, p_partkey, f) AS nth FROM w WHERE list_has_all(fw, tw)) SELECT target, p_partkey, exact, score FROM r WHERE nth = 1""",
)
def name_subset_resolution(spark, sf_dir):
    part, words = table(spark, sf_dir, "part"), lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0)))
    kind = F.lower("p_type")
    fields = part.select("p_partkey", F.posexplode(F.array("p_name", F.concat_ws(" ", kind, "p_name"), kind)).alias("f", "field"))
    # the targets of one request are literals: each field is held against them where it is
    each = fields.select("*", words("field").alias("fw"), F.explode(F.array(*map(F.lit, _TARGETS))).alias("target")).withColumn("tw", words("target"))
    fit = each.where(F.size(F.array_except("tw", "fw")) == 0).withColumn("exact", F.col("field") == F.col("target"))
    scored = fit.withColumn("score", F.when(F.col("exact"), 1.0).otherwise(F.size("tw") / F.size("fw")))
    return top_n(scored, ["target"], [F.desc("exact"), F.desc("score"), F.col("p_partkey"), F.col("f")], 1).select("target", "p_partkey", "exact", F.round("score", 6).alias("score"))


@query("portion_ambiguity", f"WITH p AS (SELECT l_orderkey, l_linenumber, {_list(['1 cup', 'amount to make 1 quart', '1 cup, prepared', 'serving (1 recipe yields 8)', 'slice'])}[l_partkey % 5 + 1] AS portion FROM lineitem) SELECT portion, count(*) AS n FROM p WHERE NOT ({' OR '.join(f'contains(portion, {_rx(a)})' for a in V.AMBIGUOUS_PORTIONS)}) GROUP BY portion")
def portion_ambiguity(spark, sf_dir):
    portion = F.element_at(F.array(*map(F.lit, ["1 cup", "amount to make 1 quart", "1 cup, prepared", "serving (1 recipe yields 8)", "slice"])), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(portion.alias("portion")).where(~F.lower("portion").rlike(R.any_of(V.AMBIGUOUS_PORTIONS)))
    return rows.groupBy("portion").agg(F.count("*").alias("n"))
