"""Queries: equipment in ingredient lists, ontology labels, measurement forms, generic names of brands, plausible weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirepoix.functions import cleaning as C
from mirepoix.plans.registry import query
from mirepoix.plans.tables import table

#: Names that stand for the foods of the tables, by food_id modulo their number.
NAMES = [
    "wooden skewers, soaked in water", "olive oil, plus extra, to brush", "parchment paper", "rack of lamb", "string beans", "olive oil flavored cooking spray", "chicken breast fillets cooking spray oil",
    "Large Ziploc bag", "tea bag", "cheese grater", "butcher's twine", "butter", "non-stick spray coating", "flour", "aluminum foil (about 30 cm)", "lemon, zester needed", "brush", "salt",
]
UNITS = ["whole", "box", "bag", "bunch", "cup", "clove", "pinch", "tablespoon", "lb", "oz", ""]
FORMS = [" grams", "g", " Tablespoons of", " cloves", " ounces ", "kg", " millilitres"]
BRANDS = [  # (original, generic, brand)
    ("Acme's Honey Mustard Dressing", "honey mustard dressing", "Acme"), ("Bolt cola", "drink", "Bolt"), ("Tin Chef diced tomatoes", "tomato", "Tin Chef"), ("Zing™ berries", "berry", "Zing"),
    ("Pure Oats", "pure oats", None), ("Sol cheeses", "cheeses", "Sol"), ("Kip smoked paprika", "2 smoked paprika", "Kip"), ("Nan crackers", "nan crackers plain", "Nan"), ("Fog peeled prawns in a tub", "prawn", "Fog"), (None, None, None),
]


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


_PURE = f"""(regexp_matches(lower(name), {_text(C.EQUIPMENT_PATTERN)}) AND
  len(list_filter(regexp_extract_all(regexp_replace(lower(name), {_text(C.EQUIPMENT_PATTERN)}, ' ', 'g'), '[a-z]{{3,}}'), lambda w: NOT list_contains({_list(C.QUALIFIERS)}, w))) = 0)"""


@query(
    "equipment_names",
    f"SELECT name, regexp_matches(lower(name), {_text(C.EQUIPMENT_PATTERN)}) AS named, {_PURE} AS pure FROM (SELECT DISTINCT {_list(NAMES)}[l_partkey % {len(NAMES)} + 1] AS name FROM lineitem)",
)
def equipment_names(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select(_pick(NAMES, F.col("l_partkey")).alias("name")).distinct()
    return names.select("name", C.names_equipment(F.col("name")).alias("named"), C.pure_equipment(F.col("name")).alias("pure"))


@query(
    "non_food_removal",
    f"""WITH n AS (SELECT i AS k, {_PURE} AS pure FROM (SELECT unnest({_list(NAMES)}) AS name, unnest(range({len(NAMES)})) AS i))
SELECT l_orderkey AS item_id, count(*) FILTER (pure) AS n_removed, count(*) FILTER (NOT pure) AS n_left, count(*) FILTER (NOT pure) < 2 AS dropped
FROM lineitem JOIN n ON k = l_partkey % {len(NAMES)} GROUP BY l_orderkey HAVING count(*) FILTER (pure) > 0""",
)
def non_food_removal(spark, sf_dir):
    """Items that lose lines of pure equipment, and whether fewer than two lines are left, so that the item goes, too."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), _pick(NAMES, F.col("l_partkey")).alias("name"))
    counts = rows.groupBy("item_id", "name").agg(F.count("*").alias("n")).withColumn("pure", C.pure_equipment(F.col("name")))
    each = counts.groupBy("item_id").agg(F.sum(F.when(F.col("pure"), F.col("n")).otherwise(0)).alias("n_removed"), F.sum(F.when(~F.col("pure"), F.col("n")).otherwise(0)).alias("n_left"))
    return each.where("n_removed > 0").withColumn("dropped", F.col("n_left") < 2)


_LABEL = "p_name || ' (' || lower(p_type) || ') Food product@en'"


@query("ontology_labels", f"SELECT p_partkey, trim(regexp_replace(replace(replace(replace(lower({_LABEL}), '@en', ''), 'food product', ''), 'food', ''), '[^a-z]+', ' ', 'g')) AS label FROM part")
def ontology_labels(spark, sf_dir):
    label = F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(") Food product@en"))
    return table(spark, sf_dir, "part").select("p_partkey", C.ontology_label(label).alias("label"))


def _form_sql() -> str:
    text = "regexp_replace(replace(lower(trim(raw)), ' of', ''), '\\s+', ' ', 'g')"
    text = reduce(lambda t, f: f"regexp_replace({t}, '\\b{f[0]}\\b', '{f[1]}', 'g')", C.UNIT_FORMS.items(), text)
    number = "CASE WHEN TRY_CAST(x AS DOUBLE) = floor(TRY_CAST(x AS DOUBLE)) THEN CAST(CAST(TRY_CAST(x AS DOUBLE) AS BIGINT) AS VARCHAR) WHEN TRY_CAST(x AS DOUBLE) IS NOT NULL THEN rtrim(printf('%.6f', TRY_CAST(x AS DOUBLE)), '0') ELSE x END"
    return f"array_to_string(list_transform(string_split(trim(regexp_replace({text}, '([0-9])([a-z])', '\\1 \\2', 'g')), ' '), lambda x: {number}), ' ')"


@query(
    "measurement_forms",
    f"""WITH m AS (SELECT CAST(CAST(l_quantity AS INT) AS VARCHAR) || ['', '.50', '.0', '.125'][l_linenumber % 4 + 1] || {_list(FORMS)}[l_partkey % {len(FORMS)} + 1] AS raw FROM lineitem)
SELECT raw, {_form_sql()} AS form, count(*) AS n FROM m GROUP BY raw""",
)
def measurement_forms(spark, sf_dir):
    raw = F.concat(F.col("l_quantity").cast("int").cast("string"), _pick(["", ".50", ".0", ".125"], F.col("l_linenumber")), _pick(FORMS, F.col("l_partkey")))
    counts = table(spark, sf_dir, "lineitem").groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    return counts.select("raw", C.measurement_form(F.col("raw")).alias("form"), "n")


_REASONS = " ".join(
    [
        "WHEN unit = '' THEN 'missing_unit' WHEN g <= 0 THEN 'non_positive_weight'",
        f"WHEN unit = 'whole' AND list_has_any(words, {_list(C.WHOLE_ANIMALS)}) AND g < 500 THEN 'whole_animal_too_small' WHEN unit = 'whole' AND contains(grp, 'products') AND g < 25 THEN 'whole_food_too_small'",
        "WHEN unit = 'box' AND g < 20 THEN 'package_too_small' WHEN unit = 'bag' AND g < 20 THEN 'bag_too_small' WHEN unit = 'bunch' AND g < 5 THEN 'bunch_too_small' WHEN unit IN ('cup', 'tablespoon') AND g > 500 THEN 'volume_unit_too_large'",
        *(f"WHEN unit = '{u}' AND g > {most} THEN '{u}_too_heavy'" for u, most in C.HEAVIEST_G.items()),
        "WHEN g > 5000 THEN 'implausible_per_unit_weight'",
        *(f"WHEN abs(g - {v}) <= {max(0.5, v * 0.002)} AND NOT list_contains({_list(units)}, unit) THEN 'suspicious_unit_conversion_default:{v}'" for v, units in C.CONVERSIONS_G.items()),
    ]
)


@query(
    "implausible_weights",
    f"""WITH w AS (SELECT l_orderkey AS item_id, l_linenumber AS position, regexp_extract_all(lower({_list(NAMES)}[l_partkey % {len(NAMES)} + 1]), '[a-z]+') AS words, {_list(UNITS)}[l_suppkey % {len(UNITS)} + 1] AS unit,
  l_quantity * l_quantity * 4 - 4 AS g, ['vegetable products', 'meat'][l_linenumber % 2 + 1] AS grp FROM lineitem), r AS (SELECT item_id, position, unit, CASE {_REASONS} END AS reason FROM w)
SELECT * FROM r WHERE reason IS NOT NULL""",
)
def implausible_weights(spark, sf_dir):
    words = F.regexp_extract_all(F.lower(_pick(NAMES, F.col("l_partkey"))), F.lit("[a-z]+"), F.lit(0))
    grams = F.col("l_quantity") * F.col("l_quantity") * 4 - 4
    reason = C.implausible_weight(words, _pick(UNITS, F.col("l_suppkey")), grams, _pick(["vegetable products", "meat"], F.col("l_linenumber")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("position"), _pick(UNITS, F.col("l_suppkey")).alias("unit"), reason.alias("reason"))
    return rows.where("reason is not null")


_STEMS = """list_filter([w, CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' END, CASE WHEN length(w) > 4 AND w LIKE '%es' THEN left(w, length(w) - 2) END, CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) END,
  CASE WHEN length(w) > 5 AND regexp_matches(w, '(ed|er)$') THEN left(w, length(w) - 2) END, CASE WHEN length(w) > 6 AND regexp_matches(w, '(ated|ular)$') THEN left(w, 5) END], lambda v: v IS NOT NULL)"""
_WORDS = "regexp_extract_all(replace(replace(lower({}), '’', ''''), '''s', ''), '[a-z0-9]{{2,}}')"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[®™]', ' ', 'g'), '\\s+', ' ', 'g'), '^[ ,;:|]+|[ ,;:|]+$', '', 'g')"


@query(
    "brand_renames",
    f"""WITH b AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_text(o)}, {_text(g)}, {_text(br)})" for i, (o, g, br) in enumerate(BRANDS))}) t(k, original, generic, brand)),
s AS (SELECT k, unnest({_WORDS.format("coalesce(generic, '') || ' ' || coalesce(brand, '')")}) AS w FROM b), known AS (SELECT k, list(v) AS known FROM (SELECT k, unnest({_STEMS}) AS v FROM s) GROUP BY k),
o AS (SELECT DISTINCT k, unnest({_WORDS.format("original")}) AS w FROM b), lost AS (SELECT k, string_agg(w, ',' ORDER BY w) AS lost FROM o LEFT JOIN known USING (k) WHERE w NOT IN ({", ".join(map(_text, C.NO_IDENTITY))}) AND NOT coalesce(list_has_any({_STEMS}, known), false) GROUP BY k),
c AS (SELECT *, {_CLEAN.format("generic")} AS name, {_CLEAN.format("original")} AS was, coalesce({_WORDS.format("generic")}, []) AS words, coalesce({_WORDS.format("brand")}, []) AS own FROM b),
v AS (SELECT k, original, name, NOT (list_contains({_list(C.EMPTY_GENERIC)}, name) OR name = was OR length(name) > 180 OR NOT regexp_matches(name, '[a-z]') OR regexp_matches(name, '^([0-9]+([./][0-9]+)?|[¼½¾⅓⅔⅛⅜⅝⅞])(\\s+|$)')
  OR list_contains({_list(C.VAGUE_GENERIC)}, name) OR list_contains({_list(C.VAGUE_GENERIC)}, regexp_replace(name, 's$', '')) OR list_contains({_list(C.VAGUE_GENERIC)}, regexp_replace(name, 'ies$', 'y'))
  OR len(list_filter(words, lambda w: length(w) >= 3)) = 0 OR (len(own) > 0 AND list_has_all(words, own))) AS valid FROM c)
SELECT p_partkey, original, name, valid, coalesce(lost, '') AS lost FROM part JOIN v ON v.k = p_partkey % {len(BRANDS)} LEFT JOIN lost USING (k)""",
)
def brand_renames(spark, sf_dir):
    """For each food a proposed renaming without its brand: the clean name, whether it may be used, and the words it loses."""
    field = lambda i: _pick([b[i] for b in BRANDS], F.col("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", field(0).alias("original"), field(1).alias("generic"), field(2).alias("brand"))
    o, g, b = F.col("original"), F.col("generic"), F.col("brand")
    lost = F.coalesce(F.array_join(C.lost_tokens(o, g, b), ","), F.lit(""))
    return rows.select("p_partkey", "original", C.generic_name(F.coalesce(g, F.lit(""))).alias("name"), C.generic_is_valid(o, g, b).alias("valid"), lost.alias("lost"))
