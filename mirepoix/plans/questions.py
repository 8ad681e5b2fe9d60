"""Queries: ranking words of questions, forms of food names, grades of labels, a plan whose slots share their families."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.functions import rules as R
from mirepoix.functions import scoring
from mirepoix.functions import vocabulary as V
from mirepoix.operators import search
from mirepoix.plans.nutrition import _sql_grade, _sql_points
from mirepoix.plans.registry import query
from mirepoix.plans.rules import _CLEAN, _SINGULAR
from mirepoix.plans.searches import _catalog
from mirepoix.plans.tables import table

_STOP = ", ".join(f"'{w}'" for w in V.RANK_STOP)


@query(
    "rank_words",
    rf"""WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_''-]+'), lambda w: w NOT IN ({_STOP})) AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE text END AS words FROM w""",
)
def rank_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.rank_words(F.col("text")).alias("words"))


_MARKS = [" Low-Fat, cooked", "es (raw) without salt", " Yoghurt, 2 cups", "", " courgettes, drained solids"]
_CALLED = f"raws AS (SELECT p_name || {_MARKS}[p_partkey % {len(_MARKS)} + 1] AS raw, p_partkey FROM part)"
_SYNONYMS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in V.SYNONYMS.items()) + "}"


def _plain(text: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: coalesce({_SYNONYMS}[{_SINGULAR}], {_SINGULAR})), ' ')"


@query(
    "name_variants",
    f"""WITH {_CALLED}, c AS (SELECT p_partkey, trim(lower(raw)) AS a, {_CLEAN} AS b FROM raws), d AS (SELECT *, trim(regexp_replace(regexp_replace(b, '{V.FORM_WORDS}', ' ', 'g'), '\\s+', ' ', 'g'), ' -''/') AS c FROM c),
v AS (SELECT p_partkey, [a, b, c, {_plain('b')}, {_plain('c')}] AS v FROM d), f AS (SELECT p_partkey, list_filter(list_transform(v, lambda x: trim(x)), lambda x: x <> '') AS v FROM v)
SELECT p_partkey, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS variants FROM f""",
)
def name_variants(spark, sf_dir):
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("p_partkey") % len(_MARKS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(R.name_variants(F.concat("p_name", mark)), "|").alias("variants"))


_NEGATIVE = f"({_sql_points('kj', scoring.ENERGY_KJ)} + {_sql_points('sugar', scoring.SUGAR_G)} + {_sql_points('sat', scoring.SATURATED_G)} + {_sql_points('sodium', scoring.SODIUM_MG)})"
_LABEL = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 6 > 0 THEN l_quantity * 10 - 30 END AS g, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 20 END AS kj0, l_extendedprice / 90 AS kcal,
  CASE WHEN l_linenumber <> 5 THEN l_discount * 300 END AS sugar0, l_tax * 100 AS sat0, l_quantity * 20 AS sodium0, l_discount * 40 AS fibre0, l_quantity / 5 AS protein0 FROM lineitem)"""


@query(
    "label_grades",
    f"""WITH {_LABEL}, x AS (SELECT *, g > 0 AND coalesce(kj0, kcal) IS NOT NULL AND sugar0 IS NOT NULL AS good, round(coalesce(kj0, kcal * 4.184) / g * 100, 6) AS kj, round(sugar0 / g * 100, 6) AS sugar, round(sat0 / g * 100, 6) AS sat, round(sodium0 / g * 100, 6) AS sodium, round(fibre0 / g * 100, 6) AS fibre, round(protein0 / g * 100, 6) AS protein FROM l),
s AS (SELECT *, {_NEGATIVE} - {_sql_points('fibre', scoring.FIBRE_G)} - CASE WHEN {_NEGATIVE} >= 11 THEN 0 ELSE {_sql_points('protein', scoring.PROTEIN_G)} END AS score FROM x)
SELECT l_partkey, grade, count(*) AS n FROM (SELECT l_partkey, CASE WHEN good THEN {_sql_grade('score')} END AS grade FROM s) GROUP BY ALL""",
)
def label_grades(spark, sf_dir):
    """The grades of lines read as labels for each part; null counts the labels that tell too little."""
    line, nth = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    g = F.when(nth % 6 > 0, F.col("l_quantity") * 10 - 30)
    kj, kcal, sugar = F.when(nth % 2 == 0, F.col("l_extendedprice") / 20), F.col("l_extendedprice") / 90, F.when(nth != 5, F.col("l_discount") * 300)
    grade = scoring.label(g, kj, kcal, sugar, F.col("l_tax") * 100, F.col("l_quantity") * 20, F.col("l_discount") * 40, F.col("l_quantity") / 5)
    return line.select("l_partkey", grade.alias("grade")).groupBy("l_partkey", "grade").agg(F.count("*").alias("n"))


@query("diverse_plan")
def diverse_plan(spark, sf_dir):
    """Six rows for each class of part, as the slots of a plan that shares its families."""
    rows = _catalog(spark, sf_dir)
    slots = [(name, rows.where(F.col("class") == name)) for name in ("ECONOMY", "STANDARD", "PROMO")]
    return search.diverse_slots(slots, "family", [F.col("rank"), F.desc("price"), F.col("id")], 6).select("slot", "id", "family")
