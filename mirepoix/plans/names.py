"""Queries: names in the clauses of texts, under the normal forms of ingredient lists and of reference links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mirepoix.functions import names as N
from mirepoix.plans.registry import query
from mirepoix.plans.tables import table


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql(text: str, steps) -> str:
    return reduce(lambda t, step: f"regexp_replace({t}, {_quoted(step[0])}, {_quoted(step[1])}, 'g')", steps, text)


def _in(values) -> str:
    return "(" + ", ".join(map(_quoted, values)) + ")"


_TRIM = [(rf"^{N._S}+|{N._S}+$", "")]
_PLURAL = " ".join(f"WHEN regexp_matches(s, '{rx}') AND length(s) >= {least} THEN left(s, length(s) - {cut}) || '{put}'" for rx, least, cut, put in N.PLURALS)
_CLAUSES = "SELECT unnest(string_split_regex(text, '[.;\n]')) AS raw FROM documents"
_STEPS = f"""a AS (SELECT {_sql("raw", N.BEFORE)} AS s FROM ({_CLAUSES})), b AS (SELECT s, list_filter(list_transform(string_split(s, ','), lambda p: {_sql("p", _TRIM)}), lambda p: p <> '') AS p FROM a),
c AS (SELECT CASE WHEN contains(s, ',') AND len(p) > 0 THEN CASE WHEN len(p) > 1 AND lower(p[1]) IN {_in(N.CATEGORIES)} THEN p[1] || ' ' || p[2] ELSE p[1] END ELSE s END AS s FROM b),
d AS (SELECT {_sql(f"lower({_sql('s', N.AFTER)})", N.LOWERED)} AS s FROM c), e AS (SELECT s, trim(regexp_extract(s, {_quoted(N.PORTION)}, 1)) AS h FROM d),
f AS (SELECT {_sql(f"CASE WHEN h <> '' AND string_split(h, ' ')[-1] NOT IN {_in(N.KEEP_BEFORE_PORTION)} THEN h ELSE s END", N.LAST)} AS s FROM e),
g AS (SELECT {_sql(f"CASE {_PLURAL} ELSE s END", N.ENDS)} AS s FROM f),
h AS (SELECT CASE WHEN s IS NULL OR s IN {_in(N.NOISE)} OR regexp_matches(s, '[0-9]') AND length(s) <= 4 THEN NULL ELSE s END AS name FROM g)"""


@query("clause_names", f"WITH {_STEPS} SELECT name, count(*) AS n FROM h GROUP BY name")
def clause_names(spark, sf_dir):
    """How often each name stands in the clauses of all documents; null counts the clauses that name nothing."""
    clauses = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[.;\n]")).alias("raw"))
    # each distinct clause is worked out once: texts repeat much
    counted = clauses.groupBy("raw").agg(F.count("*").alias("n"))
    return counted.select(N.ingredient_name(F.col("raw")).alias("name"), "n").groupBy("name").agg(F.sum("n").alias("n"))


_FOLDED = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.FOLDED.items()) + "}"


@query(
    "canonical_links",
    f"""WITH c AS (SELECT unnest(string_split_regex(text, '[.;\n?!]')) AS raw FROM conversations UNION ALL SELECT p_name || ' to taste, ' || lower(p_type) || ' leaves' FROM part),
w AS (SELECT list_filter(string_split_regex(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN {_in(N.DROPPED)}) AS w FROM c)
SELECT name, count(*) AS n FROM (SELECT array_to_string(list_transform(w, lambda x: coalesce({_FOLDED}[x], x)), ' ') AS name FROM w) GROUP BY name""",
)
def canonical_links(spark, sf_dir):
    """How often each name that links are looked up by stands in clauses of turns and in names of parts."""
    said = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "[.;\n?!]")).alias("raw"))
    parts = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" to taste, "), F.lower("p_type"), F.lit(" leaves")))
    return said.union(parts).select(N.canonical_name(F.col("raw")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
