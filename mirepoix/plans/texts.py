"""Queries: text normal forms, matching predicates, measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.functions import measures as M
from mirepoix.functions import text as T
from mirepoix.operators import match
from mirepoix.plans.registry import query
from mirepoix.plans.tables import steady, table

_QUALIFIERS = ", ".join(f"'{q}'" for q in [*T.QUALIFIERS, "red", "blue"])


def _sql_singular(w: str) -> str:
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.IRREGULAR.items())
    return f"""coalesce(CASE {w} {irregular} END, CASE WHEN length({w}) > 3 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' WHEN length({w}) > 3 AND regexp_matches({w}, '[sxzh]es$') THEN left({w}, length({w}) - 2)
  WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END)"""


@query(
    "dish_family",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_split_to_array(lower(string_split(text, chr(10))[1]), '\\s+(?:with|on|served|topped|and served|in|drizzled)\\s+')[1], '[a-z]+') AS w FROM documents WHERE lang = 'en'),
h AS (SELECT doc_id, coalesce(list_filter(w, lambda x: x NOT IN ({", ".join(f"'{q}'" for q in T.QUALIFIERS)}))[-1], w[-1]) AS head FROM t)
SELECT family, count(*) AS n FROM (SELECT coalesce({_sql_singular('head')}, '') AS family FROM h) GROUP BY family""",
)
def dish_family(spark, sf_dir):
    titles = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return titles.groupBy(T.dish_family(F.col("title")).alias("family")).agg(F.count("*").alias("n"))


@query("slugify", "SELECT DISTINCT p_type, nullif(regexp_replace(trim(replace(lower(p_type || ' - ' || p_brand), '-', ' ')), '\\s+', '_', 'g'), '') AS slug FROM part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", T.slug(F.concat_ws(" - ", "p_type", "p_brand")).alias("slug")).distinct()


@query("singularize", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) SELECT w AS word, {_sql_singular('w')} AS singular FROM w")
def singularize(spark, sf_dir):
    found = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return found.select("word", T.singular_head(F.col("word")).alias("singular"))


@query(
    "number_extract",
    """SELECT conv_id, turn, try_cast(nullif(regexp_extract(text, '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS first_number, round(list_avg(list_transform(regexp_extract_all(text, '\\d+'), lambda x: try_cast(x AS DOUBLE))), 4) AS mean_int FROM conversations""",
)
def number_extract(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.first_number(F.col("text")).alias("first_number"), F.round(T.mean_of_integers(F.col("text")), 4).alias("mean_int"))


@query(
    "url_normalize",
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://(www\\.)?', ''), '[?#].*$', ''), '/+$', '') AS url_key FROM pages""",
)
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normal_url(F.col("url")).alias("url_key"))


@query("content_digest", "SELECT o_orderkey, sha256(array_to_string(list_sort(list_distinct(list_filter([lower(trim(o_orderstatus)), lower(trim(o_orderpriority)), 'item'], lambda x: x <> ''))), '|')) AS digest FROM orders")
def content_digest(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.digest(F.array("o_orderstatus", "o_orderpriority", F.lit("item"))).alias("digest"))


@query(
    "phrase_match",
    """SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' of the ')""",
)
def phrase_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.phrase_in(T.words(F.col("text")), "of the")).select("doc_id")


@query("substring_vs_token", "SELECT count(*) FILTER (contains(p_name, 'in')) AS by_substring, count(*) FILTER (regexp_matches(lower(p_name), '(^|[^a-z0-9])(bolt)(e?s)?([^a-z0-9]|$)')) AS by_token FROM part")
def substring_vs_token(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count_if(F.col("p_name").contains("in")).alias("by_substring"), F.count_if(T.keyword(F.col("p_name"), ["bolt"])).alias("by_token"))


@query(
    "fuzzy_match",
    """WITH n AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS head FROM part), q(term) AS (VALUES ('bolts'), ('rign'), ('widgit'), ('gear'), ('ox'))
SELECT term, head FROM q JOIN n ON levenshtein(term, head) <= CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END""",
)
def fuzzy_match(spark, sf_dir):
    heads = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", -1).alias("head")).distinct()
    # the terms of one request are a few literals: they go along with each head, not through a join
    terms = heads.select("head", F.explode(F.array(*map(F.lit, ("bolts", "rign", "widgit", "gear", "ox")))).alias("term"))
    return terms.where(T.fuzzy_equal(F.col("term"), F.col("head"))).select("term", "head")


@query(
    "token_jaccard",
    """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(substr(text, length(string_split(text, chr(10))[1]) + 1)), '[a-z0-9]+')) AS b FROM documents)
SELECT doc_id, floor(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0) * 100000 + 0.3) / 100000 AS jaccard, floor(coalesce(2.0 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 0.0) * 100000 + 0.3) / 100000 AS f1 FROM t""",
)
def token_jaccard(spark, sf_dir):
    title = F.split_part("text", F.lit("\n"), F.lit(1))  # the first line against all others
    rest = F.substring("text", F.length(title) + 1, F.length("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.words(title)).alias("a"), F.array_distinct(T.words(rest)).alias("b"))
    return rows.select("doc_id", steady(T.jaccard(F.col("a"), F.col("b")), 5).alias("jaccard"), steady(T.overlap_f1(F.col("a"), F.col("b")), 5).alias("f1"))


_EXTRACT = """SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^a-z])(vegan|vegetarian|is|the)([^a-z]|$)') AS diet, try_cast(nullif(regexp_extract(lower(text), '(\\d+)\\s*(?:min|pages|words|e)', 1), '') AS INT) AS max_minutes,
  regexp_extract(lower(text), '(?:without|no|not)\\s+([a-z]+)', 1) AS excluded FROM conversations WHERE role = 'user'"""


@query("constraint_extract", _EXTRACT)
def constraint_extract(spark, sf_dir):
    t = F.lower("text")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", t.rlike("(^|[^a-z])(vegan|vegetarian|is|the)([^a-z]|$)").alias("diet"), F.nullif(F.regexp_extract(t, r"(\d+)\s*(?:min|pages|words|e)", 1), F.lit("")).try_cast("int").alias("max_minutes"), F.regexp_extract(t, r"(?:without|no|not)\s+([a-z]+)", 1).alias("excluded"))


@query("highlight", "SELECT p_partkey, regexp_replace(p_name, '(red|bolt)', '<em>\\1</em>', 'g') AS marked FROM part WHERE regexp_matches(p_name, 'red|bolt')")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").rlike("red|bolt")).select("p_partkey", F.regexp_replace("p_name", "(red|bolt)", "<em>$1</em>").alias("marked"))


@query(
    "food_class",
    """SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'bolt|screw') THEN 'fastener' WHEN regexp_matches(p_name, 'ring|gear') THEN 'round' WHEN p_size > 30 THEN 'large' ELSE 'other' END AS food_class,
  CASE WHEN regexp_matches(p_name, '^(red|blue|green)') THEN 'coloured' END AS coarse FROM part""",
)
def food_class(spark, sf_dir):
    name = F.col("p_name")
    kind = F.when(name.rlike("bolt|screw"), "fastener").when(name.rlike("ring|gear"), "round").when(F.col("p_size") > 30, "large").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("food_class"), F.when(name.rlike("^(red|blue|green)"), "coloured").alias("coarse"))


@query(
    "class_compatibility",
    """WITH h AS (SELECT DISTINCT p_type, string_split(p_name, ' ')[-1] AS h FROM part), bad(a, b) AS (VALUES ('bolt', 'ring'), ('gear', 'widget'))
SELECT DISTINCT x.h AS left_head, y.h AS right_head, NOT EXISTS (SELECT 1 FROM bad WHERE a = least(x.h, y.h) AND b = greatest(x.h, y.h)) AS compatible FROM h x JOIN h y ON x.p_type = y.p_type AND x.h <> y.h""",
)
def class_compatibility(spark, sf_dir):
    # heads that meet under a type: a type has few of them, however many parts there are
    heads = table(spark, sf_dir, "part").select("p_type", F.substring_index("p_name", " ", -1).alias("left_head")).distinct()
    pairs = heads.join(heads.withColumnRenamed("left_head", "right_head"), "p_type").where("left_head <> right_head").select("left_head", "right_head").distinct()
    key = F.concat_ws("|", F.least("left_head", "right_head"), F.greatest("left_head", "right_head"))
    return pairs.select("left_head", "right_head", (~key.isin("bolt|ring", "gear|widget")).alias("compatible"))


@query(
    "title_normalize",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM documents""",
)
def title_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.title_form(F.col("text")).alias("title"))


@query(
    "vocabulary_recovery",
    """WITH v AS (SELECT list(DISTINCT string_split(p_name, ' ')[-1]) AS v FROM part) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: list_contains(v, w) OR w IN ('the', 'of')))), ',') AS found FROM conversations, v""",
)
def vocabulary_recovery(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    known = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", -1).alias("word")).union(spark.createDataFrame([("the",), ("of",)], "word string")).distinct()
    words = said.select("conv_id", "turn", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    found = words.join(known, "word").groupBy("conv_id", "turn").agg(F.array_join(F.sort_array(F.collect_set("word")), ",").alias("found"))
    return said.select("conv_id", "turn").join(found, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("found", F.lit("")).alias("found"))


_LINES = """recipe AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) || CASE l_linenumber % 5 WHEN 0 THEN ' g' WHEN 1 THEN ' cups' WHEN 2 THEN ' oz' WHEN 3 THEN ' tbsp' ELSE '' END AS measurement,
  l_quantity, l_linenumber % 5 AS kind, CASE l_partkey % 4 WHEN 0 THEN 'olive oil' WHEN 1 THEN 'milk' WHEN 2 THEN 'wheat flour' ELSE 'honey' END AS name FROM lineitem)"""


@query(
    "unit_to_grams",
    f"""WITH {_LINES}, g AS (SELECT l_orderkey, CAST(CAST(l_quantity AS INT) AS DOUBLE) * CASE kind WHEN 0 THEN 1.0 WHEN 2 THEN 28.349523125 WHEN 1 THEN 240.0 * d WHEN 3 THEN 15.0 * d ELSE 50.0 END AS grams, CASE kind WHEN 0 THEN 'package' WHEN 2 THEN 'package' WHEN 1 THEN 'volume' WHEN 3 THEN 'volume' ELSE 'piece' END AS how
  FROM (SELECT *, CASE name WHEN 'olive oil' THEN 0.92 WHEN 'milk' THEN 1.03 WHEN 'honey' THEN 1.42 ELSE 1.0 END AS d FROM recipe))
SELECT l_orderkey, how, count(*) AS n, round(sum(grams), 3) AS grams FROM g GROUP BY ALL""",
)
def unit_to_grams(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    unit = F.when(F.col("l_linenumber") % 5 == 0, " g").when(F.col("l_linenumber") % 5 == 1, " cups").when(F.col("l_linenumber") % 5 == 2, " oz").when(F.col("l_linenumber") % 5 == 3, " tbsp").otherwise("")
    name = F.when(F.col("l_partkey") % 4 == 0, "olive oil").when(F.col("l_partkey") % 4 == 1, "milk").when(F.col("l_partkey") % 4 == 2, "wheat flour").otherwise("honey")
    rows = line.select("l_orderkey", F.concat(F.floor("l_quantity").cast("string"), unit).alias("measurement"), name.alias("name"))
    return M.with_grams(rows, piece_g=F.lit(50.0)).groupBy("l_orderkey", "how").agg(F.count("*").alias("n"), F.round(F.sum("grams"), 3).alias("grams"))


@query(
    "quantity_parse",
    """WITH q AS (SELECT DISTINCT CAST(l_quantity AS INT) AS q, l_linenumber % 6 AS kind FROM lineitem)
SELECT CASE kind WHEN 0 THEN q || ' g' WHEN 1 THEN q || ' 1/2 cups' WHEN 2 THEN '1/' || q || ' tsp' WHEN 3 THEN q || '-' || (q + 2) || ' oz' WHEN 4 THEN q || '½ tbsp' ELSE 'Dozen' END AS measurement,
  round(CASE kind WHEN 0 THEN q WHEN 1 THEN q + 0.5 WHEN 2 THEN 1.0 / q WHEN 3 THEN q + 1 WHEN 4 THEN q + 0.5 ELSE 12 END, 6)::DOUBLE AS amount FROM q GROUP BY ALL""",
)
def quantity_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").cast("string").alias("q"), (F.col("l_linenumber") % 6).alias("kind")).distinct()
    forms = [F.concat("q", F.lit(" g")), F.concat("q", F.lit(" 1/2 cups")), F.concat(F.lit("1/"), "q", F.lit(" tsp")), F.concat("q", F.lit("-"), (F.col("q").cast("int") + 2).cast("string"), F.lit(" oz")), F.concat("q", F.lit("½ tbsp"))]
    text = F.coalesce(*(F.when(F.col("kind") == k, form) for k, form in enumerate(forms)), F.lit("Dozen"))
    return rows.select(text.alias("measurement")).distinct().select("measurement", F.round(T.quantity(F.col("measurement")), 6).alias("amount"))


@query(
    "line_split",
    """SELECT measurement, p_name AS name, count(*) AS n FROM (SELECT p_name, CAST(l_quantity AS INT) || CASE l_linenumber % 5 WHEN 0 THEN ' g' WHEN 1 THEN ' 1/2 cups' WHEN 2 THEN ' (400 g) cans' WHEN 3 THEN ' tbsp' ELSE '' END AS measurement
  FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL""",
)
def line_split(spark, sf_dir):
    unit = F.coalesce(*(F.when(F.col("l_linenumber") % 5 == k, u) for k, u in enumerate([" g ", "½ cups of ", " (400 g) cans ", "  tbsp "])), F.lit(" "))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    measurement, name = M.split_line(F.concat(F.col("l_quantity").cast("int").cast("string"), unit, "p_name"))
    return lines.select(measurement.alias("measurement"), name.alias("name")).groupBy("measurement", "name").agg(F.count("*").alias("n"))


@query(
    "realign_lines",
    """WITH RECURSIVE l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, p_name AS name, CAST(l_quantity AS INT) AS q, l_linenumber % 3 AS kind FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT a.k, a.pos, a.n, a.name, a.q || CASE WHEN a.kind = 0 THEN ' g' ELSE ' ' || b.name || 's' END AS said, CASE WHEN a.kind = 0 THEN [a.q::VARCHAR, 'g'] ELSE list_concat([a.q::VARCHAR], string_split(b.name, ' ')) END AS words FROM l a JOIN l b ON a.k = b.k AND b.pos = a.pos % a.n + 1),
r AS (SELECT k, n, list(string_split(name, ' ') ORDER BY pos) AS names, list(said ORDER BY pos) AS said, list(words ORDER BY pos) AS words FROM m GROUP BY k, n),
w AS (SELECT k, n, 0 AS i, CAST([] AS BIGINT[]) AS slots, names, words FROM r UNION ALL
  SELECT k, n, i + 1, list_append(slots, CASE WHEN len(free) = 1 THEN free[1] ELSE -1 END), names, words FROM (SELECT *, list_filter(range(1, n + 1), lambda x: NOT list_contains(slots, x) AND list_has_any(words[x], names[i + 1])) AS free FROM w WHERE i < n)),
f AS (SELECT w.k, r.said, slots, list_filter(range(1, w.n + 1), lambda x: NOT list_contains(slots, x)) AS rest FROM w JOIN r ON w.k = r.k WHERE i = w.n)
SELECT k AS l_orderkey, array_to_string(list_transform(slots, lambda x, i: said[CASE WHEN x > 0 THEN x ELSE rest[len(list_filter(slots[1:i], lambda y: y < 0))] END]), '; ') AS realigned, array_to_string(said, '; ') AS given FROM f""",
)
def realign_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", F.col("p_name").alias("name"))
    recipes = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    following = lambda i: F.get("lines", (i + 1) % F.size("lines"))["name"]
    amount = lambda x: x["l_quantity"].cast("int").cast("string")
    said = F.transform("lines", lambda x, i: F.concat(amount(x), F.when(x["l_linenumber"] % 3 == 0, " g").otherwise(F.concat(F.lit(" "), following(i), F.lit("s")))))
    made = match.realigned(recipes.select("l_orderkey", F.col("lines.name").alias("names"), said.alias("measurements")))
    return made.select("l_orderkey", F.array_join("realigned", "; ").alias("realigned"), F.array_join("measurements", "; ").alias("given"))


@query(
    "mixed_fractions",
    """WITH v AS (SELECT DISTINCT l_quantity / 8 AS v FROM lineitem), p AS (SELECT v, floor(v) AS w, v - floor(v) AS r FROM v), l AS (SELECT v, w, CASE WHEN r < 0.02 THEN '' WHEN r > 0.98 THEN '+' WHEN abs(r - 0.125) < 0.02 THEN '1/8' WHEN abs(r - 0.25) < 0.02 THEN '1/4' WHEN abs(r - 1/3) < 0.02 THEN '1/3'
  WHEN abs(r - 0.5) < 0.02 THEN '1/2' WHEN abs(r - 2/3) < 0.02 THEN '2/3' WHEN abs(r - 0.75) < 0.02 THEN '3/4' END AS f FROM p)
SELECT v AS amount, CASE WHEN f = '' THEN CAST(CAST(w AS BIGINT) AS VARCHAR) WHEN f = '+' THEN CAST(CAST(w AS BIGINT) + 1 AS VARCHAR) WHEN f IS NOT NULL AND w > 0 THEN CAST(CAST(w AS BIGINT) AS VARCHAR) || ' ' || f ELSE coalesce(f, 'other') END AS shown FROM l""",
)
def mixed_fractions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 8).alias("amount")).distinct()
    shown = T.mixed_fraction(F.col("amount"))
    return rows.select("amount", F.when(shown.contains("."), "other").otherwise(shown).alias("shown"))


@query("duration_presence", "SELECT turn, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), '\\d+(\\.\\d+)?\\s*[hm]')) AS with_duration FROM conversations GROUP BY turn")
def duration_presence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("turn", F.lower("text").rlike(r"\d+(\.\d+)?\s*[hm]").alias("timed"))
    return rows.groupBy("turn").agg(F.count("*").alias("n"), F.count_if("timed").alias("with_duration"))


@query("urn_build_parse", "SELECT urn, split_part(urn, ':', 2) AS kind, split_part(urn, ':', 3) AS local_id FROM (SELECT 'urn:item:' || o_orderkey || ':' || lower(o_orderstatus) AS urn FROM orders)")
def urn_build_parse(spark, sf_dir):
    urn = F.concat_ws(":", F.lit("urn"), F.lit("item"), "o_orderkey", F.lower("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(urn.alias("urn")).select("urn", F.split_part("urn", F.lit(":"), F.lit(2)).alias("kind"), F.split_part("urn", F.lit(":"), F.lit(3)).alias("local_id"))


@query(
    "identity_gate",
    """WITH p AS (SELECT p_partkey, p_name AS cand, string_split(p_name, ' ') AS c, string_split(lag(p_name) OVER (ORDER BY p_partkey), ' ') AS m FROM part)
SELECT p_partkey, m IS NOT NULL AND (c[-1] = m[-1] OR len(list_intersect(list_filter(c, lambda x: x <> c[-1]), m)) > 0) AS preserved FROM p""",
)
def identity_gate(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("c"))
    before = part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("c").alias("m"))
    rows = part.join(before, "p_partkey", "left")
    last = F.element_at("c", -1)
    kept = F.col("m").isNotNull() & ((last == F.element_at("m", -1)) | F.arrays_overlap(F.array_remove("c", last), "m"))
    return rows.select("p_partkey", F.coalesce(kept, F.lit(False)).alias("preserved"))
