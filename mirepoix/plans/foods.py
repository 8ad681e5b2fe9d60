"""Queries: nearest vectors of many, and foods for names, over the embeddings and the names of the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirepoix.functions import food_classes as C
from mirepoix.operators import foods, intents, neighbours
from mirepoix.plans.registry import query
from mirepoix.plans.tables import table
from mirepoix.plans.weights import _N, FOODS, _food, _list


@query(
    "knn_pairs",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS s FROM v q JOIN v ON q.vec_id % 5 = 0)
SELECT query_id, vec_id, floor(s * 100000 + 0.3) / 100000 AS similarity, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS nth FROM s) WHERE nth <= 10""",
)
def knn_pairs(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = neighbours.nearest(vectors.where("vec_id % 5 = 0"), vectors, 10, query_id="vec_id")
    return found.select("query_id", "vec_id", (F.floor(F.col("similarity") * 100000 + 0.3) / 100000).alias("similarity"), "nth")


_NAMED = f"named AS (SELECT p_partkey, p_name || ' ' || {_list(FOODS)}[p_partkey % {_N} + 1] AS name FROM part)"


def _class_sql(name: str) -> str:
    own = {c: f"regexp_replace(lower({name}), '{C.NOT_OF[c]}', ' ', 'g')" if c in C.NOT_OF else f"lower({name})" for c in C.CLASSES}
    return "CASE " + " ".join(f"WHEN regexp_matches({own[c]}, '{C.pattern(c).replace(chr(39), chr(39) * 2)}') THEN '{c}'" for c in C.CLASSES) + " ELSE 'other' END"


@query("food_classes", f"WITH {_NAMED} SELECT p_partkey, {_class_sql('name')} AS food_class FROM named")
def food_classes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.food_class(F.concat_ws(" ", "p_name", _food("p_partkey"))).alias("food_class"))


@query("turn_food_class", f"SELECT food_class, count(*) AS n FROM (SELECT {_class_sql('text')} AS food_class FROM conversations) GROUP BY food_class")
def turn_food_class(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(C.food_class(F.col("text")).alias("food_class")).groupBy("food_class").agg(F.count("*").alias("n"))


@query(
    "line_class_clashes",
    f"""WITH {_NAMED}, c AS (SELECT l_orderkey, l_linenumber, {_class_sql('name')} AS c FROM lineitem JOIN named ON l_partkey = p_partkey),
apart(pair) AS (VALUES {", ".join(f"('{p}')" for p in C.APART_PAIRS)}), p AS (SELECT least(a.c, b.c) || '|' || greatest(a.c, b.c) AS pair, a.c AS line_class, b.c AS head_class FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1)
SELECT line_class, head_class, pair NOT IN (SELECT pair FROM apart) AS compatible, count(*) AS n FROM p GROUP BY ALL""",
)
def line_class_clashes(spark, sf_dir):
    named = food_classes(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(named, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("food_class").alias("line_class"))
    heads = lines.where("l_linenumber = 1").select("l_orderkey", F.col("line_class").alias("head_class"))
    both = lines.join(heads, "l_orderkey")
    return both.select("line_class", "head_class", C.compatible(F.col("line_class"), F.col("head_class")).alias("compatible")).groupBy("line_class", "head_class", "compatible").agg(F.count("*").alias("n"))


def letters(name: Column) -> Column:
    """How often a name has each letter, and each pair of letters by hash: a vector that needs no model."""
    text = F.lower(F.coalesce(name, F.lit("")))
    single = [(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"]
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.pmod(F.crc32(F.substring(text, i, 2)), F.lit(38)))
    return F.concat(F.array(*single), F.transform(F.sequence(F.lit(0), F.lit(37)), lambda d: F.size(F.filter(pairs, lambda p: p == d)).cast("double")))


@query("nutrition_match_pairs")
def nutrition_match_pairs(spark, sf_dir):
    """The food of each distinct name of a line; foods are parts of odd key, aliases and links come from parts, too."""
    part = table(spark, sf_dir, "part")
    line = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    names = line.select(F.concat_ws(" ", F.when(F.col("l_linenumber") % 2 == 0, "2 cups fresh chopped"), "p_name", _food("l_orderkey")).alias("name"))
    called = F.concat_ws(", ", _food("p_partkey"), "p_name", F.when(F.col("p_size") % 7 == 0, "raw").when(F.col("p_size") % 7 == 1, "canned"))
    pool = part.where("p_partkey % 2 = 1").groupBy(called.alias("food_name")).agg(F.min("p_partkey").alias("food_id"))
    aliases = part.where("p_size = 3").select(F.concat_ws(" ", "p_name", _food("p_partkey")).alias("alias"), F.col("p_partkey").alias("food_id"), called.alias("label"))
    links = part.where("p_size = 4").select(F.concat_ws(" ", "p_name", _food("p_partkey")).alias("name"), F.col("p_partkey").alias("food_id"), called.alias("label"), F.lit(0.9).alias("similarity"))
    return foods.best_foods(names, pool, aliases, links, letters).withColumn("similarity", F.round("similarity", 6))


@query("include_exclude")
def include_exclude(spark, sf_dir):
    """What each turn asks for and rules out, of the names of parts and foods: turns say so after their own text."""
    said, part = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("nth"), "p_name")
    turns = said.withColumn("nth", F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(190)) + 1).join(names, "nth").withColumn("key", F.col("conv_id") + F.col("turn"))
    cues = [F.lit("with"), F.lit("without"), F.lit("no"), F.lit("allergic to"), F.lit("and any"), F.lit("free from")]
    cue = F.element_at(F.array(*cues), (F.col("key") % len(cues) + 1).cast("int"))
    text = F.concat_ws(" ", "text", cue, "p_name", F.when(F.col("key") % 2 == 0, "or").otherwise("but"), _food("key"), F.when(F.col("key") % 5 == 0, "free"))
    foods_ = part.select(F.explode(F.array("p_name", _food("p_partkey"), F.substring_index("p_name", " ", -1))).alias("food"))
    rows = turns.select(F.struct("conv_id", "turn").alias("id"), text.alias("text"))
    found = intents.wanted_and_excluded(rows, foods_)
    return found.select("id.conv_id", "id.turn", F.array_join("include", ", ").alias("include"), F.array_join("exclude", ", ").alias("exclude"))
