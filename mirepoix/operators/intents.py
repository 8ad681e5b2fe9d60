"""What questions ask for and rule out: mentions of a vocabulary as token spans, and the scopes of negations."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.functions import text as T
from mirepoix.operators.scans import checkpointed

# Words before a mention that rule it out, with those that must stand before them, and words after one.
BEFORE = "without avoid avoiding exclude excluded excluding no".split()
BEFORE_PAIRS = ["free from", "free of", "allergic to", "allergy to"]
AFTER = "free allergy allergic".split()
JOINERS = "and or nor".split()
#: Up to so many different foods are sent to the questions whole; more are met by a shuffle.
FEW_FOODS = 100_000


def singular_key(word: Column) -> Column:
    """The singular by the rules of search terms: -ies, then -es after ch sh x z, then -s but not -ss, -us or -is."""
    n = F.length(word)
    ends = lambda *tails: reduce(or_, (word.endswith(t) for t in tails))
    ladder = F.when((n > 3) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y"))).when((n > 3) & ends("ches", "shes", "xes", "zes"), F.left(word, n - 2))
    return ladder.when((n > 3) & word.endswith("s") & ~ends("ss", "us", "is"), F.left(word, n - 1)).otherwise(word)


def food_key(text: Column) -> Column:
    """A term's words, the last one singular, joined by blanks: how terms are compared."""
    joined = lambda words: F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(singular_key(F.element_at(words, -1)))), " ")
    return T.once(T.words(F.replace(text, F.lit("_"), F.lit(" "))), lambda words: F.when(F.size(words) > 0, joined(words)).otherwise(""))


def mentions(questions: DataFrame, foods: DataFrame, key: str = "id", text: str = "text", food: str = "food", few: int = FEW_FOODS) -> DataFrame:
    """(key, start, stop, food_key, excluded) of the mentions of foods in each question, by words from 0.

    Each word and each number of words that foods have make a phrase, its last word in the singular, that meets equal
    foods; where there are few of them, they are sent to the questions. What goes through a shuffle has the phrase and
    what its four neighbours tell, never the words of its question.
    A mention inside a longer one is none. It is excluded by a word that rules it out right before it,
    with or without "any", or right after it; what follows an excluded one, joined by nothing or by and, or, nor, is
    excluded with it. questions: keys not null and not repeated; null texts, and empty foods, mention nothing.
    """
    # dealt out by question, as few files would leave all texts to few tasks; the windows below need it so anyway
    said = questions.select(F.col(key).alias("id"), F.col(text).alias("text")).repartition("id").select("id", F.inline(F.array(F.struct(T.words(F.replace("text", F.lit("_"), F.lit(" "))).alias("words")))))
    # worked out ahead in a lambda: written out for each phrase, the code would be too long for Java to compile
    said = said.select("id", "words", F.inline(F.array(F.struct(F.transform("words", singular_key).alias("singular")))))
    # a key is worked out once for each different food, so not while they are told apart, whither a filter would move it
    keys = checkpointed(foods.select(F.col(food).alias("food")).distinct()).select(food_key(F.col("food")).alias("food_key"))
    known = checkpointed(keys.distinct().where("food_key != ''"))
    sizes = {r.n: r.foods for r in known.groupBy(F.size(F.split("food_key", " ")).alias("n")).agg(F.count("*").alias("foods")).collect()}
    at = F.col("start")
    phrase = lambda n: F.array_join(F.concat(F.slice("words", at + 1, n - 1), F.slice("singular", at + n, 1)), " ") if n > 1 else F.get("singular", at)
    phrases = F.array(*(F.struct(F.lit(n).alias("n"), F.when(F.size("words") >= at + n, phrase(n)).alias("food_key")) for n in sorted(sizes))) if sizes else F.array().cast("array<struct<n:int,food_key:string>>")
    tokens = said.select("id", "words", "singular", F.posexplode("words").alias("start", "token")).select("id", "words", "start", F.inline(phrases))
    word = lambda by: F.get("words", at + by)
    light = tokens.where("food_key is not null").select("id", at.cast("int").alias("start"), (at + F.col("n")).cast("int").alias("stop"), "food_key", F.array(word(-1), word(-2), word(-3), word(F.col("n"))).alias("near"))
    spans = light.join(F.broadcast(known) if sum(sizes.values()) <= few else known, "food_key")
    before = W.partitionBy("id").orderBy("start", F.desc("stop")).rowsBetween(W.unboundedPreceding, -1)
    own = spans.withColumn("reach", F.max("stop").over(before)).where("reach is null or stop > reach").drop("reach")
    near = lambda i: F.col("near")[i]
    rules_out = lambda i: near(i).isin(BEFORE) | F.concat_ws(" ", near(i + 1), near(i)).isin(BEFORE_PAIRS)
    left = F.when(near(0) == "any", rules_out(1)).otherwise(rules_out(0))
    cues = own.select("id", "start", "stop", "food_key", F.coalesce(left, F.lit(False)).alias("left"), F.coalesce(near(3).isin(AFTER), F.lit(False)).alias("right"), F.coalesce(near(0).isin(JOINERS), F.lit(False)).alias("joins"))
    order = W.partitionBy("id").orderBy("start")
    gap = at - F.lag("stop").over(order)
    joined = F.coalesce((gap <= 0) | (gap == 1) & F.col("joins"), F.lit(False)) & ~F.col("left")
    chains = cues.withColumn("chain", F.sum(F.when(joined, 0).otherwise(1)).over(order))
    ruled = F.max("left").over(W.partitionBy("id", "chain"))
    return chains.select(F.col("id").alias(key), "start", "stop", "food_key", (ruled | F.col("right")).alias("excluded"))


def wanted_and_excluded(questions: DataFrame, foods: DataFrame, key: str = "id", text: str = "text", food: str = "food", explicit: str | None = None) -> DataFrame:
    """(key, include, exclude): of each question the sorted keys of foods that it asks for, and of those that it rules out.

    A food both asked for and ruled out is ruled out. explicit: a column with an array of foods that are ruled out
    whatever the question says. Questions that mention none have empty lists.
    """
    found = mentions(questions, foods, key, text, food).groupBy(key).agg(F.collect_set("food_key").alias("all__"), F.collect_set(F.when(F.col("excluded"), F.col("food_key"))).alias("out__"))
    none = F.array().cast("array<string>")
    given = F.array_remove(F.transform(F.coalesce(explicit, none), food_key), "") if explicit else none
    rows = questions.select(key, given.alias("given__")).join(found, key, "left")
    out = F.array_sort(F.array_distinct(F.concat(F.coalesce("out__", none), "given__")))
    return rows.select(key, F.array_sort(F.array_except(F.coalesce("all__", none), out)).alias("include"), out.alias("exclude"))
