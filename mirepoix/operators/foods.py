"""Foods for ingredient names, end to end: aliases, vector and lexical candidates, reranking, a gate, a second look without qualifiers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.functions import food_classes as C
from mirepoix.functions import rules as R
from mirepoix.functions import text as T
from mirepoix.operators import match
from mirepoix.operators.neighbours import nearest
from mirepoix.operators.report import top_n
from mirepoix.operators.scans import checkpointed

# States of cooking, marks of processing and brands, qualifiers that a second look leaves out.
COOKED = """cooked roasted roast rotisserie baked grilled chargrilled broiled barbecued barbecue fried deepfried panfried stirfried braised stewed casseroled
simmered poached microwaved sauteed saute boiled hardboiled steamed toasted blanched scrambled scalloped creamed rendered gratin fricassee smoked cured dried
dehydrated canned tinned jellied potted frozen breaded coated battered glazed roll deli luncheon patties patty nuggets""".split()
PROCESSED = COOKED + """oscar mayer kraft heinz campbell nestle kellogg general mills betty crocker pillsbury mccormick knorr maggi babyfood infant powder
powdered concentrate concentrated instant reconstituted fortified snack snacks takeaway fast""".split()
QUALIFIERS = ["extra virgin", "low fat", "reduced fat", *"extra virgin fresh freshly ground low reduced unsalted salted dried raw cooked chopped sliced grated peeled crushed".split()]


def without_qualifiers(name: Column) -> Column:
    """A name without words that qualify it, two-word ones first; null if that leaves nothing or nothing was left out."""
    plain = T.squeezed(F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", " "))
    left = T.squeezed(F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(plain, " ", "  "), F.lit(" ")), r" (?:" + "|".join(q.replace(" ", " +") for q in QUALIFIERS) + r") ", " "))
    return F.when((left != "") & (left != plain), left)


def candidate_bm25(candidates: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """candidates (name, q_tokens, food_id, tokens, ...) with lexical: BM25 of a name's tokens over its own candidates, over the largest.

    A name has a bounded number of candidates, so a window over them is no bottleneck.
    """
    of = W.partitionBy("name")
    n, mean = F.count("*").over(of), F.avg(F.size("tokens")).over(of)
    counted = candidates.withColumns({"n": n, "norm": k1 * (1 - b + b * F.size("tokens") / F.greatest(mean, F.lit(1e-9)))})
    terms = counted.select("name", "food_id", "n", "norm", "tokens", F.explode(F.array_distinct("q_tokens")).alias("term"))
    tf = F.size(F.filter("tokens", lambda t: t == F.col("term")))
    df = F.count_if(F.col("tf") > 0).over(W.partitionBy("name", "term"))
    scored = terms.withColumn("tf", tf).withColumn("df", df).where("tf > 0")
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + F.col("norm"))
    sums = scored.groupBy("name", "food_id").agg(F.sum(part).alias("bm25"))
    joined = candidates.join(sums, ["name", "food_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    most = F.max("bm25").over(of)
    return joined.withColumn("lexical", F.when(most > 0, F.col("bm25") / most).otherwise(0.0)).drop("bm25")


def reranked(candidates: DataFrame, least: float = 0.7) -> DataFrame:
    """(name, food_id, food_name, similarity, score, confidence): each name's best candidate, and how sure it is.

    candidates: (name, cleaned, food_id, food_name, similarity, rrf, curated), some to a name. A candidate of a class
    that can't be the name's loses 1, one that shares no word 0.5 unless it is very near, one cooked, processed or
    branded as the name isn't 0.12; a raw one gains 0.06 where the name tells no state, a vetted link 0.06. Ties go to
    the larger similarity, then the smaller food_id. Confidence: strong, curated, weak or none.
    """
    given = R.query_tokens(F.col("cleaned"))
    rows = candidates.select("*", F.inline(F.array(F.struct(given.alias("q_tokens"), R.query_tokens(F.col("food_name")).alias("tokens"), T.words(F.col("name")).alias("said"), T.words(F.col("food_name")).alias("called"), C.food_class(F.col("cleaned")).alias("q_class"), C.food_class(F.col("food_name")).alias("class")))))
    scored = candidate_bm25(rows)
    overlap = F.size(F.array_intersect("q_tokens", "tokens"))
    marks = F.array_except(F.array_intersect("called", F.array(*map(F.lit, sorted(set(PROCESSED))))), F.col("said"))
    raw = (F.size(marks) == 0) & F.array_contains("called", "raw") & ~F.arrays_overlap("said", F.array(*map(F.lit, COOKED)))
    base = match.rerank_score(F.col("similarity"), F.col("lexical"), F.col("rrf"), overlap, F.size(F.array_distinct("q_tokens")), F.col("curated"), raw, ~C.compatible(F.col("q_class"), F.col("class")))
    score = base - F.when(F.size(marks) > 0, 0.12).otherwise(0.0)
    best = top_n(scored.withColumns({"score": score, "overlap": overlap}), ["name"], [F.desc("score"), F.desc("similarity"), F.col("food_id")], 1)
    sure = match.verdict(F.col("score"), F.col("similarity"), F.col("overlap"), least)
    return best.select("name", "food_id", "food_name", "similarity", "score", F.when((sure == "strong") & F.col("curated"), "curated").otherwise(sure).alias("confidence"))


def best_foods(names: DataFrame, foods: DataFrame, aliases: DataFrame, links: DataFrame, vector_of: Callable[[Column], Column], k: int = 25, least: float = 0.7) -> DataFrame:
    """(name, food_id, food_name, similarity, confidence, found_by) for each distinct name.

    An alias of the name, or of the cleaned name, wins outright. Else the k foods nearest by vector and those links of
    the cleaned name compete (see reranked). Names that find nothing sure are looked for again without qualifiers, and
    take that if it is sure. `none`: the best candidate fell short, food_id and food_name are null; without any
    candidate the similarity is null, too. Null and empty names are left out.

    names: (name); foods: (food_id, food_name), no id repeated; aliases: (alias, food_id, label) and links: (name,
    food_id, label, similarity), keys lower-cased, of repeated ones the least food_id counts. vector_of: an expression
    of a name's vector, that of a food's name as well.
    """
    cleaned = F.coalesce(F.nullif(R.clean_query(F.col("name")), F.lit("")), F.lower(F.trim("name")))
    asked = checkpointed(names.select("name").where("trim(name) != ''").distinct().withColumn("cleaned", cleaned))
    one = aliases.groupBy("alias").agg(F.min(F.struct("food_id", "label")).alias("a"))
    hit = asked.join(one.select(F.col("alias").alias("key1"), F.col("a").alias("a1")), F.lower(F.trim("name")) == F.col("key1"), "left").join(one.select(F.col("alias").alias("key2"), F.col("a").alias("a2")), F.col("cleaned") == F.col("key2"), "left")
    hit = hit.select("name", "cleaned", F.coalesce("a1", "a2").alias("a"))
    known = hit.where("a is not null").select("name", "a.food_id", F.col("a.label").alias("food_name"), F.lit(1.0).alias("similarity"), F.lit("alias").alias("confidence"), F.lit("alias").alias("found_by"))
    rest = hit.where("a is null").select("name", "cleaned")
    vectors = checkpointed(foods.select("food_id", "food_name", vector_of(F.col("food_name")).alias("embedding")))
    link = links.groupBy(F.col("name").alias("cleaned")).agg(F.min(F.struct("food_id", "label", "similarity")).alias("l"))
    sure = ["alias", "strong", "curated"]

    def looked(asked: DataFrame, how: str) -> DataFrame:
        texts = checkpointed(asked.select("cleaned").distinct().withColumn("embedding", vector_of(F.col("cleaned"))))
        near = nearest(texts, vectors, k, query_id="cleaned", vector_id="food_id").withColumnRenamed("query_id", "cleaned")
        near = near.join(vectors.select(F.col("food_id").alias("vec_id"), "food_name"), "vec_id").select("cleaned", F.col("vec_id").alias("food_id"), "food_name", "similarity", (61.0 / (60 + F.col("nth"))).alias("rrf"), F.lit(False).alias("curated"))
        plain = F.size(F.array_except(F.array_intersect(T.words(F.col("l.label")), F.array(*map(F.lit, sorted(set(PROCESSED))))), T.words(F.col("cleaned")))) == 0
        linked = texts.join(link, "cleaned").select("cleaned", "l.food_id", F.col("l.label").alias("food_name"), "l.similarity", F.lit(0.0).alias("rrf"), plain.alias("curated"))
        both = top_n(near.union(linked), ["cleaned", "food_id"], [F.desc("curated"), F.desc("similarity")], 1).drop("nth")
        best = reranked(asked.join(both, "cleaned"), least)
        return asked.select("name").join(best, "name", "left").select("name", "food_id", "food_name", "similarity", F.coalesce("confidence", F.lit("none")).alias("confidence"), F.lit(how).alias("found_by"))

    first = checkpointed(looked(rest, "name"))
    again = first.where(~F.col("confidence").isin(sure)).select("name", without_qualifiers(F.col("name")).alias("cleaned")).where("cleaned is not null")
    second = checkpointed(looked(again, "stripped name").where(F.col("confidence").isin(sure)))
    kept = first.join(second.select("name"), "name", "left_anti")
    result = reduce(DataFrame.union, [known, kept, second])
    none = F.col("confidence") == "none"
    return result.select("name", F.when(~none, F.col("food_id")).alias("food_id"), F.when(~none, F.col("food_name")).alias("food_name"), "similarity", "confidence", "found_by")
