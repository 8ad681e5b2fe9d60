import random
import re

from pyspark.sql import functions as F

from mirepoix.operators import intents

FOODS = ["milk", "peanut butter", "butter", "eggs", "berries", "green beans", "Fish_sauce", "fish", "box", "", None]


def found(spark, texts, explicit=None):
    rows = [(i, t, "x", explicit) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, words string, explicit array<string>").repartition(3)
    out = intents.wanted_and_excluded(df, spark.createDataFrame([(f,) for f in FOODS], "food string"), explicit="explicit").collect()
    by_id = {r.id: (r.include, r.exclude) for r in out}
    return [by_id[i] for i in range(len(texts))]


def test_cases(spark):
    cases = {
        "soup with milk": (["milk"], []),
        "soup without milk": ([], ["milk"]),
        "no any milk please": ([], ["milk"]),
        "avoid any eggs": ([], ["egg"]),
        "I am allergic to peanut butter, but want butter": (["butter"], ["peanut butter"]),
        "peanut-butter free cake": ([], ["peanut butter"]),
        "without milk, eggs or berry but with butter": (["butter"], ["berry", "egg", "milk"]),
        "fish sauce and fish": (["fish", "fish sauce"], []),
        "free from green bean": ([], ["green bean"]),
        "milk without milk": ([], ["milk"]),
        "egg allergy": ([], ["egg"]),
        "free milk": (["milk"], []),
        "two boxes": (["box"], []),
        "buttermilk": ([], []),
        "": ([], []),
        None: ([], []),
    }
    for (text, want), got in zip(cases.items(), found(spark, list(cases))):
        assert got == want, text
    assert found(spark, ["milk and eggs"], ["Eggs", ""]) == [(["milk"], ["egg"])]


def singular(w):
    if len(w) > 3 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 3 and w.endswith(("ches", "shes", "xes", "zes")):
        return w[:-2]
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")) else w


def brute(text):
    words = re.findall("[a-z0-9]+", text.lower().replace("_", " "))
    spans = []
    for f in FOODS:
        parts = re.findall("[a-z0-9]+", (f or "").lower().replace("_", " "))
        if parts:
            key = [*parts[:-1], singular(parts[-1])]
            spans += [(i, i + len(key), " ".join(key)) for i in range(len(words) - len(key) + 1) if [*words[i : i + len(key) - 1], singular(words[i + len(key) - 1])] == key]
    spans = sorted({s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)})
    out, last = set(), None
    for a, b, key in spans:
        at = a - (a > 0 and words[a - 1] == "any")
        left = at > 0 and (words[at - 1] in intents.BEFORE or at > 1 and " ".join(words[at - 2 : at]) in intents.BEFORE_PAIRS)
        chained = last is not None and last[1] and not left and len(words[last[0] : a]) <= 1 and all(w in intents.JOINERS for w in words[last[0] : a])
        if left or chained or b < len(words) and words[b] in intents.AFTER:
            out.add(key)
        last = (b, left or chained)
    return sorted({k for *_, k in spans} - out), sorted(out)


def test_mentions_equal_a_plain_look(spark):
    rng = random.Random(6)
    pieces = ["milk", "peanut butter", "butter", "egg", "eggs", "green beans", "fish", "fish sauce", "without", "no", "free from", "allergic to", "any", "and", "or", "free", "with", "soup,", "berry"]
    texts = [" ".join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(300)]
    for text, got in zip(texts, found(spark, texts)):
        assert got == brute(text), text


def test_keys(spark):
    cases = {"Green Beans": "green bean", "fish_sauces": "fish sauce", "hummus": "hummus", "": "", "peaches": "peach"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", intents.food_key(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == cases


def test_mentions_carry_no_texts_and_meet_many_foods_alike(spark):
    rng = random.Random(8)
    pieces = ["milk", "peanut butter", "butter", "eggs", "green beans", "fish sauces", "without", "no", "any", "and", "free", "with"]
    texts = spark.createDataFrame([(i, " ".join(rng.choices(pieces, k=rng.randrange(0, 9)))) for i in range(200)], "id int, text string")
    foods = spark.createDataFrame([(f,) for f in FOODS], "food string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = intents.mentions(texts, foods), intents.mentions(texts, foods, few=0)
        nodes = [many._jdf.queryExecution().optimizedPlan()]
        while nodes:
            node = nodes.pop()
            children = [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() in ("Join", "Window"):
                assert all("words#" not in c.output().mkString(" ") for c in children)
            nodes += children
        assert sorted(few.collect()) == sorted(many.collect()) != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
