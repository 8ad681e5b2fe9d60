"""Rules of who can eat a food: what blocks a consumer group, what speaks for it, names that are guarded against both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirepoix.functions.text import once

# Taxonomy classes, keywords and name patterns of each consumer group's rules.
PLANT_ROOTS = ["FOODON_00001015", "FOODON_00002129", "FOODON_00002134", "FOODON_00002260"]
VEGAN_ALLERGENS = "milk egg fish crustacean_shellfish molluscs".split()
VEGAN_ROOTS = ["FOODON_00002671", "FOODON_00001046", "FOODON_00001248", "FOODON_00001293", "FOODON_00001256", "FOODON_00001274", "FOODON_00001900", "FOODON_00001899", "CHEBI_5291"]
VEGAN_WORDS = """beef pork bacon ham turkey chicken duck goose lamb mutton veal venison goat meat sausage pepperoni prosciutto fish salmon tuna cod
shrimp prawn crab lobster shellfish milk cheese butter cream yogurt gelatin whey casein honey""".split()
VEGETARIAN_ALLERGENS = "fish crustacean_shellfish molluscs".split()
VEGETARIAN_ROOTS = ["FOODON_00002671", "FOODON_00001046", "FOODON_00001248", "FOODON_00001293", "FOODON_00001900", "FOODON_00001899", "CHEBI_5291"]
VEGETARIAN_WORDS = """beef pork bacon ham turkey chicken duck goose lamb mutton veal venison goat meat sausage pepperoni prosciutto fish salmon tuna
cod shrimp prawn crab lobster shellfish gelatin""".split()
COELIAC_ALLERGENS = "gluten wheat".split()
COELIAC_ROOTS = ["FOODON_03420177", "FOODON_00001907", "FOODON_03310809", "FOODON_00001275", "FOODON_00001217", "FOODON_00001272"]
COELIAC_WORDS = "gluten wheat barley rye spelt kamut farro durum bulgur malt seitan flour bread pasta noodle oats".split()
PLANT_ALTERNATIVES = [
    r"\b(vegan|vegetarian|plant[ -]*based)\b",
    r"\b(coconut|soy|soya|almond|oat|rice|cashew|hazelnut|hemp|pea)([ -]+(flavoured|flavored))?[ -]+(milk|cream|yogurt|yoghurt)\b",
    r"\b(non[ -]*dairy|dairy[ -]*free)\b",
    r"\b(peanut|almond|cashew|hazelnut|walnut|seed|nut)[ -]+butter\b",
    r"\bbutter[ -]*beans?\b",
    r"\bbutternut\b",
]
GLUTEN_SAFE = [
    r"\bgluten[ -]*free\b",
    r"^gluten[ -]+(baking flour|self raising flour|flour|soy sauce|bread|pasta|flour almond coconut|flour mix|bread mix)$",
    r"\bbuckwheat\b",
    r"\b(rice|tapioca|potato|almond|coconut|besan|chickpea|corn|maize|quinoa|cassava|arrowroot)[ -]+flour\b",
    r"\b(rice|pulse|chickpea|corn|maize|quinoa)[ -]+(noodles?|pasta|spaghetti)\b",
    r"\btamari\b",
    r"\bpasta[ -]+sauce\b",
    r"^(ground|minced|fresh|crystallized|crystallised|pickled|glace)?[ -]*ginger$",
    r"\b(wine|vinegar|vinaigrette)\b",
]
NO_EVIDENCE = [r"^\s*\*?\s*note\b", r"\bingredients? with an asterisk\b", r"\busually gluten[ -]*free\b", r"\bcheck the label\b"]
#: Where evidence of an allergen counts from: what keywords alone say does not.
TRUSTED = ["taxonomy", "manual", "label"]
EXPLICIT = "explicit_suitability_term"


@dataclass(frozen=True)
class Rule:
    group: str
    allergens: Sequence[str]
    roots: Sequence[str]
    words: Sequence[str]
    safe: Sequence[str]
    good_roots: Sequence[str]
    good_words: Sequence[str]

    def on(self, roots: Sequence[str], good_roots: Sequence[str]) -> Rule:
        """The rule over another taxonomy's classes."""
        return replace(self, roots=roots, good_roots=good_roots)


RULES = [
    Rule("vegan", VEGAN_ALLERGENS, VEGAN_ROOTS, VEGAN_WORDS, PLANT_ALTERNATIVES, PLANT_ROOTS, ["vegan", "plant based", "plant-based"]),
    Rule("vegetarian", VEGETARIAN_ALLERGENS, VEGETARIAN_ROOTS, VEGETARIAN_WORDS, PLANT_ALTERNATIVES, PLANT_ROOTS, ["vegan", "vegetarian", "plant based", "plant-based"]),
    Rule("coeliac", COELIAC_ALLERGENS, COELIAC_ROOTS, COELIAC_WORDS, GLUTEN_SAFE, [], ["gluten free", "gluten-free"]),
]


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def word_pattern(word: str) -> str:
    """A keyword as a whole word, also with -s or -es; blanks of any width, or hyphens, between its parts."""
    return r"\b" + word.replace(" ", r"[\s-]+") + r"(?:e?s)?\b"


def hits(name: Column, words: Sequence[str]) -> Column:
    """The keywords in a name, in the order of the list."""
    return F.array_compact(F.array(*(F.when(F.lower(name).rlike(word_pattern(w)), w) for w in words)))


def verdict(rule: Rule, name: Column, allergens: Column, roots: Column) -> Column:
    """(group, status, reasons, sources) by one rule; null where nothing is known of the group.

    allergens: those that trusted evidence tells, sorted; roots: the classes above the food, sorted; name is not null.
    What blocks comes first, unless the name is guarded as an alternative; what speaks for the food counts unless it is
    blocked or its name takes it back ("check the label").
    """
    of = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    given = lambda c, value: F.when(F.size(c) > 0, F.array(F.lit(value))).otherwise(F.array().cast("array<string>"))
    row = lambda status, why, sources: F.struct(F.lit(rule.group).alias("group"), F.lit(status).alias("status"), why.alias("reasons"), sources.alias("sources"))
    bad_roots, good_roots = F.array_intersect(roots, of(rule.roots)), F.array_intersect(roots, of(rule.good_roots))
    known = F.struct(F.concat(F.array_intersect(allergens, of(rule.allergens)), bad_roots, hits(name, rule.words)).alias("bad"), bad_roots.alias("bad_roots"), allergens.alias("allergens"), good_roots.alias("good"), hits(name, rule.good_words).alias("words"), F.lower(name).alias("name"))

    def told(k: Column) -> Column:
        blocked = (F.size(k["bad"]) > 0) & ~k["name"].rlike(any_of(rule.safe))
        good = ((F.size(k["good"]) > 0) | (F.size(k["words"]) > 0)) & ~k["name"].rlike(any_of(NO_EVIDENCE))
        bad_sources = F.concat(F.array(F.lit("rules")), given(k["bad_roots"], "taxonomy"), given(k["allergens"], "allergen_evidence"))
        good_reasons = F.when(F.size(k["good"]) > 0, k["good"]).otherwise(F.array(F.lit(EXPLICIT)))
        return F.when(blocked, row("not_suitable", k["bad"], bad_sources)).when(good, row("suitable", good_reasons, F.concat(given(k["good"], "taxonomy"), F.array(F.lit("rules")))))

    return once(known, told)
