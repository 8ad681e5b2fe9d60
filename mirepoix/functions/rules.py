"""Food rules as column expressions: allergens, diets, food queries, options, fractions. Built-in functions only."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirepoix.functions import vocabulary as V
from mirepoix.functions.text import squeezed


def any_of(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def keyword_pattern(words: Iterable[str]) -> str:
    """A regular expression of the words as whole words, blanks of any width, with -s or -es."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")(?:e?s)?(?:$|[^\p{L}\p{N}_])"


def plant_dairy(name: Column) -> Column:
    """Whether a name that may hold milk, cream or butter is of no milk product."""
    return squeezed(F.lower(name)).rlike(any_of(V.PLANT_DAIRY))


def gluten_safe(name: Column) -> Column:
    """Whether a name that may hold wheat or flour is of no gluten."""
    return squeezed(F.lower(name)).rlike(any_of(V.GLUTEN_SAFE))


def has_allergen(name: Column, allergen: str) -> Column:
    """Whether a name tells of the allergen by a keyword and isn't guarded as an alternative."""
    found = F.lower(name).rlike(keyword_pattern(V.ALLERGENS[allergen]))
    if allergen == "milk":
        return found & ~plant_dairy(name)
    return found & ~gluten_safe(name) if allergen in ("gluten", "wheat") else found


def allergens(name: Column) -> Column:
    """All allergens of a name, sorted."""
    return F.array_compact(F.array(*(F.when(has_allergen(name, a), a) for a in sorted(V.ALLERGENS))))


def diet_tags(found: Column) -> Column:
    """The diets that a set of allergens leaves open, in a fixed order."""
    free = lambda *names: ~F.arrays_overlap(found, F.array(*map(F.lit, names)))
    tags = {"dairy_free": free("milk"), "nut_free": free("peanut", "tree_nut"), "gluten_free": free("gluten", "wheat"), "pescatarian_safe": free("fish", "crustacean_shellfish", "molluscs")}
    return F.array_compact(F.array(*(F.when(open_, tag) for tag, open_ in tags.items())))


def canonical_diet(tag: Column) -> Column:
    """The diet that a spelling names; null for those without a rule."""
    name = F.replace(F.lower(F.trim(tag)), F.lit(" "), F.lit("_"))
    known = F.coalesce(F.create_map(*(F.lit(x) for kv in V.DIET_ALIASES.items() for x in kv))[name], name)
    return F.when(known.isin(list(V.DIETS)), known)


def number_forms(word: str) -> list[str]:
    """A phrase with the plural and the singular of its last word, as far as its ending tells them."""
    head, _, last = word.rpartition(" ")
    forms = [last]
    if last.endswith(("s", "x", "z", "ch", "sh")):
        forms.append(last + "es")
    elif last.endswith("y") and last[-2:-1] not in "aeiou":
        forms.append(last[:-1] + "ies")
    else:
        forms.append(last[:-1] + "ves" if last.endswith("f") else last + "s")
    if len(last) > 4 and last.endswith(("ies", "ves")):
        forms.append(last[:-3] + ("y" if last.endswith("ies") else "f"))
    elif len(last) > 3 and last.endswith("es") and last[-3] in "sxz":
        forms.append(last[:-2])
    elif len(last) > 3 and last.endswith("s") and not last.endswith("ss"):
        forms.append(last[:-1])
    return list(dict.fromkeys(f"{head} {f}".strip() for f in forms))


def phrase_pattern(diet: str) -> str:
    """A regular expression of the phrases that contradict a diet, in both numbers, over tokens joined by single blanks."""
    forms = dict.fromkeys(f for w in V.DIETS[diet] for f in number_forms(w))
    return "(?:^| )(?:" + "|".join(forms) + ")(?: |$)"


def tokens(text: Column) -> Column:
    """Lower-cased letters and digits of a text as tokens joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def contradicts(text: Column, diet: str) -> Column:
    return tokens(text).rlike(phrase_pattern(diet))


def first_contradiction(text: Column, diet: str) -> Column:
    """The first of a diet's fragments that stands anywhere in a text; null if none does."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(w), w) for w in V.DIETS[diet]))


def exclusion_fragments(allergen: str) -> list[str]:
    """What a name must not hold to keep an allergen out: its words and its listed terms."""
    word = allergen.replace("_", " ").strip()
    parts = {word, *(p for p in word.split() if len(p) >= 3)}
    return sorted(parts.union(*(V.ALLERGEN_TERMS.get(k, []) for k in (allergen, allergen.rstrip("s"), word))))


def excluded_by(names: Column, declared: Column, allergen: str) -> Column:
    """Whether an allergen is declared or any of the names holds one of its fragments."""
    fragments = exclusion_fragments(allergen)
    holds = lambda n: reduce(lambda a, b: a | b, (F.lower(n).contains(f) for f in fragments))
    return F.array_contains(declared, allergen) | F.exists(names, holds)


def clean_query(name: Column) -> Column:
    """A food name without brackets, preparation words, odd characters and a quantity in front."""
    s = F.regexp_replace(F.lower(name), r"\([^)]*\)", " ")
    s = F.regexp_replace(F.replace(s, F.lit(","), F.lit(" ")), V.QUERY_NOISE, " ")
    s = F.ltrim(F.regexp_replace(s, r"[^a-z0-9\s'/-]", " "))
    s = F.regexp_replace(F.regexp_replace(s, V.LEADING_QUANTITY, " "), r"\s+", " ")
    return F.btrim(s, F.lit(" -'/"))


def query_singular(word: Column) -> Column:
    """The singular by the rules of food queries."""
    n = F.length(word)
    return (
        F.when(n <= 3, word)
        .when(word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y")))
        .when(word.rlike("(ses|xes|zes|ches|shes|oes)$"), F.left(word, n - 2))
        .when(word.endswith("ves"), F.concat(F.left(word, n - 3), F.lit("f")))
        .when(word.endswith("s") & ~word.rlike("(ss|us|is|as|os)$"), F.left(word, n - 1))
        .otherwise(word)
    )


def query_tokens(text: Column) -> Column:
    """A food query's words in the singular, without stop words and single letters, each followed by its synonym."""
    of = F.create_map(*(F.lit(x) for kv in V.SYNONYMS.items() for x in kv))
    raw = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)
    kept = F.filter(F.transform(raw, lambda w: F.struct(w.alias("raw"), query_singular(w).alias("t"))), lambda x: ~x["t"].isin(V.QUERY_STOP) & (F.length(x["t"]) > 1))

    def with_synonym(x: Column) -> Column:
        s = F.coalesce(of[x["raw"]], of[x["t"]])
        return F.when(s.isNotNull() & (s != x["t"]), F.array(x["t"], s)).otherwise(F.array(x["t"]))

    return F.flatten(F.transform(kept, with_synonym))


def option_evidence(text: Column) -> Column:
    """Where a text tells of a gluten-free option: the first pattern's first match with 80 characters to either side; null if none."""
    plain = squeezed(text)

    def found(pattern: str) -> Column:
        match, at = F.regexp_substr(plain, F.lit(f"(?i){pattern}")), F.regexp_instr(plain, F.lit(f"(?i){pattern}"))
        start = F.greatest(F.lit(1), at - 80)
        return F.when(match.isNotNull(), F.substring(plain, start, at - start + F.length(match) + 80))

    return F.coalesce(*(found(p) for p in V.GLUTEN_FREE_OPTION))


def repaired_fraction(measurement: Column) -> Column:
    """A fraction that lost its slash, before a unit where the number as it stands is no likely amount: "34 cup" is 3/4 cup.

    Volumes may have halves, thirds, quarters and eighths, masses halves and quarters; a whole number may stand before, and
    in a range either end may have lost its slash.
    """
    s = measurement
    for den, unit in (("[2348]", "cups?|tbsp|tablespoons?|tsp|teaspoons?"), ("[24]", "lbs?|pounds?")):
        end = rf"(?=\s+(?i:{unit})\b)"
        s = F.regexp_replace(s, rf"^\s*(\d)({den})\s*-\s*(\d)({den}){end}", "$1/$2-$3/$4")
        s = F.regexp_replace(s, rf"^\s*(\d)({den})\s*-\s*(\d+){end}", "$1/$2-$3")
        s = F.regexp_replace(s, rf"^\s*(\d+)\s+(\d)({den}){end}", "$1 $2/$3")
        s = F.regexp_replace(s, rf"^\s*(\d)({den}){end}", "$1/$2")
    return s


def rank_words(question: Column) -> Column:
    """A question's words that tell of a dish, for ranking; the question itself if it has none."""
    kept = F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0)), lambda w: ~w.isin(V.RANK_STOP))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(question)


def name_variants(name: Column) -> Column:
    """The forms under which a food's class is looked up, the plainest last: as it is, cleaned, without words of form, both with synonyms and singulars.

    Empty and repeated forms are left out; a null name has none.
    """
    raw, cleaned = F.trim(F.lower(name)), clean_query(name)
    core = F.btrim(squeezed(F.regexp_replace(cleaned, V.FORM_WORDS, " ")), F.lit(" -'/"))
    of = F.create_map(*(F.lit(x) for kv in V.SYNONYMS.items() for x in kv))
    plain = lambda text: F.array_join(F.transform(F.split(text, " "), lambda w: F.transform(F.array(query_singular(w)), lambda t: F.coalesce(of[t], t))[0]), " ")
    forms = F.transform(F.array(F.struct(cleaned.alias("cleaned"), core.alias("core"))), lambda f: F.array(raw, f["cleaned"], f["core"], plain(f["cleaned"]), plain(f["core"])))[0]
    return F.array_distinct(F.filter(F.transform(forms, F.trim), lambda v: v != ""))
