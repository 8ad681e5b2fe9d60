"""Text expressions: normal forms, tokens, singulars, heads, quantities, durations. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a title stops naming the dish, words that qualify one, irregular plurals, and heads that are no meal.
TAIL = r"\s+(?:with|on|served|topped|and served|in|drizzled)\s+"
QUALIFIERS = """gluten free dairy sugar low fat light easy quick simple best homemade classic traditional perfect ultimate
healthy quickest easiest warm cold hot fresh raw baked roasted grilled fried toasted steamed poached slow oven pan
chargrilled griddled spiced spicy mini little big giant super creamy crispy crunchy nutty savory savoury sweet my our the
a an of for style inspired very extra new old real proper mix bowl plate platter dish recipe medley selection pot tray
bake pieces slices wedges verde rojo roja picante fresca fresco blanco blanca""".split()
IRREGULAR = {"leaves": "leaf", "loaves": "loaf", "halves": "half", "potatoes": "potato", "tomatoes": "tomato", "mangoes": "mango", "children": "child", "geese": "goose"}
NON_MEALS = """spice seasoning rub marinade brine glaze sauce gravy dressing vinaigrette mayonnaise ketchup pesto salsa dip
spread paste puree pickle chutney relish jam jelly marmalade curd stock syrup icing frosting sprinkle garnish butter powder
extract essence vinegar oil crouton breadcrumb""".split()
FRACTIONS = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "dozen": 12, "half": 0.5}


def words(text: Column) -> Column:
    """The runs of a-z and 0-9 in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower case, hyphens as spaces, white space as one underscore; null for what is left empty."""
    return F.nullif(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "-", " ")), r"\s+", "_"), F.lit(""))


def slugs(values: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(values, slug)))


def singular_head(word: Column) -> Column:
    """The singular by the rules for dish heads: irregulars, -ies, -es after s x z h, -s but not -ss."""
    n = F.length(word)
    irregular = F.create_map(*(F.lit(x) for kv in IRREGULAR.items() for x in kv))[word]
    ladder = F.when((n > 3) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y")))
    ladder = ladder.when((n > 3) & word.rlike("[sxzh]es$"), F.left(word, n - 2)).when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1))
    return F.coalesce(irregular, ladder.otherwise(word))


def singular_plain(word: Column) -> Column:
    """The singular by the short rules of name matching: -ies, -oes, then -s but not -ss, -us or -is."""
    n = F.length(word)
    return F.when((n > 4) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y"))).when((n > 4) & word.endswith("oes"), F.left(word, n - 2)).when((n > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$"), F.left(word, n - 1)).otherwise(word)


def number_variants(phrase: Column) -> Column:
    """The phrase and the singular or plural of its last word."""
    last = F.substring_index(phrase, " ", -1)
    stem = F.left(phrase, F.length(phrase) - F.length(last))
    plural = F.when(last.rlike("[^aeiou]y$"), F.concat(F.left(last, F.length(last) - 1), F.lit("ies"))).when(last.rlike("(s|x|z|ch|sh)$"), F.concat(last, F.lit("es"))).otherwise(F.concat(last, F.lit("s")))
    return F.array_distinct(F.array(phrase, F.concat(stem, singular_plain(last)), F.concat(stem, plural)))


def dish_family(title: Column) -> Column:
    """The head noun of a title: its last word before the tail that isn't a qualifier, singular; the last word if all are."""
    head = F.split(F.lower(title), TAIL, 2)[0]
    all_words = F.regexp_extract_all(head, F.lit("[a-z]+"), F.lit(0))
    kept = F.filter(all_words, lambda w: ~w.isin(QUALIFIERS))
    return F.coalesce(singular_head(F.coalesce(F.try_element_at(kept, F.lit(-1)), F.try_element_at(all_words, F.lit(-1)))), F.lit(""))


def is_meal(title: Column) -> Column:
    return ~dish_family(title).isin(NON_MEALS)


def phrase_in(tokens: Column, phrase: str) -> Column:
    """Whether the phrase's words stand next to each other in the tokens."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {phrase} ")


def keyword(text: Column, words_: Iterable[str]) -> Column:
    """Whether one of the words stands in the text as a word, also with -s or -es."""
    return F.lower(text).rlike(f"(^|[^a-z0-9])({'|'.join(words_)})(e?s)?([^a-z0-9]|$)")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def overlap_f1(a: Column, b: Column) -> Column:
    """2pr / (p + r) of two token sets; 0 where they share nothing."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(2.0 * F.size(F.array_intersect(a, b)) / F.nullif(F.size(a) + F.size(b), F.lit(0)), F.lit(0.0))


def fuzzy_equal(a: Column, b: Column) -> Column:
    """Equal up to the edit distance that a's length allows: none to two letters, one to five, else two."""
    allowed = F.when(F.length(a) <= 2, 0).when(F.length(a) <= 5, 1).otherwise(2)
    return F.levenshtein(a, b) <= allowed


def plain_fractions(text: Column) -> Column:
    """Fraction characters as digits, a space before them after a digit."""
    for mark, plain in FRACTIONS.items():
        text = F.regexp_replace(text, f"([0-9]){mark}", f"$1 {plain}")
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def quantity(text: Column) -> Column:
    """The number at the start of a measurement: mixed, fraction, range (its mean), decimal, or a number word; else null."""
    t = F.lower(F.trim(plain_fractions(text)))
    part = lambda rx, i: F.nullif(F.regexp_extract(t, rx, i), F.lit("")).cast("double")
    mixed, fraction, span, plain = r"^(\d+)\s+(\d+)/(\d+)", r"^(\d+)/(\d+)", r"^(\d+(?:\.\d+)?)\s*(?:-|–|to)\s*(\d+(?:\.\d+)?)", r"^(\d+(?:\.\d+)?)"
    word = F.create_map(*(F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, float(v))))[F.regexp_extract(t, "^([a-z]+)", 1)]
    return F.coalesce(
        part(mixed, 1) + F.try_divide(part(mixed, 2), part(mixed, 3)),
        F.try_divide(part(fraction, 1), part(fraction, 2)),
        (part(span, 1) + part(span, 2)) / 2,
        part(plain, 1),
        word,
    )


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def mean_of_integers(text: Column) -> Column:
    """The mean of all integers in a text ("4-6" gives 5); null if there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("double"))
    return F.try_divide(F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x), F.size(found))


def minutes(text: Column) -> Column:
    """Hours and minutes in words or ISO form as minutes; a bare number is minutes; null without a number."""
    t = F.lower(text)
    part = lambda rx: F.nullif(F.regexp_extract(t, rx, 1), F.lit("")).try_cast("double")
    hours, mins = part(r"(\d+(?:\.\d+)?)\s*h"), part(r"(\d+(?:\.\d+)?)\s*m")
    return F.when(hours.isNotNull() | mins.isNotNull(), F.coalesce(hours, F.lit(0.0)) * 60 + F.coalesce(mins, F.lit(0.0))).otherwise(part(r"^\s*(\d+(?:\.\d+)?)\s*$"))


def coerced_number(text: Column) -> Column:
    """A number in a food table: traces and marks of absence are null, decimal commas and "<" are read."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin("tr", "n", "traces", "trace", "-", "nd", ""), F.replace(F.regexp_replace(t, "^<\\s*", ""), F.lit(","), F.lit(".")).try_cast("double"))


def normal_url(url: Column) -> Column:
    """Lower case without scheme, www., query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://(www\.)?", ""), r"[?#].*$", ""), "/+$", "")


def digest(values: Column) -> Column:
    """SHA-256 of a list of strings regardless of order, case, blanks around and repeats."""
    clean = F.sort_array(F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v != "")))
    return F.sha2(F.array_join(clean, "|"), 256)


def title_form(text: Column) -> Column:
    """Lower case, Latin accents dropped, all but letters and digits as single spaces."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"
    return squeezed(F.regexp_replace(F.translate(F.lower(text), accents, plain), "[^a-z0-9]+", " "))


def mixed_fraction(value: Column, tolerance: float = 0.02) -> Column:
    """A decimal amount as cooks write it: whole part and the nearest common fraction within tolerance; else two decimals."""
    whole = F.floor(value)
    rest = value - whole
    ladder = F.when(rest < tolerance, "").when(rest > 1 - tolerance, "+")
    for share, name in ((1 / 8, "1/8"), (1 / 4, "1/4"), (1 / 3, "1/3"), (1 / 2, "1/2"), (2 / 3, "2/3"), (3 / 4, "3/4")):
        ladder = ladder.when(F.abs(rest - share) < tolerance, name)
    number = whole.cast("string")
    return F.when(ladder == "", number).when(ladder == "+", (whole + 1).cast("string")).when(ladder.isNotNull() & (whole > 0), F.concat_ws(" ", number, ladder)).otherwise(F.coalesce(ladder, F.format_string("%.2f", value)))
