"""Normal forms of ingredient names as column expressions: the one that lists are kept under, and that of reference links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirepoix.functions.text import once

# First words of reference names that only say the category, words that are no name, words of preparation
# before and of portions behind a name, words after which a portion stays, units of a leading quantity.
CATEGORIES = """spices|spice|sauces|sauce|vegetables|vegetable|fruits|fruit|juices|juice|oils|oil|vinegars|vinegar|syrups|syrup|babyfood
fish|beef|pork|poultry|chicken|lamb|cheese|yogurt|milk|cereals|cereal|breads|bread|snacks|soups|soup|candies|nuts|seeds|beverages
leavening agents|fast foods""".replace("\n", "|").split("|")
NOISE = """|to|and|or|of|with|for|in|by|fresh|frozen|canned|cooked|raw|dried|ground|chopped|sliced|diced|mixed|x|or canned|or frozen
or fresh|or dried|each|such as|optional|(|)|(,|,(""".replace("\n", "|").split("|")
PREPARED = """chopped sliced diced minced grated shredded crushed peeled seeded cubed halved quartered finely_chopped coarsely_chopped
thinly_sliced""".split()
PORTIONS = """clove cloves slice slices wedge wedges sprig sprigs piece pieces bulb bulbs stalk stalks ear ears head heads sheet sheets
bunch bunches strip strips""".split()
KEEP_BEFORE_PORTION = "ground whole fresh dried frozen".split()
QUANTITY_UNITS = """cups cup tablespoons tablespoon tbsp teaspoon tsp ounces ounce oz grams gram kg g pounds pound lbs lb ml liters liter l
dash pinch cans can cloves clove large medium small whole pieces piece slices slice sticks stick""".split()
MARKS = "¼½¾⅓⅔⅛⅜⅝⅞⅙⅚"
# Fixed values of the second form: words that are dropped, words that are folded.
DROPPED = "fresh ground minced chopped large small medium to taste".split()
FOLDED = {"cloves": "clove", "sprigs": "sprig", "leaves": "leaf", "stalks": "stalk", "sticks": "stick", "slices": "slice", "pieces": "piece", "bunches": "bunch"}

_S = r"[ \t\n\r\f]"
_NUMBER = rf"(?:[{MARKS}]|\d+(?:[.,/]\d+)?(?:[.,]\d+)?)"
_MULTI = "|".join(p.replace("_", " ") for p in sorted(PREPARED, key=len, reverse=True))
#: The steps before and after the choice of a part between commas: (pattern, replacement), in order.
BEFORE = [
    (rf"{_S}+X{_S}*$", ""), (rf"^{_S}+|{_S}+$", ""), (rf"{_S}*\([^)]*\)", " "),
    (rf"(?i)^{_S}*{_NUMBER}{_S}*(?:to{_S}+{_NUMBER}{_S}+)?(?:{'|'.join(QUANTITY_UNITS)})?{_S}+", ""), (rf"(?i)^(?:a|an|the){_S}+", ""),
]
AFTER = [(r"^[.,;:!?_-]+|[.,;:!?_-]+$", ""), (rf"^{_S}+|{_S}+$", ""), (rf"{_S}+", " ")]
LOWERED = [(r"^(?:a|an|the) ", ""), (rf"^(?:{_MULTI}) ", "")]
PORTION = rf"^(.+?) (?:{'|'.join(PORTIONS)})$"
LAST = [(r"^(?:(?:fresh|whole) )+", ""), (r" (?:and|or) *$", "")]
#: Endings of a plural with the least length, what is cut off and what is put there; the first that fits counts.
PLURALS = [("ies$", 5, 3, "y"), ("[^aeiou]ses$", 5, 2, ""), ("oes$", 5, 2, ""), ("(us|is|ss)$", 0, 0, ""), ("s$", 4, 1, "")]
ENDS = [(r"^[.,;:!?_-]+|[.,;:!?_-]+$", ""), (r"^[()]+|[()]+$", ""), (rf"^{_S}+|{_S}+$", "")]


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, step: F.regexp_replace(t, *step), steps, text)


def _singular(s: Column) -> Column:
    ladder = F.when(F.lit(False), s)
    for ending, least, cut, put in PLURALS:
        ladder = ladder.when(s.rlike(ending) & (F.length(s) >= least), F.concat(F.left(s, F.length(s) - cut), F.lit(put)))
    return ladder.otherwise(s)


def ingredient_name(raw: Column) -> Column:
    """The name that an ingredient of a list is kept under; null for what is none.

    Quantities, brackets and articles go; of parts between commas the first counts, with the second if the first names
    a category only; then preparation before and portions behind the name, plural, punctuation. Null: null and empty
    text, noise words, and up to four characters with a digit.
    """
    start = _replaced(raw, BEFORE)
    parts = F.filter(F.transform(F.split(start, ","), lambda p: F.regexp_replace(p, rf"^{_S}+|{_S}+$", "")), lambda p: p != "")
    joined = once(parts, lambda p: F.when((F.size(p) > 1) & F.lower(F.get(p, F.lit(0))).isin(CATEGORIES), F.concat_ws(" ", F.get(p, F.lit(0)), F.get(p, F.lit(1)))).otherwise(F.get(p, F.lit(0))))
    chosen = F.when(F.contains(start, F.lit(",")), F.coalesce(joined, start)).otherwise(start)
    lowered = _replaced(F.lower(_replaced(chosen, AFTER)), LOWERED)
    split = once(lowered, lambda s: F.struct(s.alias("s"), F.trim(F.regexp_extract(s, PORTION, 1)).alias("head")))
    without = once(split, lambda x: F.when((x["head"] != "") & ~F.substring_index(x["head"], " ", -1).isin(KEEP_BEFORE_PORTION), x["head"]).otherwise(x["s"]))
    named = once(_replaced(without, LAST), lambda s: _replaced(_singular(s), ENDS))
    return once(named, lambda s: F.when(~s.isin(NOISE) & ~(s.rlike("[0-9]") & (F.length(s) <= 4)), s))


def canonical_name(raw: Column) -> Column:
    """The name that links to reference foods are looked up by: lower case, letters, digits, "_", "-", without words of state, portions singular."""
    clean = F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}_\s-]", "")
    words = F.filter(F.split(clean, r"\s+"), lambda w: (w != "") & ~w.isin(DROPPED))
    folded = F.create_map(*(F.lit(x) for kv in FOLDED.items() for x in kv))
    return F.array_join(F.transform(words, lambda w: F.coalesce(folded[w], w)), " ")
