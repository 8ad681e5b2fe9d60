"""Rules that clean names and measurements: equipment, generic names of brands, measurement forms, plausible weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Things in ingredient lists that aren't food.
EQUIPMENT = """spatula|whisk|ladle|tongs|rolling pin|potato masher|pastry brush|basting brush|butter brush|brush|salt shaker|pepper shaker|shaker|meat thermometer|candy thermometer|probe thermometer|thermometer|skewer|skewers|toothpick|toothpicks|cocktail stick|cocktail sticks|kebab stick|parchment paper|parchment|wax paper|waxed paper|baking paper|paper towel|paper towels|kitchen towel|kitchen towels|aluminum foil|aluminium foil|tin foil|foil|plastic wrap|cling film|cling wrap|saran wrap|cheesecloth|muslin cloth|kitchen string|butcher string|butcher's string|butchers string|kitchen twine|butcher twine|butcher's twine|butchers twine|cooking twine|twine|ramekin|ramekins|baking dish|casserole dish|flameproof casserole|dutch oven|sheet pan|baking sheet|cookie sheet|loaf pan|loaf tin|cake pan|cake tin|springform pan|springform tin|muffin tin|muffin pan|pie plate|pie dish|pie pan|roasting pan|roasting tin|baking pan|frying pan|saute pan|saucepan|stockpot|griddle|grill pan|wire rack|cooling rack|baking rack|cooling grid|baking tray|box grater|cheese grater|grater|microplane|zester|fine mesh strainer|fine-mesh strainer|fine-mesh sieve|fine mesh sieve|mesh strainer|sieve|strainer|colander|mortar and pestle|pestle and mortar|mortar|pestle|piping bag|pastry bag|ziploc bag|ziploc bags|zip-top bag|zip top bag|freezer bag|sandwich bag|paper bag|brown paper bag|plastic bag|ziploc|tight fitting lid|tight-fitting lid|tight lid|lid|food processor|stand mixer|hand mixer|electric mixer|immersion blender""".split("|")
# Words that may stand beside equipment without making the line a food.
QUALIFIERS = """and the for with not use using see tip tips you your also need needs needed made from into non nonstick stick flavored flavoured flavor flavour low fat light original optional plus extra as spray coating
bamboo wooden metal stainless steel barbecue bbq kebab kabob short long large small medium mini piece pieces square squares strip strips length lengths roll full sheet sheets hole size
soaked soak presoaked pre rinsed water cold warm hot minutes minute min mins hours hour overnight prevent burning scorching reduce keep upright when freezing least more than about approx approximately wet dry patted drained rinse well first
board glass jar decorative clean tight fitting fasten tie bind turning turn cover liner liners cases case tray container containers baking stove top plate grid mix mixture grease greasing frying fry cook cooking serving serve bake preheat line lined
reynolds pam glad saran ziploc wrap cling film tin aluminium aluminum kitchen paper towel towels string twine jute probe digital presoak x cm mm ml""".split()
# The sprays, which oils and other words may precede.
SPRAY = r"(?:(?:olive|vegetable|veg|canola|rapeseed|sunflower|coconut|peanut|grapeseed|avocado|rice|bran|butter|nonstick|non[\s\-]?stick|baking|cooking|oil|light|low|fat|non|flavou?red|flavou?r|extra|virgin)[\s\-]+)*(?:cooking\s+spray\s+oil|cooking\s+oil\s+spray|cooking\s+spray|baking\s+spray|spray\s+oil|oil\s+spray|nonstick\s+spray(?:\s+coating)?|non[\s\-]?stick\s+spray(?:\s+coating)?)(?:[\s\-]+(?:oil|coating))?"
# Short forms of units.
UNIT_FORMS = {"tablespoons": "tbsp", "tablespoon": "tbsp", "teaspoons": "tsp", "teaspoon": "tsp", "kilograms": "kg", "kilogram": "kg", "millilitres": "ml", "milliliters": "ml", "millilitre": "ml", "milliliter": "ml", "grams": "g", "gram": "g", "litres": "l", "liters": "l", "litre": "l", "liter": "l", "ounces": "oz", "ounce": "oz", "pounds": "lb", "pound": "lb", "cloves": "clove"}
# Generic names that say too little.
EMPTY_GENERIC = ["", "brand", "branded product", "food", "ingredient", "product", "unknown", "seasoning mix"]
VAGUE_GENERIC = "beverage bar candy cereal cheese chip chocolate cookie cracker drink dressing filling gelatin liqueur liquor mix oil product sauce seasoning spread syrup sweetener topping".split()
NO_IDENTITY = "a an and bag can for in of or pack packet sachet the to tub with x".split()
# Whole animals, the heaviest small units in grams, and weights that are conversions of other units.
WHOLE_ANIMALS = "duck chicken turkey goose hen pheasant quail partridge squab rabbit".split()
HEAVIEST_G = {"clove": 25.0, "sprig": 15.0, "leaf": 5.0, "leaves": 5.0, "pinch": 5.0, "dash": 5.0, "teaspoon": 25.0, "tablespoon": 60.0}
_OUNCES, _POUNDS = ["oz", "ounce", "ounces", "fl oz", "fluid ounce", "fluid ounces"], ["lb", "lbs", "pound", "pounds"]
CONVERSIONS_G = {28.35: _OUNCES, 453.59: _POUNDS, 1134.59: _POUNDS, 1000.0: ["l", "liter", "liters", "litre", "litres", "kg", "kilogram", "kilograms"]}

EQUIPMENT_PATTERN = rf"{SPRAY}|\b(?:{'|'.join(sorted(EQUIPMENT, key=lambda t: (-len(t), t)))})\b"


def names_equipment(name: Column) -> Column:
    """Whether a name holds a piece of equipment or a cooking spray as whole words; a null name doesn't."""
    return F.coalesce(F.lower(name).rlike(EQUIPMENT_PATTERN), F.lit(False))


def pure_equipment(name: Column) -> Column:
    """Whether nothing but equipment and qualifiers is in a name: a word of three letters or more that is neither keeps it."""
    rest = F.regexp_extract_all(F.regexp_replace(F.lower(name), EQUIPMENT_PATTERN, " "), F.lit("[a-z]{3,}"), F.lit(0))
    return names_equipment(name) & (F.size(F.array_except(rest, F.array(*map(F.lit, QUALIFIERS)))) == 0)


def ontology_label(label: Column) -> Column:
    """An ontology's label as an ingredient name: language tag, "food product", "food" and all but letters taken out."""
    plain = F.replace(F.replace(F.replace(F.lower(label), F.lit("@en"), F.lit("")), F.lit("food product"), F.lit("")), F.lit("food"), F.lit(""))
    return F.trim(F.regexp_replace(plain, "[^a-z]+", " "))


def _plain_number(token: Column) -> Column:
    number = F.when(token.rlike(r"^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$"), token).cast("double")
    whole = F.when(number == F.floor(number), F.floor(number).cast("string"))
    return F.coalesce(whole, F.regexp_replace(F.format_string("%.6f", number), "0+$", ""))


def measurement_form(measurement: Column) -> Column:
    """A measurement in the form by which parsers are compared: lower case, short units, numbers apart and without needless zeros."""
    text = F.regexp_replace(F.replace(F.lower(F.trim(measurement)), F.lit(" of"), F.lit("")), r"\s+", " ")
    text = reduce(lambda t, form: F.regexp_replace(t, rf"\b{form[0]}\b", form[1]), UNIT_FORMS.items(), text)
    parts = F.split(F.trim(F.regexp_replace(text, "([0-9])([a-z])", "$1 $2")), " ")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^[0-9.]*[0-9][0-9.]*$") & ~x.rlike(r"\..*\."), _plain_number(x)).otherwise(x)), " ")


def generic_name(value: Column) -> Column:
    """A generic name without marks of registration, needless blanks and punctuation at its ends."""
    blank = F.regexp_replace(F.regexp_replace(F.lower(value), "[®™]", " "), r"\s+", " ")
    return F.regexp_replace(blank, r"^[ ,;:|]+|[ ,;:|]+$", "")


def identity_tokens(value: Column) -> Column:
    """The distinct words and numbers of two letters or more, possessives without their ending."""
    plain = F.replace(F.replace(F.lower(value), F.lit("’"), F.lit("'")), F.lit("'s"), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(plain, F.lit("[a-z0-9]{2,}"), F.lit(0)))


def generic_is_valid(original: Column, generic: Column, brand: Column) -> Column:
    """Whether a generic name may replace the original: not empty, unchanged, counted, vague or still with the brand."""
    name, words, brand_words = generic_name(F.coalesce(generic, F.lit(""))), identity_tokens(generic), identity_tokens(F.coalesce(brand, F.lit("")))
    singular = [name, F.regexp_replace(name, "s$", ""), F.regexp_replace(name, "ies$", "y")]
    bad = [
        name.isin(EMPTY_GENERIC), name == generic_name(F.coalesce(original, F.lit(""))), F.length(name) > 180, ~name.rlike("[a-z]"),
        name.rlike(r"^(?:[0-9]+(?:[./][0-9]+)?|[¼½¾⅓⅔⅛⅜⅝⅞])(?:\s+|$)"), *(s.isin(VAGUE_GENERIC) for s in singular),
        ~F.exists(words, lambda w: F.length(w) >= 3), (F.size(brand_words) > 0) & (F.size(F.array_except(brand_words, words)) == 0),
    ]
    return ~reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(True)) for x in bad))


def _stems(token: Column) -> Column:
    """A word with its forms without endings."""
    long = lambda n, ends, to: F.when((F.length(token) > n) & token.rlike(f"({ends})$"), to)
    less = lambda k: F.left(token, F.length(token) - k)
    forms = [token, long(4, "ies", F.concat(less(3), F.lit("y"))), long(4, "es", less(2)), long(3, "s", less(1)), long(5, "ed|er", less(2)), long(6, "ated|ular", F.left(token, F.lit(5)))]
    return F.array_compact(F.array(*forms))


def lost_tokens(original: Column, generic: Column, brand: Column) -> Column:
    """The original's words, sorted, that neither brand nor generic name has in any form: what a renaming would lose."""
    known = F.flatten(F.transform(F.concat(*(identity_tokens(F.coalesce(c, F.lit(""))) for c in (generic, brand))), _stems))
    kept = lambda w: w.isin(NO_IDENTITY) | F.arrays_overlap(_stems(w), known)
    return F.filter(F.sort_array(identity_tokens(original)), lambda w: ~kept(w))


def implausible_weight(name_words: Column, unit: Column, unit_g: Column, group: Column) -> Column:
    """Why grams for a unit (lower case, singular) can't be right, the first reason of a fixed order; null if they may be."""
    group = F.lower(F.coalesce(group, F.lit("")))
    rules = [
        (F.coalesce(unit, F.lit("")) == "", F.lit("missing_unit")),
        (unit_g <= 0, F.lit("non_positive_weight")),
        ((unit == "whole") & F.arrays_overlap(name_words, F.array(*map(F.lit, WHOLE_ANIMALS))) & (unit_g < 500), F.lit("whole_animal_too_small")),
        ((unit == "whole") & group.contains("products") & (unit_g < 25), F.lit("whole_food_too_small")),
        (unit.isin("box", "package") & (unit_g < 20), F.lit("package_too_small")),
        (unit.isin("bag", "bags") & (unit_g < 20), F.lit("bag_too_small")),
        ((unit == "bunch") & (unit_g < 5), F.lit("bunch_too_small")),
        (unit.isin("cup", "tablespoon", "teaspoon") & (unit_g > 500), F.lit("volume_unit_too_large")),
        *(((unit == u) & (unit_g > most), F.lit(f"{u}_too_heavy")) for u, most in HEAVIEST_G.items()),
        (unit_g > 5000, F.lit("implausible_per_unit_weight")),
        *(((F.abs(unit_g - g) <= max(0.5, g * 0.002)) & ~unit.isin(units), F.lit(f"suspicious_unit_conversion_default:{g}")) for g, units in CONVERSIONS_G.items()),
    ]
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
