"""Grams of one unit of an ingredient, as data: a rule for each unit and group of words, the first that fits counts. Fixed values."""

from __future__ import annotations

from typing import NamedTuple

LEAFY_GREENS = "spinach kale chard collard collards greens"
SOFT_HERBS = "parsley cilantro coriander"
SPRIG_HERBS = "basil cilantro coriander dill mint oregano parsley rosemary sage tarragon thyme"
SEASONINGS = "basil oregano thyme rosemary cumin paprika cinnamon nutmeg turmeric coriander parsley sage mint peppercorn peppercorns spice spices seasoning sazon"
POULTRY = "duck chicken turkey goose hen pheasant quail partridge squab"
FISH = "fish salmon tuna cod trout halibut anchovy crab clam clams shrimp prawn lobster scallop octopus"
HARD_CHEESES = "cheddar mozzarella parmesan swiss feta colby jack monterey gouda provolone"
SOFT_CHEESES = ("cream cheese", "cottage cheese", "ricotta cheese")
SIZES = {"small": 0.65, "medium": 1.0, "large": 1.35}
SINGLE = "whole piece small medium large apple banana lemon lime orange carrot onion potato pepper zucchini squash avocado tomato peach shallot jalapeno chile"
PINCH_NOT = "scallion scallions green onion onions spring shallot shallots garlic chive chives leek leeks"
PACKAGES = "bag box can container jar package packet"
PINCH_G, TO_TASTE_G, BARE_GRAMS = 0.3, 0.5, 50.0
WATER_LIKE, NOT_LIQUID = "water stock broth", "powder granule granules cube cubes dry"
DENSITY = {"oil": 0.92, "milk": 1.03, "cream": 0.99, "honey": 1.42, "syrup": 1.37, "vinegar": 1.01, "sauce": 1.19, "juice": 1.04, "wine": 0.99}
MASS_G = {"g": 1.0, "gram": 1.0, "kg": 1000.0, "kilogram": 1000.0, "mg": 0.001, "milligram": 0.001, "oz": 28.349523125, "ounce": 28.349523125, "lb": 453.59237, "pound": 453.59237}
VOLUME_ML = {"ml": 1.0, "milliliter": 1.0, "millilitre": 1.0, "l": 1000.0, "liter": 1000.0, "litre": 1000.0, "teaspoon": 5.0, "tsp": 5.0, "tablespoon": 15.0, "tbsp": 15.0, "cup": 240.0, "dash": 0.5, "splash": 15.0}
COUNTED = """clove sprig leaf stalk stick slice piece whole head fillet chop bun bagel bunch bag box can container jar package
packet egg sheet shell cube bulb breast prawn muffin envelope block cake punnet avocado tomato peach apple banana onion
shallot carrot potato jalapeno chile pepper zucchini squash lemon lime orange celery sausage pinch""".split()
UNIT_NAMES = {"c": "cup", "lbs": "lb", "filet": "fillet", "white": "egg_white", "yolk": "egg_yolk"}


class Rule(NamedTuple):
    """One of the words of each group, none of the phrases; `sized`: grams of a medium one, by the unit's or a stated size."""

    units: str
    words: tuple[str, ...]
    grams: float
    label: str
    sized: str = ""
    phrases: tuple[str, ...] = ()
    not_phrases: tuple[str, ...] = ()


RULES = [
    Rule("stick", ("butter",), 113.0, "butter stick"),
    Rule("egg", ("egg eggs", "white whites"), 33.0, "large egg white"),
    Rule("egg", ("egg eggs", "yolk yolks"), 18.0, "large egg yolk"),
    Rule("egg", ("egg eggs",), 50.0, "large egg"),
    Rule("egg_white", ("egg white whites",), 33.0, "large egg white"),
    Rule("egg_yolk", ("egg yolk yolks",), 18.0, "large egg yolk"),
    Rule("pinch", ("pepper peppercorn peppercorns",), PINCH_G, "pinch"),
    Rule("packet", ("gelatin jello jell",), 7.0, "gelatin packet"),
    Rule("envelope", (SEASONINGS,), 5.0, "seasoning envelope"),
    Rule("bag packet", ("tea",), 2.0, "tea bag"),
    Rule("cake", ("yeast",), 18.0, "compressed yeast cake"),
    Rule("cup", ("ice cube cubes",), 140.0, "ice cubes cup"),
    Rule("whole piece", ("cube", "ice"), 22.0, "ice cube"),
    Rule("leaf", (SPRIG_HERBS + " bay",), 0.5, "herb leaf"),
    Rule("bunch", ("scallion scallions",), 100.0, "scallion/green onion bunch"),
    Rule("bunch", ("green",), 100.0, "scallion/green onion bunch", phrases=("green onion",)),
    Rule("whole piece", ("scallion scallions",), 15.0, "scallion/green onion"),
    Rule("whole piece", ("green",), 15.0, "scallion/green onion", phrases=("green onion",)),
    Rule("bunch", (LEAFY_GREENS,), 250.0, "leafy green bunch"),
    Rule("bunch", (SOFT_HERBS,), 60.0, "soft herb bunch"),
    Rule("bunch", (SPRIG_HERBS,), 30.0, "herb bunch"),
    Rule("sprig", (SPRIG_HERBS,), 1.0, "herb sprig"),
    Rule("whole egg", ("egg",), 50.0, "large egg"),
    Rule(SINGLE, ("apple",), 182.0, "apple", "unit"),
    Rule(SINGLE, ("banana",), 118.0, "banana", "unit"),
    Rule(SINGLE, ("lemon",), 58.0, "lemon", "unit"),
    Rule(SINGLE, ("lime",), 67.0, "lime", "unit"),
    Rule(SINGLE, ("orange",), 131.0, "orange", "unit"),
    Rule(SINGLE, ("carrot", "baby"), 12.0, "baby carrot", "unit"),
    Rule(SINGLE, ("carrot",), 61.0, "carrot", "unit"),
    Rule(SINGLE, ("onion", "spring green scallion scallions"), 15.0, "spring/green onion", "unit"),
    Rule(SINGLE, ("onion", "pearl baby pickling silverskin"), 10.0, "pearl onion", "unit"),
    Rule(SINGLE, ("onion",), 110.0, "onion", "unit"),
    Rule(SINGLE, ("potato", "baby new"), 25.0, "baby/new potato", "unit"),
    Rule(SINGLE, ("potato",), 173.0, "potato", "unit"),
    Rule(SINGLE, ("avocado",), 150.0, "avocado", "unit"),
    Rule(SINGLE, ("tomato", "cherry grape"), 17.0, "cherry/grape tomato", "unit"),
    Rule(SINGLE, ("tomato", "plum roma"), 62.0, "plum tomato", "unit"),
    Rule(SINGLE, ("tomato",), 123.0, "tomato", "unit"),
    Rule(SINGLE, ("peach",), 150.0, "peach", "unit"),
    Rule(SINGLE, ("shallot",), 25.0, "shallot", "unit"),
    Rule(SINGLE, ("jalapeno chile chilli chili",), 14.0, "jalapeno chile", "unit"),
    Rule(SINGLE, ("zucchini squash",), 196.0, "summer squash", "unit"),
    Rule(SINGLE, ("pepper",), 120.0, "bell pepper", "unit"),
    Rule("cube", ("watermelon",), 8.0, "2cm watermelon cube"),
    Rule("cube", ("honeydew melon",), 8.0, "2cm melon cube"),
    Rule("sheet", ("nori",), 2.5, "nori sheet"),
    Rule("stalk", ("celery",), 40.0, "celery stalk"),
    Rule("stalk", ("broccoli",), 151.0, "broccoli stalk"),
    Rule("bulb", ("fennel",), 234.0, "fennel bulb", "stated"),
    Rule("head", ("cauliflower",), 575.0, "cauliflower head", "stated"),
    Rule("head", ("broccoli",), 608.0, "broccoli head", "stated"),
    Rule("breast", (POULTRY,), 174.0, "boneless chicken breast"),
    Rule("fillet", (FISH,), 120.0, "fish fillet"),
    Rule("prawn", ("prawn shrimp",), 20.0, "large prawn"),
    Rule("chop", ("lamb pork",), 113.0, "meat chop"),
    Rule("sausage", ("sausage",), 75.0, "sausage link"),
    Rule("bun", ("bun buns burger",), 60.0, "burger bun"),
    Rule("bagel", ("bagel",), 95.0, "bagel"),
    Rule("muffin", ("english",), 57.0, "english muffin"),
    Rule("package", ("gelatin",), 85.0, "gelatin dessert package"),
    Rule("package", ("cream",), 226.0, "cream cheese package", phrases=("cream cheese",)),
    Rule("packet", ("yeast",), 7.0, "yeast packet"),
    Rule("sheet", ("lasagna",), 21.0, "lasagna sheet"),
    Rule("can", ("tomato",), 411.0, "standard tomato can"),
    Rule("can", ("bean beans",), 425.0, "standard bean can"),
    Rule("jar", ("sauce salsa",), 454.0, "standard sauce jar"),
    Rule("whole piece shell", ("pizza", "shell"), 142.0, "thin pizza shell"),
    Rule("slice", ("cheese",), 20.0, "cheese slice"),
    Rule("cup", ("cheese", HARD_CHEESES), 113.0, "shredded hard cheese cup", not_phrases=SOFT_CHEESES),
    Rule("tablespoon", ("cheese", HARD_CHEESES), 7.0, "shredded hard cheese tablespoon", not_phrases=SOFT_CHEESES),
]

#: Portions whose grams are of what is made of them, and other names of units in portions.
AMBIGUOUS = ("dry yields", "amount to make", "guideline amount per", "prepared", "recipe", "yield")
PORTION_UNITS = {
    "tb": "tablespoon", "tbl": "tablespoon", "tbsp": "tablespoon", "tbsps": "tablespoon", "tablespoons": "tablespoon",
    "t": "teaspoon", "tsp": "teaspoon", "teaspoons": "teaspoon", "ounces": "ounce", "ozs": "ounce", "oz": "ounce",
    "fl oz": "fluid ounce", "fluid ounces": "fluid ounce", "cups": "cup", "c": "cup", "lbs": "pound", "lb": "pound", "pounds": "pound",
}
