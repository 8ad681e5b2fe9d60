"""Word lists and patterns of the food rules: fixed values, as the rules have them."""

# Keywords of each declared allergen.
ALLERGENS = {
    "milk": "milk, cheese, butter, cream, yogurt, whey, casein, lactose, ghee, curd, kefir",
    "egg": "egg, egg white, egg yolk, omelet, mayonnaise, aioli, meringue, albumen",
    "peanut": "peanut, peanut butter, groundnut, arachis, satay, sate, saté",
    "tree_nut": "almond, walnut, pecan, cashew, pistachio, hazelnut, macadamia, brazil nut, pine nut",
    "wheat": "wheat, whole wheat, durum, semolina, spelt, farro, flour, bread, pasta, noodle",
    "soy": "soy, soya, soybean, tofu, miso, tempeh, edamame",
    "fish": "fish, cod, bass, tuna, salmon, tilapia, halibut, trout, sardine, anchovy",
    "crustacean_shellfish": "crab, lobster, shrimp, prawn, crawfish, crayfish, crustacean, langostino",
    "sesame": "sesame, tahini, sesame oil, sesame seed",
    "gluten": "gluten, wheat, barley, rye, malt, brewer",
    "celery": "celery, celeriac, celery seed, celery salt",
    "mustard": "mustard, mustard seed, mustard powder, mustard flour",
    "sulphites": "sulphite, sulphites, sulfite, sulfites, sulphur dioxide, sulfur dioxide, metabisulphite, metabisulfite, bisulphite, bisulfite, "
    "sodium sulphite, sodium sulfite, potassium sulphite, potassium sulfite, e220, e221, e222, e223, e224, e225, e226, e227, e228",
    "lupin": "lupin, lupine, lupin bean, lupini, lupin flour",
    "molluscs": "mollusc, mollusk, clam, mussel, oyster, scallop, squid, octopus, cuttlefish, whelk, cockle, abalone, snail",
}
ALLERGENS = {allergen: words.split(", ") for allergen, words in ALLERGENS.items()}

# Names that look like milk products, or like wheat, and are none.
PLANT_DAIRY = [
    r"\b(?:coconut|soy|soya|almond|oat|rice|cashew|hazelnut|hemp|pea)(?:[\s-]+(?:flavoured|flavored))?[\s-]+(?:milk|cream|yogurt|yoghurt)\b",
    r"\b(?:milk|cream|yogurt|yoghurt)[\s-]+alternative\b",
    r"\bnon[\s-]*dairy\b",
    r"\bdairy[\s-]*free\b",
    r"\bplant[\s-]*based\b",
    r"\bvegan\b",
    r"\b(?:peanut|almond|cashew|hazelnut|walnut|seed|nut)[\s-]+butter\b",
    r"\bbutter[\s-]*beans?\b",
    r"\bbeans?,[\s-]*butter\b",
    r"\bbutternut\b",
    r"\bcream[\s-]+substitute\b",
    r"^(?:powdered butter|cream rice|cream parsley|milk rice|coconut paste milk|butter almond|oil cocoa butter|butter paper)$",
    r"^cream sherry$",
]
GLUTEN_SAFE = [
    r"\bgluten[\s-]*free\b",
    r"^gluten[\s-]+(?:baking flour|self raising flour|flour|soy sauce|bread|pasta|flour almond coconut|flour mix|bread mix)$",
    r"\bbuckwheat\b",
    r"\b(?:rice|tapioca|potato|almond|coconut|besan|chickpea|corn|maize|quinoa|cassava|arrowroot)[\s-]+flour\b",
    r"\b(?:rice|pulse|chickpea|corn|maize|quinoa)[\s-]+(?:noodles?|pasta|spaghetti)\b",
    r"\btamari\b",
    r"^(?:ground|minced|fresh|crystallized|crystallised|pickled|glace)?[\s-]*ginger$",
    r"\b(?:wine|vinegar|vinaigrette)\b",
]

# What contradicts a diet in a name or title.
_MEAT = """chicken, beef, pork, lamb, veal, bacon, ham, sausage, salami, prosciutto, chorizo, turkey, duck, venison, rasher, steak, mince, brisket,
sirloin, rump, cutlet, meatball, pancetta, pepperoni, pastrami, liver, kidney, poultry, gammon, burger patty"""
_SEA = "fish, salmon, tuna, cod, haddock, anchovy, sardine, mackerel, prawn, shrimp, crab, lobster, mussel, oyster, clam, scallop, squid, calamari"
_DAIRY = "milk, cheese, cream, butter, yoghurt, yogurt, ghee, custard, mozzarella, parmesan, ricotta, feta, mascarpone, halloumi, paneer"
_ANIMAL = "gelatine, gelatin, lard, suet, worcestershire"
DIETS = {
    "vegan": ", ".join([_MEAT, _SEA, "egg", _DAIRY, "honey", _ANIMAL]),
    "vegetarian": ", ".join([_MEAT, _SEA, _ANIMAL]),
    "pescatarian": ", ".join([_MEAT, "lard, suet"]),
    "dairy_free": _DAIRY,
    "nut_free": "almond, cashew, walnut, pecan, hazelnut, pistachio, macadamia, praline, marzipan, peanut",
    "gluten_free": "wheat, barley, rye, flour, breadcrumb, semolina, couscous, pastry",
}
DIETS = {diet: words.replace("\n", " ").split(", ") for diet, words in DIETS.items()}
DIET_ALIASES = {
    "dairyfree": "dairy_free", "dairy-free": "dairy_free", "nutfree": "nut_free", "nut-free": "nut_free", "glutenfree": "gluten_free", "gluten-free": "gluten_free",
    "vegetarian_or_vegan": "vegetarian", "pescatarian_safe": "pescatarian", "vegans": "vegan", "vegetarians": "vegetarian",
}
# What to look for in names where an allergen is to be kept out.
ALLERGEN_TERMS = {
    "milk": "milk, cheese, cream, butter, yoghurt, yogurt, ghee, custard, mozzarella, parmesan, ricotta, feta, mascarpone",
    "dairy": "milk, cheese, cream, butter, yoghurt, yogurt, ghee, custard, mozzarella, parmesan, ricotta, feta, mascarpone",
    "egg": "egg, mayonnaise, meringue, aioli",
    "peanut": "peanut, groundnut, satay",
    "tree_nut": "almond, cashew, walnut, pecan, hazelnut, pistachio, macadamia, brazil nut, praline, marzipan, pine nut, nut",
    "nut": "almond, cashew, walnut, pecan, hazelnut, pistachio, macadamia, brazil nut, praline, marzipan, pine nut, peanut, groundnut, satay, nut",
    "wheat": "wheat, flour, bread, pasta, couscous, semolina, breadcrumb, pastry",
    "gluten": "wheat, barley, rye, flour, bread, pasta, couscous, semolina, breadcrumb, pastry",
    "soy": "soy, soya, tofu, edamame, miso, tempeh",
    "fish": "fish, anchovy, salmon, tuna, cod, haddock, sardine, mackerel",
    "shellfish": "prawn, shrimp, crab, lobster, mussel, oyster, clam, scallop, squid, calamari",
    "sesame": "sesame, tahini",
}
ALLERGEN_TERMS = {allergen: words.split(", ") for allergen, words in ALLERGEN_TERMS.items()}

# What a food query drops, its stop words and its spellings.
QUERY_NOISE = r"""\b(?:ripe|chopped|minced|diced|sliced|grated|shredded|peeled|trimmed|drained|rinsed|melted|softened|thawed|optional|divided|finely|roughly|coarsely|thinly|freshly|large|small|medium|jumbo|organic|prepared|homemade|store[- ]?bought|good[- ]?quality|best[- ]?quality|to taste|to serve|to garnish|to drizzle|to finish|to brush|to grease|for serving|for garnish|for dusting|for sprinkling|for frying|for greasing|plus more|plus extra|or more|as needed|of your choice|approximately|about|halved|quartered|cubed|julienned)\b"""
LEADING_QUANTITY = r"^(?:\s*\d+(?:[.\-/]\d+)*\s*(?:%|cups?|tbsps?|tsps?|tablespoons?|teaspoons?|oz|ounces?|lbs?|pounds?|g|grams?|kg|ml|l|cans?|packages?|sticks?|cloves?)?\b)+"
QUERY_STOP = """and or with of the in a an fresh whole large small medium cup cups tbsp tsp tablespoon teaspoon style type kind prepared made from
to as for fl oz ready""".split()
SYNONYMS = {
    "yoghurt": "yogurt", "yoghourt": "yogurt", "flavour": "flavor", "flavoured": "flavored", "colour": "color", "fibre": "fiber", "litre": "liter", "grey": "gray",
    "rocket": "arugula", "courgette": "zucchini", "courgettes": "zucchini", "aubergine": "eggplant", "aubergines": "eggplant", "capsicum": "pepper",
    "capsicums": "pepper", "coriander": "cilantro", "prawn": "shrimp", "prawns": "shrimp", "mangetout": "snowpea", "swede": "rutabaga", "kumara": "sweetpotato",
    "passata": "tomato", "sultana": "raisin", "sultanas": "raisin",
}

# A gluten-free option told in a text, first pattern first.
_GF = "gluten[ -]?free"
GLUTEN_FREE_OPTION = [
    rf"\b(?:make|made|making|adapt|adapted|convert|converted)\b.{{0,100}}\b{_GF}\b",
    rf"\b(?:can|could|may|to)\s+be\b.{{0,80}}\b{_GF}\b",
    rf"\b(?:use|using|choose|check|replace|substitute|swap|serve)\b.{{0,120}}\b{_GF}\b",
    rf"\b{_GF}\b.{{0,120}}\b(?:instead|alternative|option|version|variety|substitute|replacement)\b",
    rf"\b(?:for|as)\s+(?:a\s+)?{_GF}\b",
]
AMBIGUOUS_PORTIONS = ["dry yields", "amount to make", "guideline amount per", "prepared", "recipe", "yields", "yield"]

# Words of a question that tell nothing of a dish, words of form in food names.
RANK_STOP = """a an and any are can cook dish dishes eat evening food for from have how i idea ideas in is it make me meal meals my of on
or please recipe recipes some something that the to want what with would""".split()
FORM_WORDS = r"""\b(?:raw|cooked|canned|tinned|boiled|baked|fried|grilled|broiled|steamed|stewed|roasted|microwaved|braised|poached|drained|solids?|fluid|liquid|
with|without|added|prepared|reconstituted|undiluted|diluted|enriched|fortified|low|fat|free|reduced|whole|skim|skimmed|part|plain|natural|
regular|original|unflavou?red)\b""".replace("\n", "")
