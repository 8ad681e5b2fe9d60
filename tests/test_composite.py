from pyspark.sql import functions as F

from mirepoix.operators import composite as C

ROW = "source string, code string, food_name string, food_group string, column string, value string, unit string, position long"
MAP = "source string, column string, key string, unit string, nth int"


def test_cells(spark):
    want = {"1,5": 1.5, "< 0.1": 0.1, ">2": 2.0, " Tr ": None, "traces": None, "-": None, "N": None, "n/a": None, "NaN": None, "inf": None, "": None, None: None, "12 g": None, "1e2": 100.0}
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(want)], "i int, v string").select("i", C.measured(F.col("v")).alias("n")).orderBy("i").collect()
    assert dict(zip(want, (r.n for r in rows))) == want


def test_sources_become_one_data_set(spark):
    rows = [
        ("nl", "1", " carrot ", "veg", "RET", "3", "µg", 0), ("nl", "1", " carrot ", "veg", "BETA", "6", "µg", 1), ("nl", "1", "carrot", "veg", "LUT", "1,25", "ug", 2), ("nl", "1", "carrot", "veg", "ZEA", "0.5", "ug", 3),
        ("nl", "1", "carrot", "veg", "LUT", "2.25", "ug", 4), ("nl", "2", "stew", "dishes", "RET", "3", "ug", 0), ("fr", "2", "stew", "dishes", "RET", "tr", "ug", 0), ("fr", "3", "oil", None, "A", "1", "mg", 0),
        ("fr", "3", "oil", None, "B", "2", "g", 0), ("fr", "3", "oil", None, "none", "2", "g", 0), ("fr", "4", None, "x", "A", "1", "g", 0), ("fr", "5", "iron", "x", "C", "7", " µg ", 0),
    ]
    mapping = [("nl", "RET", "Retinol", "ug", 1), ("nl", "BETA", "Carotene, beta", None, 2), ("nl", "LUT", "L+Z", "ug", 3), ("nl", "ZEA", "Z", "ug", 4), ("fr", "A", "Fat", "g", 2), ("fr", "B", "Fat", "g", 1), ("fr", "C", "Iron", "", 3), ("fr", "RET", "Retinol", "ug", 4), ("fr", "D", None, None, 5)]
    dropped = spark.createDataFrame([("nl", "dishes"), ("fr", "veg")], "source string, food_group string")
    found = C.composite(spark.createDataFrame(rows, ROW), spark.createDataFrame(mapping, MAP), dropped, [("nl", "L+Z", "Z"), ("fr", "Fat", "Z")]).collect()
    got = {r.id: (r.food_name, r.source, r.food_group, {k: tuple(v) for k, v in r.nutrients.items()}) for r in found}
    assert got == {
        "nl:1": ("carrot", "nl", "veg", {"Retinol": ("ug", 3.0, "RET"), "Carotene, beta": ("ug", 6.0, "BETA"), "L+Z": ("ug", 2.75, "LUT+ZEA"), "Z": ("ug", 0.5, "ZEA"), "Vitamin A, IU": ("IU", 20.0, "computed_from_retinol+beta_carotene")}),
        "fr:3": ("oil", "fr", None, {"Fat": ("g", 1.0, "A")}),
        "fr:5": ("iron", "fr", "x", {"Iron": ("ug", 7.0, "C")}),
    }
    empty = C.composite(spark.createDataFrame([], ROW), spark.createDataFrame([], MAP), dropped)
    assert empty.collect() == []


def test_sheets_are_assembled_by_code(spark):
    head = "code string, food_name string, food_group string, position long"
    main = spark.createDataFrame([("11-1", "apple", "fruit", 5, "1"), ("11-1", "second", "fruit", 9, "2"), ("11-2", "pear", None, 6, None), (None, "x", "y", 1, "3")], f"{head}, Water string")
    other = spark.createDataFrame([("11-1", "ignored", "g", 1, "4"), ("11-9", "only here", "g", 2, "5")], f"{head}, Iron string")
    got = C.assembled([("main", main, ["Water"]), ("minerals", other, ["Iron"])], "uk").collect()
    assert {(r.code, r.food_name, r.food_group, r.column, r.value) for r in got} == {("11-1", "apple", "fruit", "main::Water", "1"), ("11-2", "pear", None, "main::Water", None), ("11-1", "apple", "fruit", "minerals::Iron", "4")}
