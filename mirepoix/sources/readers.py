"""Readers of the data's file formats. Schemas are stated or taken from headers; nothing is inferred by a second scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirepoix.operators.scans import running
from pyspark.sql.types import StructType


def json_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array of records, or one record a line. Convert a huge array once: such a file is read by one task."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_dictionary(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """A JSON object of records by key: (key, the record's columns)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {value_schema}>").alias("m"))
    return whole.select(F.explode("m").alias(key, "record")).select(key, "record.*")


def csv_strings(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A CSV file with a header, every column a string."""
    return spark.read.csv(path, sep=separator, header=True, inferSchema=False, quote='"', escape='"')


def delimited(spark: SparkSession, path: str, columns: Sequence[str], separator: str = "^", quote: str = "~") -> DataFrame:
    """Headerless fields between carets, strings in tildes."""
    return spark.read.csv(path, sep=separator, quote=quote, schema=", ".join(f"`{c}` string" for c in columns))


def long_nutrients(spark: SparkSession, path: str, food: str, code: str, value: str, separator: str = "|") -> DataFrame:
    """(food, nutrients): a long file of (food, code, value) rows with a header as a map for each food.

    "NaN" is a nutrient code there, no missing value; decimal commas are read; of repeated codes the largest value counts.
    """
    rows = spark.read.csv(path, sep=separator, header=True, nullValue="\u0000", nanValue="\u0000")
    number = F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")
    single = rows.select(F.col(food).alias("food"), F.trim(code).alias("code"), number.alias("value")).where("value is not null").groupBy("food", "code").agg(F.max("value").alias("value"))
    return single.groupBy("food").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "value")))).alias("nutrients"))


def links(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """The groups of a pattern in each line of text files, such as links of a Turtle file; lines without one are left out."""
    text = spark.read.text(path).where(F.col("value").rlike(pattern))
    return text.select(*(F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)))


def composition(spark: SparkSession, path: str, nutrients: Sequence[str], number: Column | None = None) -> DataFrame:
    """A wide CSV of foods as (food_id, food_name, nutrients): columns by header, values coerced, absent ones left out."""
    from mirepoix.functions.text import coerced_number

    rows = csv_strings(spark, path)
    entries = F.array_compact(F.array(*(F.when(coerced_number(F.col(n)).isNotNull(), F.struct(F.lit(n).alias("key"), coerced_number(F.col(n)).alias("value"))) for n in nutrients)))
    return rows.select("food_id", "food_name", F.map_from_entries(entries).alias("nutrients"))


def named_dimension(spark: SparkSession, folder: str, name: str, names: Sequence[str]) -> DataFrame:
    """One of the closed set of static tables kept as Parquet in a folder."""
    if name not in names:
        raise KeyError(f"no static table {name!r}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that each hold one JSON array of objects, however large, read by many tasks; columns of the schema.

    Spark's text reader cuts the files into byte ranges and these after each closing brace. Whether a piece begins in
    a string follows from the quotes before it, and how deep it lies from the brackets before it outside of strings:
    two running sums over the files' pieces. Pieces between two places at depth one are a record, joined and parsed.
    A record must fit a row; fields that the schema doesn't name are left out, those that a record lacks are null.
    Empty arrays and no files: no rows. Elements that are no objects, and their siblings up to the next object, are null rows.
    """
    pieces = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    without_strings = lambda text: F.regexp_replace(text, r'"[^"]*("|$)', "")
    opened = lambda text: count(text, "{[") - count(text, "}]")
    odd = count(F.col("plain"), '"') % 2
    outside, inside = opened(without_strings(F.col("plain"))), opened(without_strings(F.regexp_replace("plain", r'^[^"]*("|$)', "")))
    # a piece that ends outside of a string ends with a brace that the cut took away
    cut = pieces.withColumn("plain", plain).select("file", "block", "nth", "value", odd.cast("long").alias("odd"), (outside - (1 - odd)).cast("long").alias("outside"), (inside - odd).cast("long").alias("inside"))
    quoted = running(cut, ["file"], ["block", "nth"], {"quotes": ("sum", F.col("odd"))})
    began_inside = (F.col("quotes") - F.col("odd")) % 2 == 1
    step = quoted.withColumn("step", F.when(began_inside, F.col("inside")).otherwise(F.col("outside")))
    deep = running(step, ["file"], ["block", "nth"], {"depth": ("sum", F.col("step"))})
    ends = deep.withColumn("ends", ((F.col("quotes") % 2 == 0) & (F.col("depth") == 1)).cast("long"))
    numbered = running(ends, ["file"], ["block", "nth"], {"ended": ("sum", F.col("ends"))}).withColumn("record", F.col("ended") - F.col("ends"))
    parts = F.array_sort(F.collect_list(F.struct("block", "nth", "value", "ends")))
    records = numbered.groupBy("file", "record").agg(parts.alias("parts")).where(F.element_at("parts", -1)["ends"] == 1)
    text = F.regexp_replace(F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}")), r"^[\s,\[﻿]+", "")
    return records.select(F.from_json(text, schema).alias("row")).select("row.*")


def ontology(spark: SparkSession, path: str, prefix: str = "http://purl.obolibrary.org/obo/") -> tuple[DataFrame, DataFrame]:
    """(id, uri, label) and (child, parent) of the named classes of RDF/XML files, which are read by byte ranges.

    id: what follows the last slash of a uri under the prefix, else the uri. Parents are named classes only, without
    restrictions; those that no file describes are nodes, too, without a label. Of a class described more than once the
    least label counts that isn't blank; in one description the first. Repeated edges are one. No classes: no rows.
    """
    schema = "`_rdf:about` string, `rdfs:label` array<struct<_VALUE string>>, `rdfs:subClassOf` array<struct<`_rdf:resource` string>>"
    classes = spark.read.schema(schema).option("rowTag", "owl:Class").xml(path).toDF("uri", "labels", "parents").where("uri is not null and uri != ''")
    short = lambda uri: F.when(F.startswith(uri, F.lit(prefix)), F.substring_index(uri, "/", -1)).otherwise(uri)
    edges = classes.select("uri", F.explode("parents._rdf:resource").alias("parent")).where("parent is not null and parent != ''").distinct()
    label = F.nullif(F.trim(F.get("labels._VALUE", F.lit(0))), F.lit(""))
    named = classes.select("uri", label.alias("label")).unionByName(edges.select(F.col("parent").alias("uri"), F.lit(None).cast("string").alias("label")))
    nodes = named.groupBy("uri").agg(F.min("label").alias("label"))
    return nodes.select(short(F.col("uri")).alias("id"), "uri", "label"), edges.select(short(F.col("uri")).alias("child"), short(F.col("parent")).alias("parent"))
