"""How the library's concepts are bound to the driver's tables: orders are items, order lines components, parts foods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str, rows: int = 500_000) -> int:
    """Into how many parts work on a table's rows is dealt, so that a task's memory stays as it is when the table grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, name).count() // rows))


def lines(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """(item_id, food_id, source_id, position, weight_g, energy_kcal, fat_g, salt_g): measures are for each 100 g.

    placed: with `place`, where a line stands in the table's files, to add up in an order that is always the same.
    """
    place = [F.struct("_metadata.file_path", "_metadata.row_index").alias("place")] if placed else []
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("food_id"), F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("position"),
        (F.col("l_quantity") * 10).alias("weight_g"), (F.col("l_extendedprice") / 100).alias("energy_kcal"), (F.col("l_discount") * 100).alias("fat_g"), (F.col("l_tax") * 10).alias("salt_g"), *place,
    )


#: The same in SQL, to begin oracles with.
LINES = """lines AS (SELECT l_orderkey AS item_id, l_partkey AS food_id, l_suppkey AS source_id, l_linenumber AS position,
  l_quantity * 10 AS weight_g, l_extendedprice / 100 AS energy_kcal, l_discount * 100 AS fat_g, l_tax * 10 AS salt_g FROM lineitem)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, region): the region that each source of measures belongs to."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("n_nationkey"))
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("region"))
    return supplier.join(places, "n_nationkey").select("source_id", "region")


REGIONS = """regions AS (SELECT s_suppkey AS source_id, r_name AS region FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, region, score, updated_at): one row for each line's source, as recorded score profiles of an item."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("updated_at"), (F.floor("l_extendedprice") % 40 - 10).cast("int").alias("score"))
    return line.join(regions(spark, sf_dir), "source_id").select("item_id", "region", "score", "updated_at")


SCORES = f"""{REGIONS}, scores AS (SELECT l_orderkey AS item_id, region, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 40 - 10 AS INT) AS score,
  l_shipdate AS updated_at FROM lineitem JOIN regions ON l_suppkey = source_id)"""


def steady(value: Column, digits: int) -> Column:
    """value cut to digits away from halves, so that sums in another order give the same; in SQL floor(x * 10^d + 0.3) / 10^d."""
    return F.floor(value * 10**digits + 0.3) / 10**digits


def rounded(value: Column, digits: int) -> Column:
    """value rounded as SQL's round does it for doubles, from the product with a power of ten and not from its decimal form."""
    return F.round(value * 10**digits) / 10**digits


def exact_sum(value: Column) -> Column:
    """The sum of doubles, each to twelve digits after the point, free of their order; for sums whose last digits show after rounding."""
    return F.sum(value.cast("decimal(28,12)")).cast("double")
