"""Writers: reports, quarantined bulk writes, versioned rebuilds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(rows: DataFrame, path: str, columns: Sequence[str], order: Sequence[Column | str]) -> None:
    """A CSV report in a fixed column order, its parts in the order of the rows."""
    rows.select(*columns).orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_checked(rows: DataFrame, path: str, problem: Column) -> DataFrame:
    """Appends the rows without a problem to a Parquet table; returns those with one, and the problem, as a DataFrame."""
    marked = rows.withColumn("problem", problem)
    marked.where(F.col("problem").isNull()).drop("problem").write.mode("append").parquet(path)
    return marked.where(F.col("problem").isNotNull())


def write_version(rows: DataFrame, folder: str, version: int, view: str) -> None:
    """Writes a new version of a table beside the old ones and then points the view at it, at once for all readers."""
    path = f"{folder}/v={version:06d}"
    rows.write.mode("errorifexists").parquet(path)
    rows.sparkSession.read.parquet(path).createOrReplaceTempView(view)


def partition_counts(spark: SparkSession, path: str, by: str) -> DataFrame:
    """Rows of a written table by a column: what a check compares with the rows that were to be written."""
    return spark.read.parquet(path).groupBy(by).agg(F.count("*").alias("n"))
