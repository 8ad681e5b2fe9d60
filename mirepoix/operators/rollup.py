"""Roll-ups of weighted components to items, coverage ratios and guards. DataFrame in, DataFrame out; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted_totals(lines: DataFrame, item: str, weight: str, measures: Sequence[str], order: str | None = None) -> DataFrame:
    """(item, total_weight_g, total of each measure): weight / 100 * measure summed; a missing measure counts as 0.

    order: a column to add an item's lines up by. Sums of doubles depend on the order, and one that meets a threshold
    may come out above or below it; with a total order they are the same however the lines are dealt out. An item's
    lines are then sorted, but not held in memory.
    """
    values = {"total_weight_g": F.col(weight)} | {m: F.col(weight) / 100 * F.coalesce(F.col(m), F.lit(0.0)) for m in measures}
    if order is None:
        return lines.groupBy(item).agg(*(F.sum(v).alias(name) for name, v in values.items()))
    sorted_ = W.partitionBy(item).orderBy(order)
    sums = [F.sum(v).over(sorted_.rowsBetween(W.unboundedPreceding, 0)).alias(name) for name, v in values.items()]
    return lines.select(item, *sums, F.lead(F.lit(True)).over(sorted_).isNull().alias("last__")).where("last__").drop("last__")


def coverage(lines: DataFrame, item: str, weight: str, matched: Column, low: float = 0.8) -> DataFrame:
    """(item, coverage, low_coverage): the share of an item's weight that is matched; null where it has no weight."""
    share = F.sum(F.when(matched, F.col(weight)).otherwise(0)) / F.nullif(F.sum(weight), F.lit(0))
    return lines.groupBy(item).agg(F.bround(share, 4).alias("coverage")).withColumn("low_coverage", F.col("coverage") < low)


def eligible_share(lines: DataFrame, item: str, weight: str, eligible: Column, classified: Column) -> DataFrame:
    """(item, eligible_pct, classified_pct): shares of weight in percent; null where an item has no weight."""
    pct = lambda c: F.sum(F.when(c, F.col(weight)).otherwise(0)) / F.nullif(F.sum(weight), F.lit(0)) * 100
    return lines.groupBy(item).agg(pct(eligible).alias("eligible_pct"), pct(classified).alias("classified_pct"))


def consistent_totals(rows: DataFrame, keys: Sequence[str], unit: str, value: str, order: Sequence[str]) -> DataFrame:
    """(keys, unit, total, n_skipped): values in the unit of the first row of their keys summed, others counted."""
    first = F.first(unit).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    same = F.col(unit) == F.col("first_unit")
    return rows.withColumn("first_unit", first).groupBy(*keys, F.col("first_unit").alias(unit)).agg(F.sum(F.when(same, F.col(value))).alias("total"), F.sum((~same).cast("long")).alias("n_skipped"))


def capped_weights(lines: DataFrame, item: str, weight: str, serves: str, order: Sequence[str], ceiling: float = 2500, target: float = 700, share: float = 0.55) -> DataFrame:
    """lines with capped_weight and was_capped: items over `ceiling` grams a serving come down.

    If one component has over `share` of the weight, it alone is trimmed toward `target` a serving, to no less than a
    twentieth; else all are scaled to the ceiling. Of equal components the first by `order` is the largest.
    """
    whole = W.partitionBy(item)
    w = F.greatest(F.lit(0.0), F.col(weight))
    lines = lines.withColumn("w__", w).withColumn("total__", F.sum("w__").over(whole)).withColumn("nth__", F.row_number().over(whole.orderBy(F.desc("w__"), *order)))
    over = (F.col("total__") > 0) & (F.col(serves) > 0) & (F.col("total__") > F.col(serves) * ceiling)
    dominant = F.max("w__").over(whole) > share * F.col("total__")
    trimmed = F.when(F.col("nth__") == 1, F.greatest(F.col("w__") * 0.05, F.col("w__") - (F.col("total__") - F.col(serves) * target))).otherwise(F.col("w__"))
    scaled = F.col("w__") * F.col(serves) * ceiling / F.col("total__")
    lines = lines.withColumn("dominant__", dominant)
    capped = F.when(~over, F.col("w__")).when(F.col("dominant__"), trimmed).otherwise(scaled)
    return lines.withColumn("capped_weight", capped).withColumn("was_capped", over).drop("w__", "total__", "nth__", "dominant__")


def contribution_shares(lines: DataFrame, item: str, value: str, order: Sequence[str]) -> DataFrame:
    """lines with share (of the item's sum, null if that is 0) and contribution_rank (largest first, ties by `order`)."""
    whole = W.partitionBy(item)
    share = F.col(value) / F.nullif(F.sum(value).over(whole), F.lit(0))
    return lines.withColumns({"share": share, "contribution_rank": F.row_number().over(whole.orderBy(F.desc(value), *order))})


def best_row(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order that the caller states."""
    return rows.withColumn("nth__", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("nth__ = 1").drop("nth__")


def pivot_latest(rows: DataFrame, key: str, column: str, values: Sequence[str], value: str, order: str) -> DataFrame:
    """(key, a column for each of `values`): the value of the latest row of each; null where there is none."""
    latest = [F.max_by(F.when(F.col(column) == v, F.col(value)), F.when(F.col(column) == v, F.struct(order, value))).alias(v) for v in values]
    return rows.groupBy(key).agg(*latest)
