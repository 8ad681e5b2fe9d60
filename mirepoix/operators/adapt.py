"""Swaps of components and their effect on an item's profile: simulation, gates, ranking, smallest changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.functions import scoring
from mirepoix.operators.report import top_n
from mirepoix.operators.rollup import weighted_totals


def swapped(lines: DataFrame, candidates: DataFrame, item: str, component: str, weight: str, measures: Sequence[str], substitute: str = "substitute") -> DataFrame:
    """(item, component, substitute, measure before and after for each measure): item totals with one component exchanged.

    Totals are linear in the components, so a swap is the total less the old contribution plus the new at the same
    weight. candidates: (component, substitute, the measures for each 100 g of the substitute).
    """
    own = [F.sum(F.col(weight) / 100 * F.col(m)).alias(m) for m in measures]
    parts = lines.groupBy(item, component).agg(F.sum(weight).alias("w__"), *own)
    totals = parts.groupBy(item).agg(*(F.sum(m).alias(f"{m}_before") for m in measures))
    renamed = candidates.select(component, substitute, *(F.col(m).alias(f"c__{m}") for m in measures))
    pairs = parts.join(renamed, component).join(totals, item)
    after = [(F.col(f"{m}_before") - F.col(m) + F.col("w__") / 100 * F.col(f"c__{m}")).alias(f"{m}_after") for m in measures]
    return pairs.select(item, component, substitute, F.col("w__").alias("weight"), *(f"{m}_before" for m in measures), *after)


def improving(swaps: DataFrame, gates: Sequence[Column]) -> DataFrame:
    """Swaps that pass every gate; a gate that is null is not passed."""
    out = swaps
    for g in gates:
        out = out.where(F.coalesce(g, F.lit(False)))
    return out


def ranked(swaps: DataFrame, item: str, order: Sequence[Column], k: int) -> DataFrame:
    return top_n(swaps, [item], order, k, "suggestion")


def first_viable(swaps: DataFrame, item: str, offender_rank: str) -> DataFrame:
    """Each item's swaps of its first offender that has any."""
    least = F.min(offender_rank).over(W.partitionBy(item))
    return swaps.withColumn("least__", least).where(F.col(offender_rank) == F.col("least__")).drop("least__")


def smallest_reduction(totals: DataFrame, item: str, keep: Sequence[float], reduced: Column, better: Column) -> DataFrame:
    """(item, kept): the largest share of a component to keep with which `better` holds; items that none helps are left out.

    `reduced` may use the column kept; it becomes the column reduced, which `better` may use. A few steps a row.
    """
    steps = totals.withColumn("kept", F.explode(F.array(*map(F.lit, keep)))).withColumn("reduced", reduced)
    return steps.where(better).groupBy(item).agg(F.max("kept").alias("kept"))


def first_substitutes(sources: Sequence[tuple[str, DataFrame]], component: str, substitute: str = "substitute") -> DataFrame:
    """(component, substitute, source): the first candidate of the first source that has any for a component.

    sources: (name, rows of component, substitute and, where their order matters, rank: least first, then the least
    substitute). Nulls and a component as its own substitute are no candidates.
    """
    rank = lambda rows: F.col("rank").cast("double") if "rank" in rows.columns else F.lit(0.0)
    each = [rows.select(component, substitute, rank(rows).alias("rank"), F.lit(i).alias("tier")) for i, (_, rows) in enumerate(sources)]
    good = reduce(DataFrame.unionByName, each).where(F.col(substitute).isNotNull() & (F.col(component) != F.col(substitute)))
    best = good.groupBy(component).agg(F.min_by(F.struct(substitute, "tier"), F.struct("tier", "rank", substitute)).alias("best"))
    names = F.array(*(F.lit(name) for name, _ in sources))
    return best.select(component, F.col(f"best.{substitute}").alias(substitute), F.element_at(names, F.col("best.tier") + 1).alias("source"))


def substituted(lines: DataFrame, swaps: DataFrame, foods: DataFrame, item: str, component: str, weight: str, measures: Sequence[str], substitute: str = "substitute") -> DataFrame:
    """lines with each swapped component under its substitute, at its own weight and with the substitute's measures; and `replaces`.

    swaps: one (item, component, substitute) an item and component; all lines of the component are swapped. foods:
    (substitute, measures for each 100 g), one row each; a measure that the substitute lacks counts 0. replaces: the
    component before; null on lines that stay as they are. Other columns are kept.
    """
    new = foods.select(F.col(substitute).alias("new__"), F.lit(True).alias("known__"), *(F.col(m).alias(f"m__{m}") for m in measures))
    wanted = swaps.select(F.col(item).alias("item__"), F.col(component).alias("old__"), F.col(substitute).alias("new__")).join(new, "new__", "left")
    joined = lines.join(wanted, (F.col(item) == F.col("item__")) & (F.col(component) == F.col("old__")), "left")
    swapped_ = F.col("new__").isNotNull()
    values = {m: F.when(swapped_, F.coalesce(f"m__{m}", F.lit(0.0))).otherwise(F.col(m)) for m in measures} | {component: F.coalesce("new__", component)}
    return joined.select(*(values[c].alias(c) if c in values else F.col(c) for c in lines.columns), F.col("old__").alias("replaces"))


def reprofiled(lines: DataFrame, item: str, weight: str, measures: Sequence[str], serves: DataFrame, order: str | None = None) -> DataFrame:
    """(item, total_weight_g, serves, and for each measure its total, {m}_per_100g and {m}_per_serving) of adapted lines.

    serves: (item, serves), one row each; none, null and 0 or less count as one serving. Items without weight have no
    values for each 100 g. order: of the sums, as in weighted_totals.
    """
    totals = weighted_totals(lines, item, weight, measures, order).join(serves.select(item, "serves"), item, "left")
    count = F.when(F.col("serves") > 0, F.col("serves").cast("double")).otherwise(1.0)
    per = [c for m in measures for c in (scoring.per_100g(F.col(m), F.col("total_weight_g")).alias(f"{m}_per_100g"), scoring.per_serving(F.col(m), F.col("serves")).alias(f"{m}_per_serving"))]
    return totals.withColumn("serves", count).select(item, "total_weight_g", "serves", *measures, *per)
