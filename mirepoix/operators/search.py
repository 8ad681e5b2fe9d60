"""Search over a catalog: constraints to predicates, relaxation, diverse selection, sorting, paging, boosts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.operators.scans import checkpointed


@dataclass(frozen=True)
class Constraints:
    """What a search asks for. hard always holds; soft facets may be dropped, the last first; missing status is active."""

    hard: Sequence[Column] = ()
    excluded: Sequence[Column] = ()
    any_of: Sequence[Column] = ()
    soft: Mapping[str, Column] = field(default_factory=dict)


def both(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def either(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def predicate(c: Constraints, soft: bool = True) -> Column:
    """One condition: all hard ones, none of the excluded, any of any_of if there are, all soft ones. Null counts as false."""
    parts = [*c.hard, *(~F.coalesce(x, F.lit(False)) for x in c.excluded), *([either(c.any_of)] if c.any_of else []), *(c.soft.values() if soft else ())]
    return F.coalesce(both(parts), F.lit(False))


def active(status: Column, inactive: Sequence[str] = ("disabled", "deleted")) -> Column:
    return ~F.coalesce(status, F.lit("active")).isin(*inactive)


def within(value: Column, low: float | None, high: float | None) -> Column:
    """Bounds that a missing value passes."""
    inside = both([*([value >= low] if low is not None else []), *([value <= high] if high is not None else [])])
    return value.isNull() | inside


def relaxed(rows: DataFrame, c: Constraints, least: int) -> DataFrame:
    """Rows that meet the hard conditions and as many soft ones as leave `least` rows, with their level and what was dropped.

    A row's level is how many soft facets, the last first, must be dropped for it: those up to the first (in order)
    that it fails. The level taken is the smallest with enough rows, else all; one aggregation over the levels finds it.
    """
    names = list(c.soft)
    level = reduce(lambda found, i: F.when(~F.coalesce(c.soft[names[i]], F.lit(False)), len(names) - i).otherwise(found), reversed(range(len(names))), F.lit(0))
    rows = rows.where(predicate(c, soft=False)).withColumn("level", level)
    counts = rows.groupBy("level").agg(F.count("*").alias("n"))  # a row for each level
    upto = counts.withColumn("upto", F.sum("n").over(W.orderBy("level")))
    taken = upto.agg(F.coalesce(F.min(F.when(F.col("upto") >= least, F.col("level"))), F.lit(len(names))).alias("taken"))
    dropped = F.array_join(F.slice(F.array(*map(F.lit, names)), F.lit(len(names)) - F.col("taken") + 1, F.col("taken")), ",") if names else F.lit("")
    return rows.crossJoin(F.broadcast(taken)).where("level <= taken").withColumn("dropped", dropped).drop("taken")


def diverse(rows: DataFrame, family: str, rank: Sequence[Column], n: int, per_family: int = 1, seen: DataFrame | None = None) -> DataFrame:
    """The first n rows by rank that take at most per_family of each family, filled up with the others in rank order.

    Rows without a family (null or empty) are never too many. `rank` must be a total order. seen: (family, seen), how
    many of a family were taken before, which count; families that it lacks have none.
    """
    if seen is not None:
        rows = rows.join(seen.select(family, F.col("seen").alias("seen__")), family, "left")
    before = F.coalesce("seen__", F.lit(0)) if seen is not None else F.lit(0)
    nth, named = F.row_number().over(W.partitionBy(family).orderBy(*rank)) + before, F.coalesce(F.col(family) != "", F.lit(False))
    first = rows.where(named).withColumn("nth__", nth).where(F.col("nth__") <= per_family)
    alone = rows.where(~named).orderBy(*rank).limit(n).withColumn("nth__", F.lit(0))
    # others are needed only if there are fewer than n of the above, and then the best 2 n rows of all hold enough of them
    others = rows.orderBy(*rank).limit(2 * n).where(named).withColumn("nth__", nth).where(F.col("nth__") > per_family)
    return first.unionByName(alone).unionByName(others).orderBy(F.col("nth__") > per_family, *rank).limit(n).drop("nth__", "seen__")


def diverse_slots(slots: Sequence[tuple[str, DataFrame]], family: str, rank: Sequence[Column], n: int, per_family: int = 1) -> DataFrame:
    """(slot, the rows' columns): n rows for each slot of a plan, one after the other, with families counted over all slots so far.

    slots: (name, its candidates), in the plan's order. A slot's choice, n rows at most, is cut from its lineage, so that
    the next slots read it instead of choosing again.
    """
    chosen, taken = None, None
    for name, rows in slots:
        seen = None if taken is None else taken.where(F.coalesce(F.col(family) != "", F.lit(False))).groupBy(family).agg(F.count("*").alias("seen"))
        one = checkpointed(diverse(rows, family, rank, n, per_family, seen).select(F.lit(name).alias("slot"), *rows.columns))
        chosen = one if chosen is None else chosen.unionByName(one)
        taken = chosen.select(family)
    return chosen


def page(rows: DataFrame, order: Sequence[Column], start: int, size: int, window: int = 10_000, cap: int = 100) -> DataFrame:
    """A page in a total order; sizes over `cap` are cut to it, pages that end beyond `window` are refused."""
    size = min(size, cap)
    if start < 0 or start + size > window:
        raise ValueError(f"a page must end within {window} rows")
    return rows.orderBy(*order).offset(start).limit(size)


def sort_columns(spec: str, allowed: Sequence[str]) -> list[Column]:
    """Columns of a "field:direction,..." sort; nulls come last either way. Unknown fields and directions are refused."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, _, direction = part.partition(":")
        if name not in allowed or direction not in ("", "asc", "desc"):
            raise ValueError(f"can't sort by {part!r}")
        out.append(F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_last())
    return out


def shuffled_order(key: str, seed: int) -> list[Column]:
    """A random but repeatable total order."""
    return [F.xxhash64(key, F.lit(seed)), F.col(key)]


def boosted(score: Column, boosts: Sequence[tuple[Column, float]]) -> Column:
    return reduce(lambda s, b: s + F.when(b[0], b[1]).otherwise(0.0), boosts, score)


def accepted(values: DataFrame, value: str, vocabulary: DataFrame, term: str) -> DataFrame:
    """values with `accepted`: whether the closed vocabulary has them."""
    known = vocabulary.select(F.col(term).alias(value)).distinct().withColumn("known__", F.lit(True))
    return values.join(known, value, "left").withColumn("accepted", F.coalesce("known__", F.lit(False))).drop("known__")


def prefix_suggestions(rows: DataFrame, title: str, query: str, limit: int = 10) -> DataFrame:
    """Distinct titles (by case) that have words beginning with each of the query's, the last as a prefix, shortest first."""
    *whole, last = query.lower().split() or [""]
    padded = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    hit = both([padded.contains(f" {w} ") for w in whole] + [padded.contains(f" {last}")])
    found = rows.where(hit).groupBy(F.lower(title).alias("key")).agg(F.min(title).alias("suggestion"))
    return found.orderBy(F.length("suggestion"), "key").limit(limit).select("suggestion")
