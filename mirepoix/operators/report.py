"""Report aggregations: subtotals, facets, distributions, outliers, deviations, agreement and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.operators.scans import checkpointed, running


def with_subtotals(rows: DataFrame, scope: str, keys: Sequence[str], aggregates: Sequence[Column], all_name: str = "ALL") -> DataFrame:
    """Aggregates by (scope, keys), and by keys alone with scope `all_name`: one pass of grouping sets."""
    sets = [[scope, *keys], list(keys)]
    grouped = rows.groupingSets(sets, scope, *keys).agg(*aggregates, F.grouping(scope).alias("whole__"))
    return grouped.withColumn(scope, F.when(F.col("whole__") == 1, F.lit(all_name)).otherwise(F.col(scope))).drop("whole__")


def top_n(rows: DataFrame, scope: Sequence[str], order: Sequence[Column], n: int, rank: str = "nth") -> DataFrame:
    """The first n rows of each scope in a total order, numbered from 1."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*scope).orderBy(*order))).where(F.col(rank) <= n)


def facet_counts(rows: DataFrame, fields: Sequence[str], size: int | None = None) -> DataFrame:
    """(field, value, n) for each value of each field, arrays by element, nulls left out; the `size` largest of a field.

    One scan: the fields become (field, values) rows. Ties go to the smaller value.
    """
    types = dict(rows.dtypes)
    each = [F.struct(F.lit(f).alias("field"), (F.col(f).cast("array<string>") if types[f].startswith("array") else F.array(F.col(f).cast("string"))).alias("values")) for f in fields]
    values = rows.select(F.inline(F.array(*each))).select("field", F.explode("values").alias("value")).where("value is not null")
    counts = values.groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts if size is None else top_n(counts, ["field"], [F.desc("n"), F.col("value")], size).drop("nth")


def folded(counts: DataFrame, value: str, mapping: DataFrame, variant: str, canonical: str, n: str = "n") -> DataFrame:
    """Counts of variants summed under their canonical value; values without a variant row stay."""
    joined = counts.join(mapping, counts[value] == mapping[variant], "left")
    keys = [c for c in counts.columns if c not in (value, n)]
    return joined.groupBy(*keys, F.coalesce(canonical, value).alias(value)).agg(F.sum(n).alias(n))


def _counted(rows: DataFrame, keys: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """(g__, v__, c__): how often each finite value occurs with each keys; counted once, as it is read several times. parts: how many to deal it into."""
    number = F.col(value).cast("double")
    each = rows.where(~F.isnan(number) & (F.abs(number) < float("inf"))).select(F.struct(*keys).alias("g__"), number.alias("v__"))
    each = (each.repartition(parts, "g__", "v__") if parts else each).groupBy("g__", "v__")
    return each.agg(F.count("*").alias("c__")).persist(StorageLevel.MEMORY_AND_DISK)


def _distribution(counted: DataFrame, keys: Sequence[str], shares: dict[str, float], bins: int = 1 << 16) -> DataFrame:
    """(keys, n, mean, least, most, a column for each share) from _counted rows: exact quantiles, interpolated between neighbours.

    Each group's range is cut into bins of equal width on a logarithmic scale, whose counts tell which bins hold the
    wanted ranks; the values of these alone are sorted, in ranges, so that no task sorts a group or a full bin whole.
    """
    v, n = F.col("v__"), F.sum("c__")
    stats = counted.groupBy("g__").agg(n.alias("n"), (F.sum(v * F.col("c__")) / n).alias("mean"), F.min("v__").alias("least"), F.max("v__").alias("most"))
    scaled = lambda c: F.signum(c) * F.log1p(F.abs(c))
    span = F.nullif(scaled(F.col("most")) - scaled(F.col("least")), F.lit(0.0))
    bin_ = F.coalesce(F.floor((scaled(v) - scaled(F.col("least"))) / span * (bins - 1)), F.lit(0))
    binned = counted.join(stats.select("g__", "least", "most"), "g__").select("g__", bin_.alias("b__"), "v__", "c__")
    sums = binned.groupBy("g__", "b__").agg(F.sum("c__").alias("n__"))
    of = W.partitionBy("g__")  # at most `bins` rows a group
    sums = sums.withColumns({"all__": F.sum("n__").over(of), "upto__": F.sum("n__").over(of.orderBy("b__").rowsBetween(W.unboundedPreceding, W.currentRow))})
    ends = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("all__") - 1)
        low = F.floor(place)
        ends += [(name, 1 - (place - low), low), (name, place - low, F.least(low + 1, F.col("all__") - 1))]
    before = F.col("upto__") - F.col("n__")
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), weight.alias("weight"), (rank - before).alias("rank")) for name, weight, rank in ends))
    needed = sums.select("g__", "b__", F.filter(wanted, lambda x: (x["rank"] >= 0) & (x["rank"] < F.col("n__"))).alias("wanted__")).where("size(wanted__) > 0")
    near = running(checkpointed(binned.join(needed, ["g__", "b__"])), ["g__", "b__"], ["v__"], {"upto__": ("sum", F.col("c__"))})
    hit = near.select("g__", "v__", "c__", "upto__", F.inline("wanted__")).where("rank < upto__ and rank >= upto__ - c__")
    found = hit.groupBy("g__").agg(*(F.sum(F.when(F.col("name") == name, F.col("weight") * v)).alias(name) for name in shares))
    return stats.join(found, "g__").select(*(F.col("g__")[k].alias(k) for k in keys), "n", "mean", "least", "most", *shares)


def distribution(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, mean, least, most, a column for each share): exact figures of the finite values, quantiles interpolated.

    Nulls, NaN and infinite values are left out; keys without any other have no row.
    """
    return _distribution(_counted(rows, keys, value), keys, shares)


def summary(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], digits: int = 4) -> DataFrame:
    """(keys, measure, n, mean, median, least, most) of each measure: unpivoted, exact medians, nulls left out."""
    long = rows.unpivot(list(keys), list(measures), "measure", "value")
    found = distribution(long, [*keys, "measure"], "value", {"median": 0.5})
    return found.select(*keys, "measure", "n", *(F.round(c, digits).alias(c) for c in ("mean", "median", "least", "most")))


def outliers(rows: DataFrame, keys: Sequence[str], value: str, fence: float = 1.5, parts: int | None = None) -> DataFrame:
    """(keys, n, mean, median, q1, q3, high, n_outliers): Tukey's upper fence over positive values, quartiles interpolated."""
    counted = _counted(rows.where(F.col(value) > 0), keys, value, parts)
    stats = _distribution(counted, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumn("high", F.col("q3") + fence * (F.col("q3") - F.col("q1")))
    fences = stats.select(F.struct(*keys).alias("g__"), "high")
    beyond = counted.join(fences, "g__").groupBy("g__").agg(F.sum(F.when(F.col("v__") > F.col("high"), F.col("c__")).otherwise(0)).alias("n_outliers"))
    return stats.withColumn("g__", F.struct(*keys)).join(beyond, "g__").drop("g__", "least", "most")


def filled_distribution(rows: DataFrame, key: str, value: str, domain: DataFrame) -> DataFrame:
    """(key, value, n, pct) for each key and each value of the (small, fixed) domain, zeros filled in."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    keys = counts.select(key).distinct().withColumn(value, F.explode(F.lit([r[0] for r in domain.select(value).distinct().orderBy(value).collect()])))
    full = keys.join(counts, [key, value], "left").select(key, value, F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("pct", F.round(F.col("n") / F.nullif(F.sum("n").over(W.partitionBy(key)), F.lit(0)) * 100, 4))


def confusion(pairs: DataFrame, actual: str, predicted: str, values: Sequence) -> DataFrame:
    """(actual, predicted, n, row_total, row_pct) for all pairs of values, zeros filled in."""
    grid = pairs.sparkSession.createDataFrame([(a, b) for a in values for b in values], f"{actual} {dict(pairs.dtypes)[actual]}, {predicted} {dict(pairs.dtypes)[predicted]}")
    counts = pairs.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    full = grid.join(counts, [actual, predicted], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy(actual))
    return full.withColumns({"row_total": total, "row_pct": F.round(F.col("n") / F.nullif(total, F.lit(0)) * 100, 4)})


def deviation_pct(calculated: Column, reference: Column) -> Column:
    """Absolute deviation in percent: 0 if both are 0, null if only the reference is."""
    return F.when((reference == 0) & (calculated == 0), 0.0).when(reference == 0, None).otherwise(F.abs(calculated - reference) / F.abs(reference) * 100)


def bucketed(value: Column, edges: Sequence[float], labels: Sequence[str], missing: str = "missing") -> Column:
    """The label of the first edge that value is below; the last label beyond all; `missing` for null."""
    ladder = F.when(value.isNull(), missing)
    for edge, label in zip(edges, labels):
        ladder = ladder.when(value < edge, label)
    return ladder.otherwise(labels[-1])


def completeness(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, n, n_missing, pct_complete): one pass over all fields; an empty string counts as missing."""
    kinds = dict(rows.dtypes)
    missing = lambda f: F.col(f).isNull() | (F.trim(f) == "") if kinds[f] == "string" else F.col(f).isNull()
    wide = rows.agg(F.count("*").alias("n"), *(F.count_if(missing(f)).alias(f) for f in fields))
    return wide.unpivot(["n"], list(fields), "field", "n_missing").select("field", "n", "n_missing", F.round((F.col("n") - F.col("n_missing")) / F.nullif("n", F.lit(0)) * 100, 4).alias("pct_complete"))


def samples(rows: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """(keys, n_distinct, examples): distinct values and the k smallest of them, ranked, so that no group is collected whole."""
    distinct = rows.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    counts = distinct.groupBy(*keys).agg(F.count("*").alias("n_distinct"))
    first = top_n(distinct, keys, [F.col(value)], k).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.col(value).cast("string"))), ",").alias("examples"))
    return counts.join(first, list(keys))
