"""Documents: redaction by role, carry-over of annotations, one entry for each group."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from mirepoix.operators.scans import running


def redacted(rows: DataFrame, names: Collection[str], privileged: bool = False) -> DataFrame:
    """rows without the fields of these names, at any depth of structs and arrays; as they are for the privileged."""
    if privileged:
        return rows
    kept = [f for f in rows.schema.fields if f.name not in names]
    return rows.select(*(_without(F.col(f"`{f.name}`"), f.dataType, names).alias(f.name) for f in kept))


def _holds(kind: DataType, names: Collection[str]) -> bool:
    if isinstance(kind, ArrayType):
        return _holds(kind.elementType, names)
    return isinstance(kind, StructType) and any(f.name in names or _holds(f.dataType, names) for f in kind.fields)


def _without(value: Column, kind: DataType, names: Collection[str]) -> Column:
    if not _holds(kind, names):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _without(x, kind.elementType, names))
    fields = [f for f in kind.fields if f.name not in names]
    return F.when(value.isNotNull(), F.struct(*(_without(value[f.name], f.dataType, names).alias(f.name) for f in fields)))


def carried_over(fresh: DataFrame, old: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """fresh with old's values in the columns where its own are null or empty, and what came of each row: new, carried or kept."""
    before = old.select(F.col(key).alias("key__"), *(F.col(c).alias(f"{c}__") for c in columns))
    joined = fresh.join(before, F.col(key) == F.col("key__"), "left")
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    filled = [F.when(empty(c), F.col(f"{c}__")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in fresh.columns]
    carried = F.array_max(F.array(*(empty(c) & F.col(f"{c}__").isNotNull() for c in columns)))
    outcome = F.when(F.col("key__").isNull(), "new").when(carried, "carried").otherwise("kept")
    return joined.select(*filled, outcome.alias("outcome"))


def one_per_group(rows: DataFrame, keys: DataFrame, key: str, group: str, value: str, groups: Sequence[str], default: str) -> DataFrame:
    """(key, group, value) with one row for each key and each of the groups: rows' least value, or the default."""
    wanted = keys.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, groups))).alias(group))
    least = rows.groupBy(key, group).agg(F.min(value).alias(value))
    return wanted.join(least, [key, group], "left").select(key, group, F.coalesce(value, F.lit(default)).alias(value))


def appended(tags: Column, tag: str | Column) -> Column:
    """The tags with one more, unless they have it."""
    new = F.lit(tag) if isinstance(tag, str) else tag
    return F.when(F.array_contains(tags, new), tags).otherwise(F.array_append(tags, new))


def hash_number(value: Column, modulus: int) -> Column:
    """The SHA-1 of a text, as one large number, modulo `modulus` (up to 2**34): its hexadecimal digits are taken in sevens."""
    digest, rest = F.sha1(value), F.lit(0).cast("long")
    for at in range(0, 40, 7):
        n = min(7, 40 - at)
        rest = (rest * 16**n + F.conv(F.substring(digest, at + 1, n), 16, 10).cast("long")) % modulus
    return rest


def free_ids(rows: DataFrame, key: str, digits: int = 10, refuse: bool = True) -> DataFrame:
    """rows with new_id: so many digits of the key's SHA-1, or the next number that is free, from 0 again after the last.

    Ids are as linear probing gives them where keys come in order of their number and then their own: with numbers
    h(0) <= h(1) ..., id(i) = i + max(h(j) - j) over j <= i. That maximum runs over ranges of the sorted keys, none of
    them held whole by a task. Those beyond the last number take the first ones, and what they displace moves up.
    Keys must be neither null nor repeated. More keys than numbers are refused, or without `refuse` have null ids, all of
    them. No rows: none.
    """
    modulus, order = 10**digits, ["hash__", key]
    numbered = running(rows.withColumn("hash__", hash_number(F.col(key).cast("string"), modulus)), [], order, {"nth__": ("sum", F.lit(1))})
    probed = running(numbered, [], order, {"ahead__": ("max", F.col("hash__") - F.col("nth__") + 1)})
    at = F.col("nth__") - 1 + F.greatest("ahead__", F.lit(0))
    n, beyond = probed.agg(F.count("*"), F.count_if(at >= modulus)).first()
    if n > modulus and refuse:
        raise ValueError(f"{n} keys for {modulus} ids")
    new_id = F.when(F.lit(n <= modulus), (F.col("nth__") - 1 + F.greatest("ahead__", F.lit(beyond))) % modulus)
    return probed.withColumn("new_id", new_id).drop("hash__", "nth__", "ahead__")


def content_checksum(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (n, checksum) of a table: the sums of both halves of its rows' MD5 digests, whatever their order.

    Any changed value, and any row more, less or twice, changes it. Columns are compared as strings, null apart from
    empty: those whose string form differs between stores are to be made strings before. No rows: 0 and "0:0".
    """
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.replace(F.col(c).cast("string"), F.lit("\x1f"), F.lit("\x1f\x1f"))), F.lit("-")) for c in columns)))
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return rows.agg(F.count("*").alias("n"), F.concat_ws(":", half(1), half(16)).alias("checksum"))
