"""Keyed merges between a stored and a wanted table: diffs, upserts, reconciliation, partial updates, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _joined(have: DataFrame, want: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    left = have.select(F.struct("*").alias("h"), *keys)
    right = want.select(F.struct("*").alias("w"), *keys)
    return left.join(right, list(keys), how)


def changed(fields: Sequence[str], old: str = "h", new: str = "w") -> Column:
    """Whether any field differs, nulls being equal to each other."""
    different = F.lit(False)
    for f in fields:
        different = different | ~F.col(f"{new}.{f}").eqNullSafe(F.col(f"{old}.{f}"))
    return different


def diff_plan(have: DataFrame, want: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, action): insert, update, unchanged, or missing for what is stored but not wanted."""
    action = F.when(F.col("h").isNull(), "insert").when(F.col("w").isNull(), "missing").when(changed(fields), "update").otherwise("unchanged")
    return _joined(have, want, keys, "full").select(*keys, action.alias("action"))


def upserted(have: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """have with the first of each key's updates in `order` in the place of its row, new keys added."""
    latest = updates.withColumn("n__", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("n__ = 1").select(have.columns)
    return have.join(latest.select(*keys), list(keys), "left_anti").select(have.columns).unionByName(latest)


def inserted_missing(have: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """have and the rows of new whose keys it lacks (of repeated keys one row that sorts first by all columns)."""
    fresh = new.join(have.select(*keys), list(keys), "left_anti").select(have.columns)
    first = fresh.withColumn("n__", F.row_number().over(W.partitionBy(*keys).orderBy(*have.columns))).where("n__ = 1").drop("n__")
    return have.unionByName(first)


def patched(have: DataFrame, patch: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """have with the non-null fields of a patch over its own: nothing is overwritten with null."""
    joined = have.join(patch.select(*keys, *(F.col(f).alias(f"p__{f}") for f in fields)), list(keys), "left")
    return joined.select(*(F.coalesce(f"p__{c}", c).alias(c) if c in fields else F.col(c) for c in have.columns))


def patch_counts(have: DataFrame, patch: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, n_changed): how many rows a patch would change in each field."""
    joined = _joined(have, patch, keys, "inner")
    differs = lambda f: F.col(f"w.{f}").isNotNull() & ~F.col(f"w.{f}").eqNullSafe(F.col(f"h.{f}"))
    wide = joined.agg(*(F.count_if(differs(f)).alias(f) for f in fields))
    return wide.unpivot([], list(fields), "field", "n_changed")


def reconciled(owner: DataFrame, index: DataFrame, keys: Sequence[str], digest: str, stamp: str) -> DataFrame:
    """(keys, state): missing from the index, orphan in it, unstamped, stale, or in_sync."""
    state = (
        F.when(F.col("w").isNull(), "missing").when(F.col("h").isNull(), "orphan").when(F.col(f"w.{stamp}").isNull(), "unstamped").when(~F.col(f"h.{digest}").eqNullSafe(F.col(f"w.{digest}")), "stale").otherwise("in_sync")
    )
    return _joined(owner, index, keys, "full").select(*keys, state.alias("state"))


def audited(rows: DataFrame, field: str, value: Column, source: str, log: str = "enhancements") -> DataFrame:
    """rows with a new value of a field and, where it changes, (field, before, after, source) appended to the log."""
    entry = F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("before"), value.cast("string").alias("after"), F.lit(source).alias("source"))
    old = F.coalesce(F.col(log), F.array().cast(f"array<{entry_type()}>")) if log in rows.columns else F.array().cast(f"array<{entry_type()}>")
    new = F.when(~value.eqNullSafe(F.col(field)), F.array_append(old, entry)).otherwise(old)
    return rows.withColumns({log: new, field: value})


def entry_type() -> str:
    return "struct<field:string,before:string,after:string,source:string>"


def pending(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that a resumed batch still has to do."""
    return rows.join(done.select(*keys), list(keys), "left_anti")


def purged(rows: DataFrame, key: str, keep: Sequence) -> DataFrame:
    """rows with only the keys to keep; an empty list keeps nothing."""
    return rows.where(F.col(key).isin(*keep)) if keep else rows.where(F.lit(False))


def filled(rows: DataFrame, extra: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """rows with missing (null or blank) fields taken from extra; of repeated keys there the last by value counts."""
    one = extra.groupBy(key).agg(*(F.max(f).alias(f"e__{f}") for f in fields))
    return rows.join(one, key, "left").select(*(F.coalesce(F.nullif(c, F.lit("")), f"e__{c}").alias(c) if c in fields else F.col(c) for c in rows.columns))


def with_status(rows: DataFrame, asked: DataFrame, key: str, status: str, reason: str, default: str = "active") -> DataFrame:
    """rows with status and reason set where asked (key) names them, and outcome: updated, unchanged (they had it) or kept.

    A null status is the default. Ids that no row has come back as rows of their own with outcome not_found and nulls
    else; asked's nulls and repeats count for nothing.
    """
    wanted = asked.select(F.col(key).alias("asked__")).where("asked__ is not null").distinct()
    joined = rows.join(wanted, F.col(key) == F.col("asked__"), "full_outer")
    hit, there = F.col("asked__").isNotNull(), F.col(key).isNotNull()
    had = F.coalesce("status", F.lit(default))
    outcome = F.when(hit & ~there, "not_found").when(hit & (had == status), "unchanged").when(hit, "updated").otherwise("kept")
    changed = outcome == "updated"
    set_ = {"status": F.when(changed, status).when(there | ~hit, had), "reason": F.when(changed, reason).otherwise(F.col("reason")), key: F.coalesce(key, "asked__")}
    return joined.select(*(set_[c].alias(c) if c in set_ else F.col(c) for c in rows.columns), outcome.alias("outcome"))
