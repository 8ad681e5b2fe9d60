"""Allergen declarations and suitability of foods, from their evidence, their classes and their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.functions import suitability as S

INFERRED = "inferred_ingredient_presence"
FIELDS = ["presence", "evidence_status", "sources", "classes", "terms"]


def suitability(items: DataFrame, evidence: DataFrame, closed: DataFrame, item: str, name: str, rules: Sequence[S.Rule] = S.RULES) -> DataFrame:
    """(item, group, status, reasons, sources): what the rules tell of each food; no row where they tell nothing, which is unknown.

    items: (item, name), one row each, a null name as none; evidence: (item, allergen, sources), of which only those
    with a trusted source count; closed: (desc, anc, ...) of graph.reachable, whose desc are items: their own classes and all
    above. Of classes only those that rules name are gathered, so that a food's lists stay as short as the rules.
    What is known of foods is as long as items, so it is joined by sorted shuffles, never broadcast through the driver.
    """
    wanted = sorted({r for rule in rules for r in (*rule.roots, *rule.good_roots)})
    trusted = F.arrays_overlap("sources", F.array(*map(F.lit, S.TRUSTED)))
    told = evidence.where(trusted & F.col("allergen").isNotNull()).groupBy(item).agg(F.sort_array(F.collect_set("allergen")).alias("allergens__"))
    above = closed.where(F.col("anc").cast("string").isin(wanted)).groupBy(F.col("desc").alias(item)).agg(F.sort_array(F.collect_set(F.col("anc").cast("string"))).alias("roots__"))
    none = F.array().cast("array<string>")
    known = items.select(item, F.coalesce(name, F.lit("")).alias("name__")).join(told.hint("merge"), item, "left").join(above.hint("merge"), item, "left")
    known = known.select(item, "name__", F.coalesce("allergens__", none).alias("allergens__"), F.coalesce("roots__", none).alias("roots__"))
    verdicts = F.array_compact(F.array(*(S.verdict(rule, F.col("name__"), F.col("allergens__"), F.col("roots__")) for rule in rules)))
    return known.select(item, F.inline(verdicts))


def declared(stored: DataFrame, evidence: DataFrame, item: str, version: str, now: str) -> DataFrame:
    """stored's columns and outcome (created, updated, unchanged, stale, kept): declarations brought up to the evidence.

    stored: (declaration_id, item, allergen, declaration_type, classification_version, presence, evidence_status,
    sources, classes, terms, created_at, updated_at); evidence: (item, allergen, sources, classes, terms and, where
    stated, presence and evidence_status), one row an item and allergen. Each becomes a declaration under an id of item,
    allergen and version; missing lists are empty, missing sources `legacy`. What is stored under this version as
    inferred and has no evidence any more is stale, to be deleted; other versions and kinds are kept. created_at stays
    from the first time; updated_at is `now` where anything changed.
    """
    has = lambda c, default: F.coalesce(c, default) if c in evidence.columns else default
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    sources = F.when(F.size(listed("sources")) > 0, F.col("sources")).otherwise(F.array(F.lit("legacy")))
    id_ = F.concat_ws(":", F.lit("ingredient"), F.col(item).cast("string"), F.lit("allergen"), "allergen", F.lit("version"), F.lit(version))
    new = evidence.where(F.col(item).isNotNull() & F.col("allergen").isNotNull()).select(
        id_.alias("id__"), F.col(item).alias("item__"), F.col("allergen").alias("allergen__"),
        F.struct(has("presence", F.lit("contains")).alias("presence"), has("evidence_status", F.lit("inferred")).alias("evidence_status"), sources.alias("sources"), listed("classes").alias("classes"), listed("terms").alias("terms")).alias("new__"),
    )
    joined = stored.join(new, F.col("declaration_id") == F.col("id__"), "full_outer")
    here, told = F.col("declaration_id").isNotNull(), F.col("id__").isNotNull()
    same = F.struct(*FIELDS).eqNullSafe(F.struct(*(F.col(f"new__.{f}").alias(f) for f in FIELDS)))
    ours = (F.col("classification_version") == version) & (F.col("declaration_type") == INFERRED)
    # a stored row without an id has no partner either
    outcome = F.when(told & ~here, "created").when(told & same, "unchanged").when(told, "updated").when(F.coalesce(ours, F.lit(False)), "stale").otherwise("kept")
    changed = told & (~here | ~same)
    values = {f: F.when(told, F.col(f"new__.{f}")).otherwise(F.col(f)) for f in FIELDS} | {
        "declaration_id": F.coalesce("declaration_id", "id__"), item: F.coalesce(item, "item__"), "allergen": F.coalesce("allergen", "allergen__"),
        "declaration_type": F.when(told, INFERRED).otherwise(F.col("declaration_type")), "classification_version": F.when(told, version).otherwise(F.col("classification_version")),
        "created_at": F.when(told & ~here, now).otherwise(F.col("created_at")), "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
    }
    return joined.select(*(values[c].alias(c) if c in values else F.col(c) for c in stored.columns), outcome.alias("outcome"))
