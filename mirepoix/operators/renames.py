"""Rename maps: chains resolved by pointer jumping, cycles reported, collisions found before they are applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.operators.scans import checkpointed


def resolved(renames: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(old, final, status): the name that following the renames of each old name ends at; status `final`, or `cycle` and a null final.

    Of several renames of a name the least new one counts; renames to itself and with nulls are none. Each round
    doubles the steps that every name has gone, so a chain of n renames takes log2(n) rounds; names that are still on
    their way when a round ends no chain lead into a cycle. No renames: no rows.
    """
    step = renames.select(F.col(old).alias("old"), F.col(new).alias("at")).where("old is not null and at is not null and old != at").groupBy("old").agg(F.min("at").alias("at"))
    gone, open_before = checkpointed(step), -1
    while True:
        ahead = gone.select(F.col("old").alias("key__"), F.col("at").alias("next__"))
        gone = checkpointed(gone.join(ahead, F.col("at") == F.col("key__"), "left").select("old", F.coalesce("next__", "at").alias("at"), F.col("key__").isNotNull().alias("open")))
        open_now = gone.where("open").count()
        if open_now in (0, open_before):
            break
        open_before, gone = open_now, gone.select("old", "at")
    return gone.select("old", F.when(~F.col("open"), F.col("at")).alias("final"), F.when(F.col("open"), "cycle").otherwise("final").alias("status"))


def applied(edges: DataFrame, plan: DataFrame, item: str, name: str) -> DataFrame:
    """(item, name, was) of edges (item, name): each under its final name, those of a cycle and without a rename under their own."""
    final = plan.where("status = 'final'").select(F.col("old").alias("old__"), F.col("final").alias("final__"))
    joined = edges.select(item, name).distinct().join(final, F.col(name) == F.col("old__"), "left")
    return joined.select(item, F.coalesce("final__", name).alias(name), F.col(name).alias("was"))


def collisions(edges: DataFrame, plan: DataFrame, item: str, name: str) -> DataFrame:
    """(item, name, n_names): the items that several names of would become one, with how many. To look at before applying."""
    return applied(edges, plan, item, name).groupBy(item, name).agg(F.count("*").alias("n_names")).where("n_names > 1")
