"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.common import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another node; root is the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) on the edge list, which both shrink the distance to the smallest node, until it is a set of
    stars. Each round is a few joins and aggregations; skewed hubs are left to AQE's skew join. Null ends and
    loops are no edges; repeated edges count once. No edges: no rows.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    e = checkpointed(e)
    state = _state(e)
    while state[0]:
        e = checkpointed(_small_star(_large_star(e)))
        state, last = _state(e), state
        if state == last:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()
