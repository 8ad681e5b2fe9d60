"""Edge-table graph operators: closures, exclusions through paths, common ancestors, three-state roll-ups, rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.operators.scans import checkpointed


def closure(edges: DataFrame, child: str, parent: str, depth: int) -> DataFrame:
    """(desc, anc, depth): each node's ancestors up to `depth` edges away by their least distance, itself at 0.

    A bounded number of joins of the frontier with the edges; nodes that only occur as parents are there too.
    """
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct()
    nodes = e.select("c").union(e.select("p")).distinct()
    level = nodes.select(F.col("c").alias("desc"), F.col("c").alias("anc"))
    found = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(e, level.anc == e.c).select("desc", F.col("p").alias("anc")).distinct()
        found = found.union(level.withColumn("depth", F.lit(d)))
    return found.groupBy("desc", "anc").agg(F.min("depth").alias("depth"))


def reachable(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(desc, anc, depth): all ancestors of each node by their least distance, itself at 0, however deep and with cycles.

    Each round doubles the distance: who is exactly k edges up is joined with who is up to k edges above that, and the
    pairs that no earlier round has are kept and written, once each. It ends when nobody is k edges up: as many rounds
    as the longest shortest path has binary digits. Null ends are no edges; no edges: no rows.

    All joins are of sorted shuffles: both sides grow with the edges, and each one that is just small enough to be
    broadcast would pass through the driver in every round, several times as large as its rows.
    """
    e = checkpointed(edges.select(F.col(child).alias("desc"), F.col(parent).alias("anc")).where("desc is not null and anc is not null").distinct())
    nodes = e.select("desc").union(e.select("anc")).distinct()
    found = checkpointed(nodes.select("desc", F.col("desc").alias("anc"), F.lit(0).alias("depth")).union(e.where("desc != anc").withColumn("depth", F.lit(1))))
    last, k = found, 1
    while not (at_k := last.where(F.col("depth") == k)).isEmpty():
        above = found.where("depth > 0").select(F.col("desc").alias("mid"), F.col("anc").alias("top"), F.col("depth").alias("more"))
        ahead = at_k.join(above.hint("merge"), F.col("anc") == F.col("mid")).groupBy("desc", F.col("top").alias("anc")).agg((F.min("more") + k).alias("depth"))
        last = checkpointed(ahead.join(found.hint("merge"), ["desc", "anc"], "left_anti").select("desc", "anc", "depth"))
        found, k = found.union(last), 2 * k
    return found


def derived_groups(members: DataFrame, closed: DataFrame, groups: DataFrame, item: str, node: str, facet: str = "food_groups", method: str = "taxonomy_derived") -> DataFrame:
    """(item, evidence) for each item and group that an ancestor of one of its nodes stands for, with where that comes from.

    members: (item, node); closed: (desc, anc, ...); groups: (anc, group), classes that stand for a group. evidence: a
    struct of facet, value (the group), method, confidence (1, as nothing is guessed), the classes and the nodes that
    gave it, both sorted. Items without any such ancestor have no row: that is a gap, not a finding.
    """
    named = closed.join(groups.select("anc", "group"), "anc").select(F.col("desc").alias(node), "anc", "group").distinct()
    found = members.select(item, node).distinct().join(named, node).groupBy(item, "group").agg(F.sort_array(F.collect_set("anc")).alias("classes"), F.sort_array(F.collect_set(node)).alias("nodes"))
    return found.select(item, F.struct(F.lit(facet).alias("facet"), F.col("group").alias("value"), F.lit(method).alias("method"), F.lit(1.0).alias("confidence"), "classes", "nodes").alias("evidence"))


def merged_evidence(*sources: DataFrame) -> DataFrame:
    """(node, label, sources, terms) of several (node, label, source, term): one row a node and label, both lists sorted, a null term none."""
    rows = reduce(DataFrame.unionByName, (s.select("node", "label", "source", "term") for s in sources))
    return rows.groupBy("node", "label").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_set("term")).alias("terms"))


def having_all(edges: DataFrame, item: str, predicates: list[Column]) -> DataFrame:
    """Items that for each predicate have an edge which fulfils it (relational division), in one aggregation."""
    hits = edges.groupBy(item).agg(*(F.bool_or(p).alias(f"p{i}") for i, p in enumerate(predicates)))
    return hits.where(reduce(lambda a, b: a & b, (F.col(f"p{i}") for i in range(len(predicates))), F.lit(True))).select(item)


def common_ancestor(pairs: DataFrame, a: str, b: str, closed: DataFrame, depth: int) -> DataFrame:
    """pairs with `related`: whether both have an ancestor within depth; null if either has no place in the taxonomy."""
    near = closed.where(F.col("depth") <= depth).select("desc", "anc")
    known = closed.where("depth = 0").select("desc")
    left, right = near.toDF(a, "anc__"), near.toDF(b, "anc__")
    hits = pairs.select(a, b).distinct().join(left, a).join(right, [b, "anc__"]).select(a, b).distinct().withColumn("hit__", F.lit(True))
    out = pairs.join(known.toDF(a).withColumn("known_a__", F.lit(True)), a, "left").join(known.toDF(b).withColumn("known_b__", F.lit(True)), b, "left").join(hits, [a, b], "left")
    related = F.when(F.col("known_a__").isNull() | F.col("known_b__").isNull(), None).otherwise(F.coalesce("hit__", F.lit(False)))
    return out.select(*pairs.columns, related.alias("related"))


def sibling_groups(nodes: DataFrame, node: str, closed: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(node, group, distance) and (group, member): each node's nearest ancestor that another of `nodes` has, too, at most depth up.

    closed: (desc, anc, depth); of equally near ancestors the least counts. Two rows a node and ancestor at most, never
    the pairs of a group. Nodes without such an ancestor have no row.
    """
    up = nodes.select(F.col(node).alias("desc")).distinct().join(closed.where(F.col("depth").between(1, depth)), "desc")
    size = up.groupBy("anc").agg(F.count_distinct("desc").alias("n"))
    shared = up.join(size.where("n > 1"), "anc")
    nearest = shared.groupBy("desc").agg(F.min_by("anc", F.struct("depth", "anc")).alias("group"), F.min("depth").alias("distance"))
    return nearest.select(F.col("desc").alias(node), "group", "distance"), shared.select(F.col("anc").alias("group"), F.col("desc").alias("member")).distinct()


def nearest_siblings(nodes: DataFrame, node: str, closed: DataFrame, depth: int) -> DataFrame:
    """(node, sibling, distance): the groups of sibling_groups written out as pairs; for few nodes."""
    nearest, members = sibling_groups(nodes, node, closed, depth)
    return nearest.join(members, "group").where(F.col("member") != F.col(node)).select(node, F.col("member").alias("sibling"), "distance")


def first_sibling(nodes: DataFrame, node: str, closed: DataFrame, depth: int) -> DataFrame:
    """(node, sibling, distance): the least other member of each node's nearest group, from the two least of each group."""
    nearest, members = sibling_groups(nodes, node, closed, depth)
    first = members.groupBy("group").agg(F.min("member").alias("first"))
    second = members.join(first, "group").where("member != first").groupBy("group").agg(F.min("member").alias("second"))
    two = first.join(second, "group")
    return nearest.join(two, "group").select(node, F.when(F.col("first") != F.col(node), F.col("first")).otherwise(F.col("second")).alias("sibling"), "distance")


def three_state(edges: DataFrame, item: str, status: str) -> DataFrame:
    """(item, status, n, n_blocking, n_unknown): not_suitable if any component is, suitable if all are, else unknown."""
    missing = F.coalesce(F.col(status), F.lit("unknown"))
    counts = edges.groupBy(item).agg(F.count("*").alias("n"), F.count_if(missing == "not_suitable").alias("n_blocking"), F.count_if(missing == "suitable").alias("n_suitable"))
    verdict = F.when(F.col("n_blocking") > 0, "not_suitable").when((F.col("n") > 0) & (F.col("n_suitable") == F.col("n")), "suitable").otherwise("unknown")
    return counts.select(item, verdict.alias("status"), "n", "n_blocking", (F.col("n") - F.col("n_blocking") - F.col("n_suitable")).alias("n_unknown"))


def repointed(edges: DataFrame, end: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """edges with `end` replaced by its mapping, all properties kept; edges that become equal are one."""
    joined = edges.join(mapping.select(F.col(old).alias(end), F.col(new).alias("new__")), end, "left")
    return joined.withColumn(end, F.coalesce("new__", end)).drop("new__").select(edges.columns).distinct()


def collisions(edges: DataFrame, item: str, end: str, mapping: DataFrame, old: str, new: str, k: int = 3, parts: int | None = None) -> DataFrame:
    """(old, new, n_items, examples): items with edges to both ends of a replacement, and the k smallest of them.

    An edge meets the replacements that its end is in, as their old or their new; what has both is counted, without a
    join of edges with edges. parts: into how many parts edges are dealt; without it, as the session says.
    """
    spread = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    pairs = mapping.select(old, new).distinct()
    roles = pairs.select(F.col(old).alias(end), old, new, F.lit(1).alias("role__")).union(pairs.select(F.col(new), old, new, F.lit(2)))
    met = spread(edges.select(item, end), end).join(roles.withColumnRenamed(end, "end__"), F.col(end) == F.col("end__")).select(item, old, new, "role__")
    both = spread(met, item, old, new).groupBy(item, old, new).agg(F.bit_or("role__").alias("roles__")).where(f"roles__ = 3 and {item} is not null").drop("roles__")
    ranked = both.withColumn("nth__", F.row_number().over(W.partitionBy(old, new).orderBy(item)))
    return ranked.groupBy(old, new).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("nth__") <= k, F.col(item)))), ",").alias("examples"))


def orphans(nodes: DataFrame, node: str, references: list[tuple[DataFrame, str]]) -> DataFrame:
    """Nodes that none of the edge tables refers to."""
    return reduce(lambda left, ref: left.join(ref[0].select(F.col(ref[1]).alias(node)), node, "left_anti"), references, nodes)
