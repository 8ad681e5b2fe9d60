"""Exact near-duplicate links between embeddings of one label, by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.blocks import GUEST, RESIDENT, in_blocks
from mirepoix.llm.common import settled
from mirepoix.llm.components import connected_components
from mirepoix.llm.simhash import Forest

_LEAF = 64


def chord(cosine: float) -> float:
    """Distance on the unit sphere of vectors at this cosine, with room for rounding."""
    return float(np.sqrt(2 - 2 * cosine)) + 1e-9


class Node:
    """A node of a cover tree: its members lie within `radius` of `centre`; children's radii halve from level to level."""

    __slots__ = ("centre", "children", "members", "radius")

    def __init__(self, x: np.ndarray, members: np.ndarray, level: float):
        self.centre, self.members, self.children = x[members[0]], members, []
        d = np.linalg.norm(x[members] - self.centre, axis=1)
        self.radius = float(d.max())
        if len(members) <= _LEAF or self.radius < 1e-6:
            return
        while level >= self.radius:
            level /= 2
        # a net of the level: each centre takes what is within it; what stays alone shares a leaf with others
        left, alone = members, []
        for _ in range(512):
            near = np.linalg.norm(x[left] - x[left[0]], axis=1) <= level
            own, left = left[near], left[~near]
            if len(own) > 1:
                self.children.append(Node(x, own, level))
            else:
                alone.append(own)
            if not len(left):
                break
        rest = np.concatenate([*alone, left])
        self.children += [Node(x, rest[at : at + _LEAF], level) for at in range(0, len(rest), _LEAF)]


def dual(a: list[Node], b: list[Node], reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(members, members, all linked) of the node pairs that covering radii can't rule out; all linked if they ensure it."""
    todo = [(a, b)]
    while todo:
        left, right = todo.pop()
        if not left or not right:
            continue
        gap = np.linalg.norm(np.array([n.centre for n in left])[:, None] - np.array([n.centre for n in right])[None], axis=2)
        radii = np.array([n.radius for n in left])[:, None] + np.array([n.radius for n in right])[None]
        for i, j in zip(*np.nonzero(gap - radii <= reach)):
            p, q = left[i], right[j]
            if gap[i, j] + radii[i, j] <= reach - 1e-6:
                yield p.members, q.members, True
            elif not p.children and not q.children:
                yield p.members, q.members, False
            elif p.children and (not q.children or p.radius >= q.radius):
                todo.append((p.children, [q]))
            else:
                todo.append(([p], q.children))


def block_links(x: np.ndarray, weight: np.ndarray, role: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of vectors linked to each row, smallest linked row) in one block.

    x: vectors of length one. role 2: residents, compared with each other and with guests; 1: partners, compared
    with guests only; 0: guests. Weights count the copies of a row.
    """
    links, forest, reach = np.zeros(len(x), np.int64), Forest(len(x)), chord(least)

    def join(rows: np.ndarray, cols: np.ndarray, linked: np.ndarray, both: bool) -> None:
        share = linked.astype(np.float64)
        links[rows] += (share @ weight[cols]).astype(np.int64)
        if both:
            links[cols] += (weight[rows] @ share).astype(np.int64)
        if len(np.unique(forest.label[np.concatenate([rows, cols])])) > 1:
            i, j = np.nonzero(linked)
            forest.link(rows[i], cols[j])

    def compare(rows: np.ndarray, cols: np.ndarray, sure: bool, both: bool) -> None:
        for at in range(0, len(rows), 1024):
            r = rows[at : at + 1024]
            for to in range(0, len(cols), 1024):
                c = cols[to : to + 1024]
                if sure:
                    linked = np.ones((len(r), len(c)), dtype=bool)
                else:
                    cosine = x[r] @ x[c].T
                    linked = cosine >= least
                    for i, j in zip(*np.nonzero(np.abs(cosine - least) < 1e-12)):
                        linked[i, j] = _cosine(x[r[i]], x[c[j]]) >= least
                if not both:
                    linked &= r[:, None] != c[None, :]
                join(r, c, linked, both)

    tree = lambda which: [Node(x, m, 2.0)] if len(m := np.flatnonzero(which)) else []
    residents, guests, homes = tree(role == 2), tree(role == 0), tree(role > 0)
    for rows, cols, sure in dual(residents, residents, reach):
        compare(rows, cols, sure, False)  # each pair comes in both orders
    for rows, cols, sure in dual(homes, guests, reach):
        compare(rows, cols, sure, True)
    return links, forest.label


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sum(a * b) / (np.sqrt(np.sum(a * a)) * np.sqrt(np.sum(b * b))))


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = np.array(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    flat /= np.abs(flat).max(axis=1, keepdims=True)  # squares of very large or small numbers would leave the doubles' range
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


class Covers:
    """The upper levels of the cover trees: for each large group the centres of nested nets with halving radii."""

    def __init__(self, sample: dict[str, np.ndarray], wanted: dict[str, int]):
        self.centres = {key: self._nets(x, wanted[key]) for key, x in sample.items()}
        self.radius = {key: np.zeros(len(net)) for key, net in self.centres.items()}

    @staticmethod
    def _nets(x: np.ndarray, wanted: int) -> np.ndarray:
        chosen, radius = [0], 2.0
        nearest = np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < wanted and radius > 0.05:
            radius /= 2
            while nearest.max() > radius and len(chosen) < wanted:
                chosen.append(int(nearest.argmax()))
                nearest = np.minimum(nearest, np.linalg.norm(x - x[chosen[-1]], axis=1))
        return x[chosen]

    def homes(self, key: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances to the group's centres, number of the nearest); a small group is one shard and has none."""
        net = self.centres.get(key)
        if net is None:
            return np.zeros((len(x), 1)), np.zeros(len(x), np.int64)
        gap = np.sqrt(np.maximum(0, 2 - 2 * x @ net.T))
        return gap, gap.argmin(axis=1)

    def guests(self, key, gap: np.ndarray, home: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of each shard after its own that a vector must visit to meet all its partners there.

        A partner in another shard is nearer to that shard's centre than to this one's and within that shard's covering
        radius: so the vector is within reach of the plane between both centres, and within radius and reach of the other's.
        """
        net = self.centres.get(key)
        if net is None or len(net) == 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = gap[np.arange(len(gap)), home][:, None]
        between = np.sqrt(np.maximum(0, 2 - 2 * net[home] @ net.T))
        near = (gap**2 - own**2 <= 2 * reach * between + 1e-6) & (gap <= self.radius[key] + reach + 1e-6)
        return np.nonzero(near & (np.arange(len(net))[None] > home[:, None]))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, shard_rows: int = 4096, sample_rows: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: how many other rows of equal label have a cosine of `least`
    or more to it, the smallest vec_id that such links reach (its own included), and whether that is its own.

    Null, empty and zero vectors, vectors with null or non-finite components and null labels link with nothing; neither
    do vectors of different lengths. Equal vectors are links of each other and are compared with others once. A row
    with a null vec_id is linked and counted, but gives its component no id unless there is no other. Other columns are
    ignored; no rows give no rows.

    Each label's distinct vectors are dealt to shards by their nearest centre in the upper levels of a cover tree, which
    are fitted on a hash sample of about `sample_rows` vectors; vectors near a boundary also visit the shards beyond it.
    In a shard, the trees are carried on and walked in pairs. A shard with far more than `shard_rows` rows is cut in
    pairs of chunks. Blocks return counts and spanning forests, never all pairs.
    """
    numeric = F.transform(F.col(embedding), lambda x: x + F.lit(0).cast("float"))
    given = rows.select(F.col(vec_id).alias("vec_id"), numeric.alias("vector"), F.col(label).alias("label"))
    usable = F.col("label").isNotNull() & F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    given = settled(given.withColumn("usable", usable), "vectors")
    distinct = given.where("usable").groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    distinct = settled(distinct.select("*", F.monotonically_increasing_id().alias("node"), F.concat_ws(":", F.size("vector"), F.col("label").cast("string")).alias("key")), "distinct-vectors")
    parts = _placed(distinct, least, shard_rows, sample_rows)
    found = settled(parts, "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = distinct.select("node", "label", "vector", "weight", "first").join(counts, "node", "left").join(roots, "node", "left")
    rooted = rooted.select("label", "vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(ids, "root").select("label", "vector", "n_links", "component_id")
    joined = given.where("usable").join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    single = given.where("not usable").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return joined.union(single).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _placed(distinct: DataFrame, least: float, shard_rows: int, sample_rows: int) -> DataFrame:
    """(node, links, root): partial link counts and spanning forests from each block."""
    spark, reach = distinct.sparkSession, chord(least)
    large = distinct.groupBy("key").count().where(F.col("count") > shard_rows)
    wanted = {r.key: -(-r["count"] // shard_rows) for r in large.collect()}  # a row for each shard_rows vectors at most
    share = min(0.5, sample_rows / max(1, distinct.count()))
    drawn = distinct.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample: dict[str, list] = {}
    for r in drawn.where(F.col("key").isin(list(wanted))).select("key", "vector").limit(2 * sample_rows).collect():
        sample.setdefault(r.key, []).append(r.vector)
    covers = Covers({key: _unit(pa.array(vectors)) for key, vectors in sample.items()}, wanted)

    def each(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        keys = np.array(batch.column("key").to_pylist())
        for key in np.unique(keys):
            at = np.flatnonzero(keys == key)
            yield str(key), at, _unit(batch.column("vector").take(pa.array(at)))

    first = spark.sparkContext.broadcast(covers)

    def radii(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for key, _, x in each(batch):
                gap, home = first.value.homes(key, x)
                far = np.zeros(gap.shape[1])
                np.maximum.at(far, home, gap[np.arange(len(gap)), home])
                shards = np.unique(home)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(shards)), pa.array(shards), pa.array(far[shards])], names=["key", "shard", "radius"])

    measured = distinct.where(F.col("key").isin(list(covers.centres))).select("key", "vector").mapInArrow(radii, "key string, shard long, radius double")
    for r in measured.groupBy("key", "shard").agg(F.max("radius").alias("radius")).collect():
        covers.radius[r.key][r.shard] = r.radius
    shared = spark.sparkContext.broadcast(covers)

    def routed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for key, at, x in each(batch):
                gap, home = shared.value.homes(key, x)
                row, shard = shared.value.guests(key, gap, home, reach)
                rows = pa.array(np.concatenate([at, at[row]]))
                role = np.repeat([RESIDENT, GUEST], [len(at), len(row)]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("key", "node", "weight", "vector")), pa.array(np.concatenate([home, shard])), pa.array(role)], names=["key", "node", "weight", "vector", "shard", "role"])

    kind = dict(distinct.dtypes)["vector"]
    rows = distinct.select("key", "node", "weight", "vector").mapInArrow(routed, f"key string, node long, weight long, vector {kind}, shard long, role byte")

    def joined(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = _unit(group.column("vector").chunk(0))
        node = np.array(group.column("node"))
        links, root = block_links(x, np.array(group.column("weight"), dtype=np.float64), np.array(group.column("role")), least)
        told = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
        return pa.table({"node": node[told], "links": links[told], "root": node[root[told]]})

    placed = in_blocks(rows, ["key", "shard"], "node", 2 * shard_rows)
    return placed.groupBy("key", "shard", "i", "j").applyInArrow(joined, "node long, links long, root long")
