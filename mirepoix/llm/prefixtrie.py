"""The trie of conversations' prefixes: how many share each, and what storing a shared turn once saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.llm.common import settled
from mirepoix.operators.scans import running

NODE = ["depth", "x1", "x2"]
HEAD_MODULUS, HEAD_LENGTHS = 5, 9


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, bytes): each turn's number in its conversation from 1, its identity and its text's UTF-8 bytes.

    Turns follow their number, null first, and equal numbers the role and the identity. A null role or text is empty;
    rows without a conv_id are left out. The identity is the MD5 of role and text; the texts themselves go no further.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text)))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), key.alias("turn_key"), F.octet_length(text).cast("long").alias("bytes"))
    return running(rows, ["conv_id"], ["turn", "role", "turn_key"], {"pos": ("sum", F.lit(1))}).select("conv_id", "pos", "turn_key", "bytes")


def with_shared_heads(turns: DataFrame, modulus: int = HEAD_MODULUS, lengths: int = HEAD_LENGTHS) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt: a conversation c begins with the first h turns of c - c % modulus, h being crc32(c) % lengths.

    Its own turns follow from the one after its h-th. turns: (conv_id, depth, turn_key, bytes, last), the depth from 1;
    conversations: (conv_id, length) with those of no turns. For negative ids % has the sign of the id.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % lengths).alias("h")
    donor = (F.col("conv_id") - F.col("conv_id") % modulus).alias("donor")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h, donor)
    lent = own.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    taken = F.least("h", F.coalesce("donor_n", F.lit(0)))
    plan = settled(own.join(lent, "donor", "left").select("conv_id", "donor", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    first = turns.where((F.col("pos") < lengths) & (F.col("conv_id") % modulus == 0)).withColumnRenamed("conv_id", "donor")
    heads = first.join(plan, "donor").where("pos <= taken").withColumn("depth", F.col("pos"))
    tails = turns.join(plan, "conv_id").where("pos > h").withColumn("depth", F.col("taken") + F.col("pos") - F.col("h"))
    named = ["conv_id", "depth", "turn_key", "bytes", (F.col("depth") == F.col("length")).alias("last")]
    return heads.select(*named).union(tails.select(*named)), plan.select("conv_id", "length")


def prefix_nodes(turns: DataFrame, conversations: DataFrame, rows_a_window: int = 50_000) -> DataFrame:
    """A row for each distinct prefix of conversations' turns, the empty one included, named by its smallest member and its depth.

    turns: (conv_id, depth from 1 without gaps, turn_key, bytes, last: whether it is its conversation's last);
    conversations: (conv_id, length), those without turns too. No conversations: no rows, not even the root.

    Returns conv_id, depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. A prefix is known by its depth and the XOR of two 64-bit hashes of its turns with their places.

    The smallest member of a prefix is that of all longer prefixes it has, so each conversation owns a suffix of its
    path. Windows find the owners, in two steps, so that a prefix that all share is in no one task. One group-by of
    prefixes then sums for each member the bytes from its turn there to the first that it owns, which are those that an
    owner stores for it, and whether it owns a leaf or a child.
    """
    mixed = lambda seed: F.xxhash64(F.lit(seed), "depth", "turn_key")
    ran = running(turns, ["conv_id"], ["depth"], {"x1": ("xor", mixed(1)), "x2": ("xor", mixed(2)), "upto": ("sum", F.col("bytes"))})
    path = ran.select("conv_id", F.col("depth").cast("long").alias("depth"), "x1", "x2", F.col("x1").bitwiseXOR(mixed(1)).alias("p1"), F.col("x2").bitwiseXOR(mixed(2)).alias("p2"), (F.col("upto") - F.col("bytes")).alias("before"), "bytes", "last")
    none = F.lit(0).cast("long")
    roots = conversations.select("conv_id", none.alias("depth"), none.alias("x1"), none.alias("x2"), none.alias("p1"), none.alias("p2"), none.alias("before"), none.alias("bytes"), (F.col("length") == 0).alias("last"))
    path = settled(path.union(roots), "trie-path")

    shares = max(1, -(-path.count() // rows_a_window))
    owned = path.select("conv_id", *NODE, "before", "last", (~F.col("last")).alias("deeper"), F.pmod(F.xxhash64("conv_id"), F.lit(shares)).alias("share"))
    for of in ([*NODE, "share"], NODE):
        least = F.row_number().over(W.partitionBy(*of).orderBy("conv_id"))
        owned = owned.withColumns({"nth": least, "deeper": F.max("deeper").over(W.partitionBy(*of))}).where("nth = 1")
    ends = path.where("last")
    owned = owned.select("conv_id", "depth", "before", (F.col("last") & ~F.col("deeper")).alias("leaf"))
    beyond = ends.select("conv_id", (F.col("depth") + 1).alias("depth"), (F.col("before") + F.col("bytes")).alias("before"), F.lit(False).alias("leaf"))
    owners = owned.union(beyond).groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.min("before").alias("own_before"), F.max("leaf").alias("leaf"))

    members = path.join(owners, "conv_id")
    total = lambda c: F.sum(c.cast("long"))
    nodes = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.count("*").alias("n_convs"),
        total((F.col("own_from") <= F.col("depth") + 1) & ~F.col("last")).alias("n_children"),
        total(F.col("leaf")).alias("n_leaves"),
        total(F.greatest(F.col("own_before") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    nodes = settled(nodes, "trie-nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    digests = end_digests(ends.select(*NODE, "conv_id"))
    whole = nodes.join(parents, ["depth", "p1", "p2"], "left").join(digests, NODE, "left")
    empty = hashlib.sha256().hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def end_digests(ends: DataFrame, ids_a_piece: int = 4096) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of (depth, x1, x2, conv_id): the digest of a node's ids in ascending order, comma-joined.

    Ids are sorted and joined in ranges, so that a node with any number of them is spread over tasks; only the joined
    pieces of a node meet in one task, which feeds them to the digest one by one, as SHA-256 requires.
    """

    def joined(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, rows = None, [], []
        for batch in stream:
            for *at, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (at != node or len(ids) == ids_a_piece):
                    rows.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = at
                ids.append(conv_id)
            if len(rows) > 1000:
                yield _batch(rows, [*kinds, pa.string()], [*NODE, "first", "ids"])
                rows = []
        if ids:
            rows.append((*node, ids[0], ",".join(map(str, ids))))
        yield _batch(rows, [*kinds, pa.string()], [*NODE, "first", "ids"])

    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, rows = None, None, []
        for batch in stream:
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    rows.append((*node, digest.hexdigest()))
                node, digest = at, hashlib.sha256(ids.encode())
            if len(rows) > 1000:
                yield _batch(rows, [*kinds[:3], pa.string()], [*NODE, "ends_sha256"])
                rows = []
        if node:
            rows.append((*node, digest.hexdigest()))
        yield _batch(rows, [*kinds[:3], pa.string()], [*NODE, "ends_sha256"])

    kinds = [pa.int64()] * 4
    pieces = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(joined, "depth long, x1 long, x2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, x1 long, x2 long, ends_sha256 string")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def shared_head_trie(conversations: DataFrame) -> DataFrame:
    """The prefix nodes of conversations that begin with turns of one in five of them (see with_shared_heads).

    conversations: (conv_id, turn, role, text) and any other columns, which are not used. Repeated rows are turns of
    their own; null conv_ids are left out; an empty table has no nodes.
    """
    turns = settled(ordered_turns(conversations), "trie-turns")
    return prefix_nodes(*with_shared_heads(turns))


_CRC = """xor(list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ord(substr(c::VARCHAR, i::INT, 1))::BIGINT),
  lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""
ORACLE = f"""WITH turns AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT c, turns, {_CRC} % 9 AS h FROM turns),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS path FROM headed a LEFT JOIN turns b ON b.c = a.c - a.c % 5),
members AS (SELECT c, d, path[1:d] AS prefix, len(path) = d AS ended FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256 FROM members GROUP BY prefix, d),
under AS (SELECT n.conv_id, n.d, p.prefix AS up, p.d AS up_d, n.n, n.prefix, CASE WHEN n.d > 0 THEN (n.n - 1) * strlen(n.prefix[n.d].t) ELSE 0 END AS saved, NOT EXISTS (FROM nodes k WHERE k.d = n.d + 1 AND k.prefix[1:n.d] = n.prefix) AS leaf
  FROM nodes n JOIN (SELECT c, unnest(range(0, len(path) + 1)) AS k, path FROM rebuilt) r ON r.c = n.conv_id AND r.k <= n.d JOIN nodes p ON p.d = r.k AND p.prefix = r.path[1:r.k])
SELECT p.conv_id, p.d AS depth, o.conv_id AS parent_conv_id, p.n AS n_convs, u.n_children, u.n_leaves, u.saved_tokens, p.ends_sha256
FROM nodes p LEFT JOIN nodes o ON o.d = p.d - 1 AND o.prefix = p.prefix[1:p.d - 1]
JOIN (SELECT up, up_d, count(*) FILTER (d = up_d + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM under GROUP BY ALL) u ON u.up = p.prefix AND u.up_d = p.d"""
