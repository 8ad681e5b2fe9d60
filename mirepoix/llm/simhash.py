"""Near-duplicate documents by SimHash fingerprints, joined through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.blocks import in_blocks
from mirepoix.llm.common import give_back, settled, slices, unsigned_hex
from mirepoix.llm.components import connected_components
from mirepoix.llm.lmscore import word_hashes

_BLOCK = 1 << 15


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if it is set in over half the XXH64 of its word shingles.

    A-Z are lower-cased; words lie between ASCII white space; shingles are `words` words joined by spaces, repeats
    included. Fewer words than that: their whole sequence is the one shingle. Null or no word: 0.
    """
    w = (text or b"").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    n = max(1, len(w) - words + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text, as a signed long."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in slices(whole, 1)):
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), words, seed) for x in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.select(doc_id).dtypes[0][1]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, f"doc_id {kind}, fp long")


class VantageTree:
    """The upper levels of a vantage-point tree over 32-bit values, fitted on a sample.

    Every inner node has a vantage value and a distance mu; values within mu of it go inside, the others outside.
    `route` gives each value its home leaf. By the triangle inequality a value inside can only have a neighbour
    within `radius` outside if it is itself over mu - radius from the vantage; it then also visits the outer
    subtree as a guest, and a guest descends into every side that its distance bounds do not exclude. So each
    pair within `radius` meets in exactly one leaf: where the one is at home and the other at home or a guest.
    """

    def __init__(self, sample: np.ndarray, leaves: int, radius: int, seed: int = 7):
        self.radius, self.nodes, self.leaves = radius, [], 0
        self._rng = np.random.default_rng(seed)
        self._least = max(8, len(sample) // max(1, leaves))
        self._grow(sample)

    def _grow(self, values: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        split = best_split(values, self.radius, self._rng) if len(values) > self._least else None
        if split is None:
            self.nodes[at] = (self.leaves,)
            self.leaves += 1
        else:
            vantage, mu, d = split
            self.nodes[at] = (vantage, mu, self._grow(values[d <= mu]), self._grow(values[d > mu]))
        return at

    def route(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, positions of its residents, positions of its guests), for each leaf that gets any."""
        todo = [(0, np.arange(len(values)), np.arange(0))]
        while todo:
            at, home, guest = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                if len(home) or len(guest):
                    yield node[0], home, guest
                continue
            (h_in, g_in), (h_out, g_out) = descend(values, home, guest, node[0], node[1], self.radius)
            todo += [(node[2], h_in, g_in), (node[3], h_out, g_out)]


def best_split(values: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 6):
    """(vantage, mu, distances): of some random vantages, that whose boundary has the fewest values; None if none splits."""
    best = None
    for vantage in rng.choice(values, min(tries, len(values)), replace=False):
        d = np.bitwise_count(values ^ vantage)
        mu = int(np.median(d))
        if mu == d.max():
            mu = int(d.max()) - 1
        inside = int((d <= mu).sum())
        if 0 < inside < len(d):
            cost = ((d > mu - radius) & (d <= mu + radius)).mean() + abs(inside / len(d) - 0.5)
            if best is None or cost < best[0]:
                best = (cost, vantage, mu, d)
    return best and best[1:]


def descend(values, home, guest, vantage, mu, radius):
    """One step down: ((residents, guests) inside, (residents, guests) outside)."""
    d, e = (np.bitwise_count(values[i] ^ vantage).astype(np.int16) for i in (home, guest))
    cross = home[(d <= mu) & (d > mu - radius)]
    return (home[d <= mu], guest[e <= mu + radius]), (home[d > mu], np.concatenate([guest[e > mu - radius], cross]))


class Forest:
    """Smallest-member labels of the positions 0..n-1 under links that are added in bulk."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Adds links; returns which of them join what was apart: a spanning forest of them, earlier ones first."""
        used, at = [], np.arange(len(a))
        while True:
            la, lb = self.label[a[at]], self.label[b[at]]
            apart = la != lb
            at, la, lb = at[apart], la[apart], lb[apart]
            if not len(at):
                return np.concatenate(used) if used else at
            upper, lower = np.maximum(la, lb), np.minimum(la, lb)
            _, first = np.unique(upper, return_index=True)  # each group joins a smaller one by its earliest link
            used.append(at[first])
            self.label[upper[first]] = lower[first]
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long binaries, of whole 64-bit words, as rows of these words."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = whole.cast(pa.large_binary())
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return np.ascontiguousarray(data).view("<u8").reshape(len(whole), -1)


def local_links(band: np.ndarray, prints: np.ndarray, role: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): linked rows, a spanning forest of the links in one block. role: 0 guest, 1 partner of guests only, 2 resident.

    Residents are compared with each other and with all guests, partners with guests only. The tree over `band` is
    carried on below the shard, on random vantages, to leaves of a few hundred; there, rows within `bits` of each other
    are linked if their prints, rows of 64-bit words, are within `radius`, the nearer ones first.
    """
    rng, forest = np.random.default_rng(11), Forest(len(band))
    todo, kept = [(np.flatnonzero(role), np.flatnonzero(role == 0))], []
    while todo:
        home, guest = todo.pop()
        if not len(home) or not len(guest) and not (role[home] == 2).any():
            continue
        split = best_split(band[home], bits, rng, 3) if len(home) > 384 else None
        if split is not None:
            todo += descend(band, home, guest, split[0], split[1], bits)
            continue
        against = np.concatenate([home[role[home] == 2], guest])
        for at in range(0, len(home), 256):
            rows = home[at : at + 256]
            for to in range(0, len(against), 1024):
                cols = against[to : to + 1024]
                i, j = np.nonzero(np.bitwise_count(band[rows][:, None] ^ band[cols][None, :]) <= bits)
                i, j = rows[i], cols[j]
                apart = forest.label[i] != forest.label[j]  # what is linked already needs no second proof
                i, j = i[apart], j[apart]
                # two partners are never compared, a partner and a resident never share a block
                distance = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64)
                linked = np.argsort(distance, kind="stable")[: int((distance <= radius).sum())]
                joining = linked[forest.link(i[linked], j[linked])]
                kept.append((i[joining], j[joining]))
    if not kept:
        return np.arange(0), np.arange(0)
    return tuple(np.concatenate(x) for x in zip(*kept))  # type: ignore[return-value]


def band_links(prints: DataFrame, bits: int, radius: int, shard_rows: int = 2048, sample_rows: int = 1 << 20) -> DataFrame:
    """(a, b) edges between nodes that a chain of links joins, from prints (node long, search binary, check binary).

    Two nodes are linked if any 32-bit band of `search` differs in at most `bits` bits and `check` in at most `radius`.
    There is one vantage-point tree for each band, where so small a distance prunes well. The trees' upper levels are
    fitted on a hash sample of up to `sample_rows` nodes, eight for each leaf, and have a leaf for each `shard_rows`
    nodes; every node is routed. A leaf with far more rows is cut into pairs of chunks, so that no task holds it
    whole; each block returns a spanning forest of its links, pairs that are linked themselves, but never all of them.
    Nodes must not repeat.
    """
    n = prints.count()
    leaves = max(1, -(-n // shard_rows))
    share = min(0.5, min(sample_rows, max(16384, 8 * leaves)) / max(1, n))
    sample = prints.where(F.pmod(F.xxhash64("search", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))).select("search").limit(2 * sample_rows).toArrow()
    bands = matrix(sample.column(0)).view("<u4") if sample.num_rows else np.zeros((0, 1), "<u4")
    trees = [VantageTree(bands[:, t], leaves, bits, 7 + t) for t in range(bands.shape[1])] if sample.num_rows else []
    shared = prints.sparkSession.sparkContext.broadcast(trees)

    def routed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            values = matrix(batch.column(1)).view("<u4")
            known = shared.value or [VantageTree(values[:0, 0], 1, bits)] * values.shape[1]  # no sample: one leaf for all
            for t, tree in enumerate(known):
                parts = [(np.concatenate([home, guest]), np.full(len(home) + len(guest), len(known) * leaf + t), np.repeat([2, 0], [len(home), len(guest)])) for leaf, home, guest in tree.route(values[:, t])]
                at, shard, role = (np.concatenate(x) for x in zip(*parts))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(role.astype(np.int8)), batch.column(0).take(rows), pa.array(values[at, t].view(np.int32)), batch.column(2).take(rows)], names=["shard", "role", "node", "band", "check"])

    rows = prints.select("node", "search", "check").mapInArrow(routed, "shard int, role byte, node long, band int, check binary")
    return _joined(rows, bits, radius, 4 * shard_rows)


def _joined(rows: DataFrame, bits: int, radius: int, cap: int) -> DataFrame:
    def joined(group: pa.Table) -> pa.Table:
        a, b = local_links(np.array(group.column("band"), dtype=np.int32).view(np.uint32), matrix(group.column("check")), np.array(group.column("role")), bits, radius)
        node = np.array(group.column("node"))
        give_back()
        return pa.table({"a": node[a], "b": node[b]})

    placed = in_blocks(rows, ["shard"], "node", cap)
    return placed.groupBy("shard", "i", "j").applyInArrow(joined, "a long, b long")


def hamming_links(fps: DataFrame, radius: int = 3, **sizes: int) -> DataFrame:
    """(a, b) edges that join just the distinct 64-bit values of `fp` that a chain of distances <= radius joins.

    Values within `radius` bits agree within radius // 2 bits on their upper or on their lower 32 bits: these are the
    bands of `band_links`, so no pair is missed. fps: one row for each distinct value.
    """
    data = F.to_binary(unsigned_hex(F.col("fp")), F.lit("hex"))
    return band_links(fps.select(F.col("fp").alias("node"), data.alias("search"), data.alias("check")), radius // 2, radius, **sizes)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: component_id is the smallest doc_id that links of at most
    `radius` differing bits reach, its own included.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay repeated. A null doc_id
    keeps its row; it is nobody's component_id unless all of a component are null. Empty table: no rows. Other
    columns of docs are ignored.
    """
    each = settled(fingerprints(docs, doc_id, text, words, seed), "fingerprints")
    groups = each.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(hamming_links(groups.select("fp"), radius))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return each.join(of, "fp").select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


_ODD = np.random.default_rng(29).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_print(hashes: np.ndarray, words: int, wide: int) -> bytes:
    """A SimHash of `wide` 64-bit words over the shingles of `words` words, from the words' hashes.

    Fewer words than that: their whole sequence is the one shingle; none: all zero.
    """
    n = len(hashes)
    if not n:
        return bytes(8 * wide)
    words = min(words, n)
    shingles = np.zeros(n - words + 1, np.uint64)
    for k in range(words):
        shingles = shingles * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n - words + 1 + k]
    ones = np.zeros(64 * wide, np.int64)
    for at in range(0, len(shingles), 255):  # sums of up to 255 bits fit a byte
        x = shingles[at : at + 255, None] * _ODD[:wide]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        ones += np.unpackbits((x ^ (x >> np.uint64(32))).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes()


def print_radius(similarity: float, bits: int, deviations: float = 2.3) -> int:
    """Differing bits that 99 in 100 pairs of this shingle similarity (Jaccard, sets of equal size) stay within."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + deviations * np.sqrt(bits * p * (1 - p)))


def _text_key() -> list[Column]:
    """A text's identity: two 64-bit hashes."""
    return [F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))).alias(name) for seed, name in ((1, "x1"), (2, "x2"))]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of so many words; of fewer words, their whole sequence's."""
    hashes = word_hashes(text)[0]
    n = min(words, len(hashes))
    rolled = np.zeros(len(hashes) - n + 1 if n else 0, np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    return np.unique((rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


def confirmed(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose nodes' sets, (node, shingles: sorted distinct 64-bit numbers), have this Jaccard similarity or more."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (one, other))
                both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])
        give_back()

    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set"))
    return edges.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(batches, "a long, b long")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 12, wide: int = 4) -> DataFrame:
    """(doc_id, component_id) for each row: the smallest doc_id that links reach, where texts are linked whose sets of
    `words`-word shingles have a Jaccard similarity of `similarity` or more.

    Candidates agree within one bit on one of `bands` 32-bit bands of a SimHash over two-word shingles, which are found
    through vantage-point trees, and their SimHashes of 64 * `wide` bits over `words`-word shingles are within
    `print_radius`. Each block proposes a spanning forest of its candidates, the nearest first, and the shingle sets of
    each proposed pair are compared: no pair below the similarity is linked. Texts with the same prints are one. On the
    test documents about 0.9 of the pairs of similarity 0.8 or more share a band, and 99 in 100 are within the radius.

    A-Z are lower-cased; words lie between ASCII white space. Null and empty texts are similar to each other alone.
    Repeated rows stay repeated. A null doc_id keeps its row; it is nobody's component_id unless all of a component
    are null. Empty table: no rows. Other columns of docs are ignored.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, 1):
                made = []
                for x in batch.column(1).cast(pa.large_binary()):
                    hashes = word_hashes(x.as_py() or b"")[0]
                    made.append((wide_print(hashes, 2, bands // 2), wide_print(hashes, words, wide)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array(c, pa.binary()) for c in zip(*made))], names=["doc_id", "x1", "x2", "search", "check"])
        give_back()

    def shingled(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, 1):
                sets = [shingle_set(x.as_py() or b"", words).astype("<u8").tobytes() for x in batch.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
        give_back()

    kind = docs.select(doc_id).dtypes[0][1]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    each = settled(rows.select("doc_id", "text", *_text_key()).mapInArrow(batches, f"doc_id {kind}, x1 long, x2 long, search binary, check binary"), "wide-prints")
    groups = each.groupBy("search", "check").agg(F.min("doc_id").alias("first"), F.min(F.struct("x1", "x2")).alias("one"))
    groups = settled(groups.withColumn("node", F.monotonically_increasing_id()), "distinct-prints")
    edges = settled(band_links(groups, 1, print_radius(similarity, 64 * wide)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "proposed-links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups.select("node", "one.x1", "one.x2"), "node")
    texts = rows.select("text", *_text_key()).join(ends, ["x1", "x2"]).select("node", "text")
    sets = settled(texts.mapInArrow(shingled, "node long, shingles binary").groupBy("node").agg(F.any_value("shingles").alias("shingles")), "shingle-sets")
    roots = connected_components(settled(confirmed(edges, sets, similarity), "links"))
    rooted = groups.join(roots, "node", "left").select("search", "check", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("search", "check", "component_id")
    return each.join(of, ["search", "check"]).select("doc_id", "component_id")
