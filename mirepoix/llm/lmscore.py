"""Language-model scores: the difference of cross-entropies under a target and a background model of word pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.common import give_back, settled

#: What a text is read for: to count it in one model or both, to be scored.
BACKGROUND, TARGET, SCORED = 1, 2, 4
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_CUT = re.compile(rb"[ \t-\r]").search
_BYTE, _LEFT, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_START = np.uint64(0x5DEECE66D)
_SEGMENT, _RUN = 4 << 20, 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return (x ^ (x >> np.uint64(27))) * _LEFT


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of each word: what lies between ASCII white space, A-Z in lower case."""
    b = np.frombuffer(data.lower(), np.uint8)
    inside = ~_SPACE[b]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])[: len(b)])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.arange(len(b)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(b)]])))
    place[~inside] = 0
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()), _BYTE)]))
    return _mixed(np.add.reduceat(np.where(inside, b + np.uint64(1), np.uint64(0)) * powers[place], starts)), starts


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers, byte plane by byte plane, compressed: planes that are all zero cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _segments(text: bytes) -> Iterator[tuple[bytes, np.uint64]]:
    """(segment, hash of the word before it) of a text, cut at white space where it is over _SEGMENT bytes."""
    at, before = 0, _START
    while at == 0 or at < len(text):
        cut = _CUT(text, at + _SEGMENT) if len(text) - at > _SEGMENT else None
        part = text[at : cut.end()] if cut else text[at:]
        yield part, before
        at += max(1, len(part))
        if cut:
            before = ([before, *word_hashes(part)[0][-1:]])[-1]


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(block, ids, payload): rows (doc_id, text, sides) in blocks of about block_bytes of text.

    payload: an Arrow stream of (row, doc_id, sides, before, text), a row for each segment; ids: their doc_ids.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, block, size = TaskContext.get().partitionId() << 33, 0, 0, 0
        held: list[tuple] = []

        def emitted() -> pa.RecordBatch:
            nonlocal held, size, block
            columns = list(zip(*held))
            inner = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), kind, pa.int8(), pa.uint64(), pa.large_binary()))], names=["row", "doc_id", "sides", "before", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, inner.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_batch(inner)
            whole = pa.RecordBatch.from_arrays([pa.array([part + block]), pa.array([columns[1]], pa.list_(kind)), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "ids", "payload"])
            held, size, block = [], 0, block + 1
            return whole

        for batch in stream:
            kind = batch.schema.field(0).type
            texts = batch.column(1).cast(pa.large_binary())
            for key, text, sides in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                for segment, before in _segments(text.as_py() or b""):
                    held.append((part + row, key, sides, int(before), segment))
                    size += len(segment) + 64
                    if size >= block_bytes:
                        yield emitted()
                row += 1
        if held:
            yield emitted()

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "text", "sides").mapInArrow(batches, f"block long, ids array<{kind}>, payload binary")


class Block:
    """The words and word pairs of a block: each distinct key once, sorted, and where each word's are among them.

    Keys are 64-bit hashes of words (odd) and of pairs of a word and the one before it (even; a text's first word
    comes after a start). Words or pairs of equal hash count as one.
    """

    def __init__(self, payload: bytes):
        self.table = pa.ipc.open_stream(payload).read_all()
        texts = self.table.column("text").to_pylist()
        upto = np.cumsum([0, *(len(x) + 1 for x in texts)])
        words, segment = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + _RUN)) - 1)
            found, starts = word_hashes(b"\n".join(texts[at:to]))
            words.append(found)
            segment.append(np.searchsorted(upto, starts + upto[at], side="right") - 1)
            at = to
        w, self.segment = np.concatenate(words), np.concatenate(segment)
        self.n = len(w)
        first = np.flatnonzero(np.diff(self.segment, prepend=-1))
        before = np.array(self.table.column("before"), dtype=np.uint64)[self.segment[first]]
        h = np.concatenate([w[:1], w[:-1]])
        h[first] = before
        start = before == _START
        context = np.where(start, _START << np.uint64(1), _mixed(before) | np.uint64(1))
        keys = np.concatenate([_mixed(w) | np.uint64(1), _mixed(h * _LEFT + w) & ~np.uint64(1), context])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.word, self.pair = place[: self.n], place[self.n : 2 * self.n]
        self.context = np.concatenate([self.word[:1], self.word[:-1]])
        self.context[first] = place[2 * self.n :]
        self.starts, self.first = place[2 * self.n :][start], first[start]

    def counts(self, sides: np.ndarray, side: int) -> np.ndarray:
        """How often each key occurs in the segments read for a side."""
        here = (sides[self.segment] & side) > 0
        at = np.concatenate([self.word[here], self.pair[here], self.starts[here[self.first]]])
        return np.bincount(at, minlength=len(self.keys))


def _sent(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, keys, background, target): what each block asks of each part of the keys, and what it counts there.

    hits: places of the segments that count for the target too.
    """
    edges = np.array([-(-p * (1 << 32) // parts) << 32 for p in range(parts)], dtype=np.uint64)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for number, payload, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                block = Block(payload.as_buffer())
                sides = np.array(block.table.column("sides"), dtype=np.int64)
                sides[np.array(hits or [], dtype=np.int64)] |= TARGET
                counts = [block.counts(sides, s) for s in (BACKGROUND, TARGET)]
                cuts = np.append(np.searchsorted(block.keys, edges), len(block.keys))
                rows = []
                for p in np.flatnonzero(np.diff(cuts)):
                    a, b = cuts[p], cuts[p + 1]
                    rows.append((p, number, _packed(np.diff(block.keys[a:b], prepend=np.uint64(0))), *(_packed(c[a:b]) for c in counts)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "block", "keys", "background", "target"])
        give_back()

    return blocks.select("block", "payload", "hits").mapInArrow(batches, "part int, block long, keys binary, background binary, target binary")


def _answered(group: pa.Table) -> pa.Table:
    """For each block that asks a part: both counts of its keys over all blocks; once a part: its words and their totals."""
    keys = [np.cumsum(_unpacked(k)) for k in group.column("keys").to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = [np.bincount(place, np.concatenate([_unpacked(c) for c in group.column(side).to_pylist()]), minlength=len(distinct)).astype(np.uint64) for side in ("background", "target")]
    ends = np.cumsum([len(k) for k in keys])
    found = [[_packed(t[place[b - len(k) : b]]) for k, b in zip(keys, ends)] for t in totals]
    words = [int(((distinct & np.uint64(1) == 1) & ((totals[0] > 0) | (totals[1] > 0))).sum())] + [int(t[distinct & np.uint64(1) == 1].sum()) for t in totals]
    n = group.num_rows
    return pa.table({
        "block": pa.array([*group.column("block").to_pylist(), None], pa.int64()), "part": pa.array([*group.column("part").to_pylist(), None], pa.int32()),
        "background": pa.array([*found[0], None], pa.binary()), "target": pa.array([*found[1], None], pa.binary()),
        **{name: pa.array([None] * n + [w], pa.int64()) for name, w in zip(("words", "n_background", "n_target"), words)},
    })


def _losses(blocks: DataFrame, answers: DataFrame, totals: tuple[int, int, int], weight: float) -> DataFrame:
    """(row, doc_id, n, target, background): each segment's number of words and sums of their negative log probabilities."""
    v, *sizes = totals

    def scored(asked: pa.Table, found: pa.Table) -> pa.Table:
        block, found = Block(asked.column("payload")[0].as_buffer()), found.sort_by("part")
        segments = block.table.num_rows
        lowest = None
        sums = {}
        for side, size in (("background", sizes[0]), ("target", sizes[1])):
            c = np.concatenate([np.zeros(0), *(_unpacked(x) for x in found.column(side).to_pylist())]).astype(np.float64)
            if lowest is None:
                lowest = one = (c[block.word] + 1) / (size + v + 1)
            else:
                one = (c[block.word] + weight * lowest) / (size + weight)
            two = (c[block.pair] + weight * one) / (c[block.context] + weight)
            sums[side] = np.bincount(block.segment, -np.log(two), minlength=segments)
        wanted = pa.array((np.array(block.table.column("sides")) & SCORED) > 0)
        n = np.bincount(block.segment, minlength=segments)
        out = pa.table([block.table.column("row"), block.table.column("doc_id"), pa.array(n), *(pa.array(sums[x], pa.float64()) for x in ("target", "background"))], names=["row", "doc_id", "n", "target", "background"])
        give_back()
        return out.filter(wanted)

    kind = dict(blocks.dtypes)["ids"][6:-1]
    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, f"row long, doc_id {kind}, n long, target double, background double")


def _scores(rows: DataFrame, good: DataFrame | None, weight: float, block_bytes: int, part_words: int) -> DataFrame:
    blocks = settled(_blocks(rows, block_bytes), "blocks")
    hits = blocks.select("block", F.posexplode("ids").alias("hits", "of"))
    if good is None:
        hits = hits.where(F.lit(False)).groupBy("block").agg(F.collect_list("hits").alias("hits"))
    else:
        hits = hits.join(good.toDF("of").distinct().hint("shuffle_hash"), "of", "left_semi").groupBy("block").agg(F.collect_list("hits").alias("hits"))
    size = blocks.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    asked = _sent(blocks.join(hits.hint("shuffle_hash"), "block", "left"), max(1, size // (2 * part_words)))
    answers = settled(asked.groupBy("part").applyInArrow(_answered, "block long, part int, background binary, target binary, words long, n_background long, n_target long"), "answers")
    totals = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "n_background", "n_target"))).first()
    parts = _losses(blocks, answers.where("block is not null").select("block", "part", "background", "target"), tuple(totals), weight)
    sums = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n", "target", "background")))
    mean = lambda total: F.when(F.col("n") > 0, F.round(total / F.col("n"), 6))
    target, background = F.col("target"), F.col("background")
    return sums.select("doc_id", F.col("n").alias("n_tokens"), mean(target).alias("target_loss"), mean(background).alias("background_loss"), mean(target - background).alias("score"))


def scored(docs: DataFrame, target: DataFrame, background: DataFrame, doc_id: str = "doc_id", text: str = "text", weight: float = 5.0, block_bytes: int = 6 << 20, part_words: int = 600_000) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of docs.

    Tokens are a text's words; a loss is the mean of their negative log probabilities; score is the mean of each
    token's target loss less its background loss: the lower, the more like the target (Moore and Lewis, 2010). A null
    text, or one without words, has no tokens and null losses. Null and repeated doc_ids keep their rows; other columns are
    ignored, whatever their names; no docs: no rows.

    Both models are of the words and pairs of all texts of their side, with one vocabulary and one smoothing: a pair's
    probability is (count + weight * P(word)) / (count of the word before + weight), what its context lacks to 1 being
    the text's end. P(word) is (count + 1) / (words + distinct words + 1) in the background and (count + weight *
    background's P) / (words + weight) in the target, so that a word of no model has one probability in both, and
    without a target both are equal for single words.

    Counts grow with the corpus and are never in one place: texts are dealt to blocks of `block_bytes`; each sends
    its distinct words and pairs, as sorted hashes, to parts of the hash range of about `part_words` words; a part adds
    up all blocks' counts and sends each what it asked for. Long texts are cut at white space and put together again.
    """
    rows = lambda df, sides: df.select((F.col(doc_id) if sides == SCORED else F.lit(None).cast(dict(docs.dtypes)[doc_id])).alias("doc_id"), F.col(text).alias("text"), F.lit(sides).cast("byte").alias("sides"))
    return _scores(rows(docs, SCORED).union(rows(background, BACKGROUND)).union(rows(target, TARGET)), None, weight, block_bytes, part_words)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", weight: float = 5.0, block_bytes: int = 6 << 20, part_words: int = 600_000) -> DataFrame:
    """`scored` with the documents that are labelled 1 as the target and all documents as the background.

    Texts are read once for both; the labels meet the blocks' lists of doc_ids. No such document: an empty target.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.lit(BACKGROUND | SCORED).cast("byte").alias("sides"))
    good = labels.where((F.col(label) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id))
    return _scores(rows, good, weight, block_bytes, part_words)
