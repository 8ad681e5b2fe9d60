"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.bpe import byte_symbols
from mirepoix.llm.common import give_back, settled, slices

#: Splits a text before byte-level BPE; a fixed value of that public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def byte_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE in the file at path: a JSON file of the tokenizers library or a file of ranks; ids are the same."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """Token ids as uint32; special strings in the text become their special ids, as the tokenizers library has it."""
    return encoding.encode_to_numpy(text or "", allowed_special="all", disallowed_special=())


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids, then end_id, cut where there are over `capacity`.

    All pieces of a cut document have `capacity` ids but for its first, which has the rest. ids: little-endian
    unsigned 32-bit. A null text is empty and has one piece, the end_id. Null and repeated doc_ids keep their rows.
    vocabulary: path of the rank file, there on every executor.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_encoding(vocabulary)
        for whole in stream:
            for batch in slices(whole, 1):
                rows: list[tuple] = []
                for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.append(token_ids(encoding, x), np.uint32(end_id)).astype("<u4", copy=False)
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    rows += [(key, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()])], names=["doc_id", "piece", "start", "length", "ids"])
        give_back()

    kind = docs.select(doc_id).dtypes[0][1]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, f"doc_id {kind}, piece int, start long, length long, ids binary")


class OpenBins:
    """Bounded-space best fit: at most `most` open bins, found through a bitset with a bit for each free space.

    `put` places a length in the bin that it leaves the least space in, or in a new one, and returns (bin, offset,
    closed bins): a bin closes when it is full, and the fullest closes when there would be more than `most`.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.made = capacity, most, 0
        self.bits, self.by_free, self.count = 0, {}, 0

    def _push(self, free: int, bin_no: int) -> None:
        self.by_free.setdefault(free, []).append(bin_no)
        self.bits |= 1 << free
        self.count += 1

    def _pop(self, free: int) -> int:
        bins = self.by_free[free]
        bin_no = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.count -= 1
        return bin_no

    def put(self, length: int) -> tuple[int, int, list[int]]:
        closed = []
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_no = self._pop(free)
        else:
            free, bin_no = self.capacity, self.made
            self.made += 1
            if length < free and self.count >= self.most:
                closed.append(self._pop((self.bits & -self.bits).bit_length() - 1))
        if free == length:
            closed.append(bin_no)
        else:
            self._push(free - length, bin_no)
        return bin_no, self.capacity - free, closed


def pack(items: DataFrame, capacity: int = 1024, open_bins: int = 256, length: str = "length", rows_a_task: int = 50_000) -> DataFrame:
    """items with sequence_id and offset: as few sequences of at most `capacity` as a bounded-space best fit finds.

    Each partition packs its own rows in one pass without a shuffle. What is in bins that are still open when a
    partition ends, at most `open_bins` of them, is dealt to fewer tasks of up to `rows_a_task` rows in an order by
    hash and packed again in the same way, until one task packs the rest; so small or many partitions cost no
    sequences. offset: place in its sequence, gapless from 0. Items keep all their columns, among which sequence_id,
    offset and left_open must not be. Null lengths count as 0; one over capacity is refused. No items: no rows.
    """
    bad = {"sequence_id", "offset", "left_open"} & set(items.columns)
    if bad:
        raise ValueError(f"columns of items clash with results: {sorted(bad)}")
    done, todo, tasks, round_no = [], items, 1 << 30, 0
    while tasks > 1:
        placed = settled(_packed(todo, capacity, open_bins, length, round_no), "packed")
        done.append(placed.where("not left_open"))
        left, round_no = placed.where("left_open"), round_no + 1
        tasks = min(tasks // 2, max(1, -(-left.count() // rows_a_task)))
        todo = left.repartition(tasks, F.xxhash64("sequence_id", "offset")).select(*items.columns)
    done.append(_packed(todo, capacity, open_bins, length, round_no))
    return reduce(DataFrame.unionByName, done).select(*items.columns, "sequence_id", "offset")


def _packed(items: DataFrame, capacity: int, open_bins: int, length: str, round_no: int) -> DataFrame:
    names = items.columns

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = TaskContext.get().partitionId() << 38 | round_no << 32, OpenBins(capacity, open_bins)
        held: dict[int, list[tuple]] = {}
        ready: list[tuple] = []
        schema = None

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)
            ready.clear()
            return batch

        for batch in stream:
            schema = schema or pa.schema([*batch.schema, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left_open", pa.bool_())])
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                size = row[names.index(length)] or 0
                if not 0 <= size <= capacity:
                    raise ValueError(f"a length of {size} is outside 0 to {capacity}")
                bin_no, offset, closed = bins.put(size)
                held.setdefault(bin_no, []).append((*row, base + bin_no, offset))
                for b in closed:
                    ready += [(*r, False) for r in held.pop(b)]
            if len(ready) >= 2000:
                yield flushed()
        for rows in held.values():
            ready += [(*r, True) for r in rows]
            if len(ready) >= 2000:
                yield flushed()
        if ready:
            yield flushed()

    kinds = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    return items.mapInArrow(batches, f"{kinds}, sequence_id long, offset long, left_open boolean")


def packed_digests(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, open_bins: int = 256) -> DataFrame:
    """The packed pieces of all docs, each with the CRC-32 of its ids in the place of the ids.

    Null texts are empty, null and repeated doc_ids keep their rows, other columns are ignored; a text of over a
    megabyte is tokenised by itself, whole. No docs: no rows.
    """
    cut = pieces(docs, vocabulary, capacity, end_id)
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity, open_bins)
