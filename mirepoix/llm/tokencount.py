"""Document lengths in flat token files without an index, by a scan for the end-of-document token."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.llm.common import settled, slices
from mirepoix.llm.packing import byte_encoding

END_ID = 50256


def read_blocks(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = 1 << 18, run: int = 32) -> DataFrame:
    """(file, block, payload) of the flat token files at path: each file's bytes, cut every block_tokens tokens.

    Spark lists the files' names and sizes alone; runs of `run` blocks are dealt to tasks, which read just their ranges,
    a block at a time, so files may have any size. Executors open the files through pyarrow's file systems, so path
    must be one of a scheme that these know (local or mounted folders, HDFS, S3, GCS). An empty file has no blocks.
    """
    size = block_tokens * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    last = F.expr(f"(length - 1) div {size * run}")
    n_runs = files.agg(F.coalesce(F.sum(last + 1), F.lit(0))).first()[0]
    runs = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("run"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name, length, nth in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(name) as file:
                    file.seek(nth * run * size)
                    for block in range(nth * run, min((nth + 1) * run, -(-length // size))):
                        data = file.read(min(size, length - block * size))
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "payload"])

    # by number: the listing is small, so that AQE would else put all ranges in one task
    return runs.repartition(max(1, min(n_runs, max(spark.sparkContext.defaultParallelism, n_runs // 8)))).mapInArrow(batches, "file string, block long, payload binary")


def opened(name: str) -> pa.NativeFile:
    """A file for reading at any place, by its path as Spark writes it (file:/a, hdfs://host/a)."""
    scheme, rest = name.split(":", 1)
    files, path = FileSystem.from_uri(f"{scheme}://{quote('/' + rest.lstrip('/') if scheme == 'file' else rest[2:], safe='/:@')}")
    return files.open_input_file(path)


def token_blocks(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", block_tokens: int = 1 << 18) -> DataFrame:
    """(file, block, payload, doc_ids): each partition of docs as one flat file of 16-bit ids, END_ID after each document.

    doc_ids names the documents that end in a block, in order: what a file's writer can keep beside it. Special
    strings in a text are ordinary text here, so END_ID only ends documents. A null text is an empty one.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, file, block = byte_encoding(vocabulary), f"part-{TaskContext.get().partitionId():06d}", 0
        held, names, size = [], [], 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, names, size, block
            ids = np.concatenate(held)
            ends = int((ids[:n] == END_ID).sum())
            row = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([ids[:n].tobytes()], pa.binary()), pa.array([names[:ends]], pa.list_(kind))], names=["file", "block", "payload", "doc_ids"])
            held, names, size, block = [ids[n:]], names[ends:], size - n, block + 1
            return row

        for batch in stream:
            kind = batch.schema.field(0).type
            for key, x in ((k, t) for part in slices(batch, 1) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                ids = np.append(encoding.encode_to_numpy(x or "", disallowed_special=()), np.uint32(END_ID)).astype("<u2")
                held.append(ids)
                names.append(key)
                size += len(ids)
                while size >= block_tokens:
                    yield cut(block_tokens)
        if size:
            yield cut(size)

    kind = docs.select(doc_id).dtypes[0][1]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, f"file string, block long, payload binary, doc_ids array<{kind}>")


def document_lengths(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2", names: str | None = None, run: int = 1024) -> DataFrame:
    """(file, ordinal, start, n_tokens[, name]) of each document in the blocks' files.

    blocks: (file, block, payload), payload the tokens from block to block of a file; documents end with end_id, which
    doesn't count to n_tokens, and may span blocks. What a file has after its last end_id is a last document of its
    own. start: tokens of the file before the document. Each block is searched by itself; what it knows (tokens, ends)
    goes up in a prefix scan over the file's blocks, in two levels of `run` blocks, so that no task scans a whole
    file. names: a column of blocks with an array of names for the documents that end there; an unended one's is
    null. Empty payloads count as no tokens; a file without tokens has no documents; no blocks: no rows.
    """
    extra = [names] if names else []
    kind = dict(blocks.dtypes)["file"]
    name_type = f", names {dict(blocks.dtypes)[names]}" if names else ""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            tokens, ends = [], []
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_buffer(), dtype=dtype) if payload.is_valid else np.zeros(0, dtype)
                tokens.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(tokens, pa.int64()), pa.array(ends, pa.list_(pa.int64())), *batch.columns[3:]], names=["file", "block", "tokens", "ends", *(["names"] if names else [])])

    # what the scan found is read several times below; the tokens themselves are read once
    found = settled(blocks.select("file", "block", "payload", *extra).mapInArrow(batches, f"file {kind}, block long, tokens long, ends array<long>{name_type}"), "ends")
    scanned = _prefix(found.withColumn("n_ends", F.size("ends")), run)
    keep = ["names"] if names else []
    # the end before a block's first: the last one of the blocks before it
    documents = scanned.select("file", "tokens_before", "ends_before", "last_end", *keep, F.posexplode("ends").alias("nth", "end"), "ends")
    at = F.col("tokens_before") + F.col("end")
    start = F.when(F.col("nth") > 0, F.col("tokens_before") + F.expr("try_element_at(ends, nth)") + 1).otherwise(F.coalesce(F.col("last_end") + 1, F.lit(0)))
    name = [F.get("names", F.col("nth")).alias("name")] if names else []
    whole = documents.select("file", (F.col("ends_before") + F.col("nth")).alias("ordinal"), start.alias("start"), (at - start).alias("n_tokens"), *name)
    ended = F.when(F.col("n_ends") > 0, F.col("tokens_before") + F.element_at("ends", -1))
    last = scanned.groupBy("file").agg(F.max(F.col("tokens_before") + F.col("tokens")).alias("all"), F.max(F.coalesce(ended, F.lit(-1))).alias("end"), F.sum("n_ends").alias("ordinal"))
    rest = last.where("all > end + 1").select("file", "ordinal", (F.col("end") + 1).alias("start"), (F.col("all") - F.col("end") - 1).alias("n_tokens"), *([F.lit(None).cast(dict(blocks.dtypes)[names][6:-1]).alias("name")] if names else []))
    return whole.unionByName(rest)


def _prefix(found: DataFrame, run: int) -> DataFrame:
    """found with tokens_before, ends_before and last_end (place of the last end before), over the blocks before in its file."""
    runs = found.withColumn("run", F.floor(F.col("block") / run))
    within = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    local = runs.withColumn("t", F.coalesce(F.sum("tokens").over(within), F.lit(0))).withColumn("e", F.coalesce(F.sum("n_ends").over(within), F.lit(0)))
    local = local.withColumn("own_end", F.when(F.col("n_ends") > 0, F.col("t") + F.element_at("ends", -1))).withColumn("l", F.max("own_end").over(within))
    total = local.groupBy("file", "run").agg(F.sum("tokens").alias("rt"), F.sum("n_ends").alias("re"), F.max("own_end").alias("rl"))
    before = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    total = total.withColumn("bt", F.coalesce(F.sum("rt").over(before), F.lit(0))).withColumn("be", F.coalesce(F.sum("re").over(before), F.lit(0)))
    total = total.withColumn("bl", F.max(F.col("bt") + F.col("rl")).over(before)).select("file", "run", "bt", "be", "bl")
    return local.join(total, ["file", "run"]).select(*found.columns, (F.col("t") + F.col("bt")).alias("tokens_before"), (F.col("e") + F.col("be")).alias("ends_before"), F.coalesce(F.col("l") + F.col("bt"), "bl").alias("last_end"))


def document_token_counts(docs: DataFrame, vocabulary: str, block_tokens: int = 1 << 18) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal, start) of each document, found in the flat token files of docs.

    A null text is empty and has no tokens; null and repeated doc_ids keep their rows, each a document of its own;
    other columns are ignored. A text may be of any size; those of over a megabyte are tokenised one by one. No docs:
    no rows.
    """
    found = document_lengths(token_blocks(docs, vocabulary, block_tokens=block_tokens), names="doc_ids")
    return found.select(F.col("name").alias("doc_id"), "n_tokens", "file", "ordinal", "start")
