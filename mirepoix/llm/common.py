"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode alone, one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="mirepoix-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: lineage ends there, and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch, text: int | pa.Array, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of up to `rows` rows whose texts (or column number `text`) have up to `size` bytes; longer texts alone."""
    texts = batch.column(text) if isinstance(text, int) else text
    upto = np.concatenate([[0], np.cumsum(np.array(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))])
    at = 0
    while at < batch.num_rows:
        to = min(max(at + 1, int(np.searchsorted(upto, upto[at] + size, side="right")) - 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers live on from stage to stage, and so would their peaks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def unsigned_hex(value: Column) -> Column:
    """A 64-bit value as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def gapless(df: DataFrame, groups: list[str], order: Column, column: str, rows_per_run: int = 100_000, spread: Column | None = None) -> DataFrame:
    """Adds `column`, numbering the rows of each group from 0 without gaps in an order that `order` fixes.

    `order` must be an unsigned-looking uniform 62-bit long (a hash) or any long in [0, 2**62): its range is cut in
    runs of about `rows_per_run` rows, each numbered in a task of its own and then moved up by the rows of the runs
    before it, so that no task holds a whole group. Ties in `order` are broken by `spread`.
    """
    from pyspark.sql import Window as W

    total = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    runs = max(1, min(1 << 20, -(-total // rows_per_run)))
    run, key = f"{column}__run", f"{column}__key"
    cut = df.withColumn(key, order).withColumn(run, F.floor(F.col(key) / F.lit((1 << 62) // runs)))
    counts = cut.groupBy(*groups, run).agg(F.count("*").alias(f"{column}__n"))
    before = W.partitionBy(*groups).orderBy(run).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*groups, run, F.coalesce(F.sum(f"{column}__n").over(before), F.lit(0)).alias(f"{column}__start"))
    tie = [spread] if spread is not None else []
    within = W.partitionBy(*groups, run).orderBy(key, *tie)
    numbered = cut.withColumn(column, F.row_number().over(within).cast("long") - 1)
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*groups, run]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return numbered.alias("l").join(F.broadcast(starts).alias("r") if runs <= 4096 else starts.alias("r"), cond, "left").select(
        *[F.col(f"l.{c}") for c in df.columns if c != column], (F.col(f"l.{column}") + F.col(f"r.{column}__start")).alias(column)
    )
