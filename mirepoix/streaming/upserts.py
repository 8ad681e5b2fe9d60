"""Streams of status and trace records: de-duplicated, windowed, and merged into a keyed table batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mirepoix.operators.merge import upserted


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, time: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark's delay: state older than that is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, keys, n) by tumbling windows; late events within the delay are counted."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def merge_into(events: DataFrame, table: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column], parts: int = 64) -> StreamingQuery:
    """Merges each micro-batch into the Parquet table by key: the first row in `order` of each key wins over the stored one.

    The table is cut into `parts` by a hash of the keys (a number that must stay as it is). Each batch writes new
    versions of the parts that its keys are in, under its own id, and reads those before it. A batch that is repeated
    after a failure replaces its own version from the same input, so each counts once. The newest versions are `latest`.
    A part's versions before its newest two are deleted: the newest but one is what a repeated batch reads, and what
    readers that listed the table before this batch still find.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        of = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        touched = [r[0] for r in batch.select(of.alias("part")).distinct().collect()]  # `parts` rows at most
        paths = [path for part, path in _newest(batch.sparkSession, table, batch_id).items() if part in touched]
        stored = batch.sparkSession.read.parquet(*paths) if paths else batch.limit(0)
        merged = upserted(stored, batch, keys, order).withColumn("part", of)
        merged.repartition("part").write.partitionBy("part").mode("overwrite").parquet(f"{table}/batch={batch_id:09d}")
        _forget(batch.sparkSession, table, batch_id, touched)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, table: str, batch_id: int, touched: Sequence[int]) -> None:
    """Deletes the versions of the touched parts before the newest one that is older than the batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # folders alone are listed: of the table, its batches, and of these only the parts that the batch has written
    batches = sorted(int(f.getPath().getName()[6:]) for f in files.listStatus(path(table)) if f.getPath().getName().startswith("batch="))
    older = [b for b in batches if b < batch_id]
    for part in touched:
        places = [path(f"{table}/batch={b:09d}/part={part}") for b in older]
        for place in [p for p in places if files.exists(p)][:-1]:
            files.delete(place, True)
    for b in older:
        folder = path(f"{table}/batch={b:09d}")
        if not any(f.getPath().getName().startswith("part=") for f in files.listStatus(folder)):
            files.delete(folder, True)


def _newest(spark: SparkSession, table: str, before: int = 1 << 62) -> dict[int, str]:
    """The folder of each part's newest version that is older than the batch `before`."""
    try:
        stored = spark.read.parquet(table).select(F.col("batch").cast("long"), "part").where(F.col("batch") < before)
        return {r.part: f"{table}/batch={r.batch:09d}/part={r.part}" for r in stored.groupBy("part").agg(F.max("batch").alias("batch")).collect()}
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return {}
        raise


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batches that the table's parts are from, in order: a batch's files only come to its folder when all are written."""
    return sorted({int(path.split("/batch=")[1].split("/")[0]) for path in _newest(spark, table).values()})


def latest(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(*_newest(spark, table).values())
