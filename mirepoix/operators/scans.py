"""Running values in a total order, over rows that are cut in ranges: no task holds a whole key or the whole table."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How a running value is taken within a range, and joined with that of the ranges before it.
KINDS = {
    "sum": (F.sum, lambda carried, own: carried + own),
    "max": (F.max, F.greatest),
    "xor": (F.bit_xor, lambda carried, own: carried.bitwiseXOR(own)),
}


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage in the folder of spark.checkpoint.dir; in local mode alone, in one of our own where it is unset."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mirepoix-"))
    return df.checkpoint()


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """df with running values of each key's rows, in the order's, each row included.

    values: name -> (kind, expression), the kind one of "sum", "max" and "xor" and the expression never null; a sum of
    literal ones numbers the rows from 1. keys: columns that are not null; none: the whole table is one sequence.
    Nulls come first in the order unless it says otherwise; rows equal in it follow each other in any order.

    Rows are sorted into ranges over keys and order, so one key may lie in many ranges. Values run within a range, and
    what the earlier ranges of its key came to is added: that is one row for each range at most, and so is broadcast.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    cut = df.withColumn("scan__tie", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, "scan__tie")
    cut = checkpointed(cut.withColumn("scan__part", F.spark_partition_id()))
    here, of_key = [*keys, "scan__part"], W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    totals = cut.groupBy(*here).agg(*(KINDS[kind][0](value).alias(f"scan__{name}") for name, (kind, value) in values.items()))
    before = of_key.orderBy("scan__part").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*here, *(KINDS[kind][0](f"scan__{name}").over(before).alias(f"scan__{name}") for name, (kind, _) in values.items()))
    carried = carried.where(" and ".join(f"scan__{name} is not null" for name in values))
    within = W.partitionBy(*here).orderBy(*order, "scan__tie").rowsBetween(W.unboundedPreceding, 0)
    ran = cut.withColumns({name: KINDS[kind][0](value).over(within) for name, (kind, value) in values.items()})
    joined = ran.join(F.broadcast(carried), here, "left")
    done = {name: F.when(F.col(f"scan__{name}").isNull(), F.col(name)).otherwise(KINDS[kind][1](F.col(f"scan__{name}"), F.col(name))) for name, (kind, _) in values.items()}
    return joined.withColumns(done).select(*df.columns, *(name for name in values if name not in df.columns))
