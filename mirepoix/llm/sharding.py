"""A uniform random shuffle into shards of exact sizes, through a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.llm.common import gapless, settled


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are among `good` of good + bad, for populations of any size.

    By inversion: the law's ratios from one value to the next, summed up from its mode outwards to where what is left
    is less than a double can tell (13 standard deviations); no approximation by another law.
    """
    least, most = max(0, n - bad), min(n, good)
    if least == most:
        return least
    whole = good + bad
    mode = min(max((n + 1) * (good + 1) // (whole + 2), least), most)
    reach = int(13 * (n * (good / whole) * (bad / whole) * ((whole - n) / max(1, whole - 1))) ** 0.5) + 40
    k = np.arange(max(least, mode - reach), min(most, mode + reach) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) * ((n - k[:-1]) / ((k[:-1] + 1) * (bad - n + k[:-1] + 1))))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    upto = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[np.searchsorted(upto, rng.random() * upto[-1], side="right").clip(max=len(k) - 1)])


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> np.ndarray:
    """How many rows each source sends to each shard: a draw from the law that a uniform permutation of all rows has.

    Source by source, a multivariate hypergeometric draw from the places that are still free in the shards: shard by
    shard, how many of the source's rows go there rather than to a later one. Rows sum to the sources, columns to the
    shards, exactly.
    """
    if sum(sources) != sum(shards):
        raise ValueError("sources and shards differ in their rows")
    rng, free = np.random.default_rng(seed), [int(s) for s in shards]
    matrix = np.zeros((len(sources), len(shards)), dtype=np.int64)
    for i, left in enumerate(map(int, sources)):
        later = sum(free)
        for j, places in enumerate(free):
            later -= places
            matrix[i, j] = sent = hypergeometric(rng, places, later, left)
            free[j] -= sent
            left -= sent
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def shuffled(rows: DataFrame, shards: int = 8, seed: int = 0, rows_per_source: int = 100_000) -> DataFrame:
    """rows with shard (0 to shards - 1, counts at most one apart) and slot (place in its shard, gapless from 0).

    All rows are dealt to sources of about `rows_per_source` by a hash of their place in the input; the driver draws
    the matrix of how many rows each source sends to each shard, a few numbers for each source. Each source permutes
    its rows and sends the first of them to shard 0, and so on; each shard permutes what it has received. Both
    permutations are orders of keyed hashes, so equal inputs, files and settings give equal shuffles; shards are
    numbered in runs, none in a single task. Every column of rows is kept, whatever it holds, nulls and repeated rows
    too; shard and slot must not be among them. Fewer rows than shards leave some empty; no rows give no rows.
    """
    bad = {"shard", "slot"} & set(rows.columns)
    if bad:
        raise ValueError(f"columns clash with results: {sorted(bad)}")
    spark, whole = rows.sparkSession, F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")  # no name of theirs meets ours
    placed = settled(rows.select(whole, F.monotonically_increasing_id().alias("place")), "unshuffled")
    n = placed.count()
    sources = max(1, -(-n // rows_per_source))
    dealt = placed.withColumns({"source": F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(sources)), "first": F.xxhash64("place", F.lit(seed + 1)), "second": F.shiftrightunsigned(F.xxhash64("place", F.lit(seed + 2)), 2)})
    held = dict(dealt.groupBy("source").count().collect())
    counts = [held.get(i, 0) for i in range(sources)]
    upto = communication_matrix(counts, even_sizes(n, shards), seed).cumsum(axis=1)
    plan = spark.createDataFrame([(i, [int(x) for x in upto[i]]) for i in range(sources)], "source long, upto array<long>")
    local = dealt.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("first", "place")) - 1)
    sent = local.join(plan, "source").withColumn("shard", F.size(F.filter("upto", lambda c: c <= F.col("rank"))))
    numbered = gapless(sent.select("row", "place", "second", "shard"), ["shard"], F.col("second"), "slot", rows_per_source, F.col("place"))
    return numbered.select("row.*", "shard", "slot")


def shuffled_digests(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32 (a null text's is the empty one's), law, shard, slot, grown_shard."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"))
    return shuffled(rows, shards, seed).select("*", F.lit(None).cast("int").alias("grown_shard"))
