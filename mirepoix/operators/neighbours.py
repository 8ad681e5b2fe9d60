"""The k nearest vectors of many queries, exactly: cells around centres, and a second look where a bound can't rule a cell out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.operators.report import top_n
from mirepoix.operators.scans import checkpointed

#: What rounding may take from a bound on an angle.
SLACK = 1e-6


def unit_rows(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, which vectors have one): null and zero vectors, and those with null or non-finite parts, have none."""
    width = next((len(v) for v in vectors if v is not None), 0)
    rows = np.array([np.zeros(width) if v is None or len(v) != width else np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), width)
    length = np.linalg.norm(rows, axis=1)
    good = np.isfinite(length) & (length > 0)
    return rows[good] / length[good, None], good


def _wide(vectors: pd.Series, width: int) -> np.ndarray:
    return np.array([v is not None and len(v) == width for v in vectors], dtype=bool)


def _in_blocks(ids: np.ndarray, rows: np.ndarray, at_row: np.ndarray, cell: np.ndarray, block: int) -> Iterator[pd.DataFrame]:
    """The queries of at_row with the cells they look into, `block` rows at once: a query may look into every cell."""
    for low in range(0, len(cell), block):
        of = at_row[low : low + block]
        yield pd.DataFrame({"query_id": ids[of], "v": list(rows[of]), "cell": cell[low : low + block].astype("int32")})


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", vector: str = "embedding", most_cells: int = 4096, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, similarity, nth): of each query the k vectors of largest cosine, in double precision; ties by vec_id.

    queries: (query_id, vector), vectors: (vec_id, vector), ids not null and not repeated; other columns are not used.
    Vectors without a direction (null, zero, not finite, of another width) are nobody's neighbour and have none.
    Fewer than k vectors: all of them. No queries or no vectors: no rows.

    Vectors lie in cells: each with the nearest of some centres, as many as the root of their number, 4,096 at most,
    which with their radii and sizes are all that goes through the driver. A query looks into the nearest cells that
    have k vectors; the k-th of these bounds what can still be nearer, and the cells whose angle less their radius is
    within that bound are looked into, too. Cells and the queries that look into them are cut in blocks by their
    numbers, so a task holds two of them.
    """
    spark = queries.sparkSession
    id_type = dict(vectors.dtypes)[vector_id]
    source = vectors.select(F.col(vector_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    n = source.count()
    wanted = max(1, min(most_cells, int(n**0.5)))
    drawn = source.where("v is not null").orderBy(F.xxhash64("vec_id")).limit(wanted).toPandas()["v"]
    centres, _ = unit_rows(drawn)
    result = f"query_id {dict(queries.dtypes)[query_id]}, vec_id {id_type}, similarity double"
    if not len(centres):
        return spark.createDataFrame([], f"{result}, nth int")

    def angles(rows: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(rows @ centres.T, -1.0, 1.0))

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part[_wide(part["v"], centres.shape[1])]
            for at in range(0, len(part), 512):
                some = part.iloc[at : at + 512]
                rows, good = unit_rows(some["v"])
                if len(rows):
                    angle = angles(rows)
                    yield pd.DataFrame({"vec_id": some["vec_id"][good].to_numpy(), "v": list(rows), "cell": angle.argmin(axis=1).astype("int32"), "angle": angle.min(axis=1)})

    cells = checkpointed(source.mapInPandas(placed, f"vec_id {id_type}, v array<double>, cell int, angle double").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // (wanted * block)))))))
    facts = cells.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).toPandas()  # a row a cell, 4,096 at most
    parts = int(cells.agg(F.max("part")).first()[0] or 0) + 1
    radius, size = np.full(len(centres), -np.inf), np.zeros(len(centres), dtype=np.int64)
    radius[facts["cell"]], size[facts["cell"]] = facts["radius"], facts["n"]

    def routed(second: bool):
        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), 512):
                    some = whole.iloc[at : at + 512]
                    some = some[_wide(some["v"], centres.shape[1])]
                    rows, good = unit_rows(some["v"])
                    some = some[good] if len(some) else some
                    if not len(some):
                        continue
                    angle = angles(rows)
                    order = np.argsort(angle, axis=1, kind="stable")
                    first = np.zeros_like(angle, dtype=bool)
                    before = np.cumsum(size[order], axis=1) - size[order]  # vectors in the nearer cells
                    np.put_along_axis(first, order, (before < k) & (size[order] > 0), axis=1)
                    chosen = first
                    if second:
                        bound = np.where(np.isnan(some["bound"].to_numpy(dtype=np.float64)), np.inf, some["bound"].to_numpy(dtype=np.float64))
                        chosen = ~first & (size > 0) & (angle - radius <= bound[:, None] + SLACK)
                    at_row, cell = np.nonzero(chosen)
                    yield from _in_blocks(some["query_id"].to_numpy(), rows, at_row, cell, block)

        return route

    def compared(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": asked["query_id"][:0], "vec_id": held["vec_id"][:0], "similarity": []})
        held = held.sort_values("vec_id", ignore_index=True)
        rows, out = np.stack(held["v"].to_numpy()), []
        for at in range(0, len(asked), 256):
            some = asked.iloc[at : at + 256]
            cosine = np.stack(some["v"].to_numpy()) @ rows.T
            best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), best.shape[1]), "vec_id": held["vec_id"].to_numpy()[best.ravel()], "similarity": np.take_along_axis(cosine, best, axis=1).ravel()}))
        return pd.concat(out, ignore_index=True)

    def looked(asked: DataFrame) -> DataFrame:
        # a cell that many queries look into is cut by them: a row a cell, 4,096 at most
        shares = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("shares")))
        spread = asked.join(shares, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("share", F.pmod(F.xxhash64("query_id"), "shares").cast("int"))
        homes = cells.join(shares, "cell").select("vec_id", "v", "cell", F.col("part").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        found = spread.groupBy("cell", "part", "share").cogroup(homes.groupBy("cell", "part", "share")).applyInPandas(compared, result)
        return top_n(found, ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)

    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    routes = f"query_id {dict(queries.dtypes)[query_id]}, v array<double>, cell int"
    near = checkpointed(looked(q.mapInPandas(routed(False), routes)))
    last = near.where(F.col("nth") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("similarity")))).alias("bound"))
    far = looked(q.join(last, "query_id", "left").select("query_id", "v", "bound").mapInPandas(routed(True), routes))
    return top_n(near.drop("nth").union(far.drop("nth")), ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)
