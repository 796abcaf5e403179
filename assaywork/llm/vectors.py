"""Vectors in cells around pivots, and the search of query blocks in blocks of cells.

A block is at most about ``BLOCK`` vectors of one cell, so a cell that holds a third of all rows
(one vector repeated) is many blocks; queries, too, are dealt in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block of a cell, and queries of a block, about.
BLOCK = 4096


def usable(df: DataFrame, zero: bool) -> DataFrame:
    """vec_id, v of the rows with an id and a vector of finite components, of the most frequent
    dimension (ties: the larger). zero: whether zero vectors take part."""
    v = F.col("embedding")
    rows = df.select("vec_id", v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten()).astype(dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, those whose ids have the least digests, as a matrix."""
    got = rows.select("v", F.xxhash64(F.col("vec_id").cast("string")).alias("h"), "vec_id").orderBy("h", "vec_id").limit(most).select("v").toArrow()
    return matrix(got["v"])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def assign(rows: DataFrame, pivots: np.ndarray, turn: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """vec_id, v, cell (the nearest pivot), away (distance to it). turn: of the vectors, before."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = turn(matrix(part["v"]))
                d = squared(x, sent.value)
                cell = d.argmin(1)
                away = np.sqrt(((x - sent.value[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array(cell, pa.int32()), pa.array(away)], ["vec_id", "v", "cell", "away"])

    return rows.mapInArrow(nearest, f"vec_id long, v {dict(rows.dtypes)['v']}, cell int, away double")


def blocks_of(counts: dict[int, int]) -> dict[int, int]:
    return {c: max(1, math.ceil(n / BLOCK)) for c, n in counts.items()}


def in_blocks(cells: DataFrame, counts: dict[int, int], query_blocks: int) -> DataFrame:
    """Adds block and query_block: each vector is in one block of its cell, once per block of queries."""
    many = {c: b for c, b in blocks_of(counts).items() if b > 1}
    width = F.lit(1)
    if many:
        width = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for p in many.items() for x in p]), F.col("cell")), F.lit(1))
    out = cells.withColumn("block", F.pmod(F.xxhash64("vec_id"), width).cast("int"))
    return out.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))) if query_blocks > 1 else out.withColumn("query_block", F.lit(0))


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if descending else F.asc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
