"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Lists are those of k-means centroids, fitted on a bounded sample; every row is in its list. Each query
probes the lists with the nearest centroids, a share of all and on until they hold enough. Within a probed block vectors are rotated by one random
orthogonal matrix, so that the first coordinates are a fair sample of a vector's distance. The columns
are scanned a block at a time: after d of D coordinates the hypothesis that a candidate's distance is
within the query's k-th best so far is rejected when sqrt(D/d) times its partial distance is beyond
(1 + epsilon / sqrt(d)) times that best, and the candidate is abandoned. Survivors get the exact
distance on the original vectors.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor
do those of a rarer dimension or without an id; a query finds every row but those of its own id;
repeated rows are found each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import stage, table
from assaywork.llm.vectors import BLOCK, assign, best, blocks_of, in_blocks, matrix, sample, squared, usable

#: Vectors that the centroids are fitted on at most, and lists at most (the square root of the rows, below).
SAMPLE, LISTS = 8192, 1024
#: Share of the lists that a query probes, and how many at least.
PROBE, PROBE_LEAST = 0.6, 8
#: Columns of a block of the scan, and the significance of its test.
COLUMNS, EPSILON = 16, 2.1
FOUND = "query_id long, vec_id long, score double"


def kmeans(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        at = squared(x, c).argmin(1)
        n = np.bincount(at, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def rotation(dimension: int, seed: int = 17) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))[0]


def scan(q: np.ndarray, x: np.ndarray, turned_q: np.ndarray, turned_x: np.ndarray, near: np.ndarray, k: int, columns: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` of candidates for the k nearest to ``q``, and their exact distances. ``near``: the
    places that are tried. Those nearest in the first block of columns set the bar."""
    dim = x.shape[1]
    part = ((turned_x[near, :columns] - turned_q[:columns]) ** 2).sum(1)
    if len(near) > 4 * k:
        order = np.argpartition(part, 4 * k)
        head, rest, part = near[order[: 4 * k]], near[order[4 * k :]], part[order[4 * k :]]
    else:
        head, rest, part = near, near[:0], part[:0]
    exact = np.sqrt(((x[head] - q) ** 2).sum(1))
    if len(rest):
        bar = np.partition(exact, k - 1)[k - 1]
        for hi in range(min(dim, columns), dim + columns, columns):
            hi = min(hi, dim)
            keep = np.sqrt(part * (dim / hi)) <= bar * (1 + epsilon / math.sqrt(hi) * (hi < dim)) * (1 + 1e-9)
            rest, part = rest[keep], part[keep]
            if not len(rest) or hi == dim:
                break
            part = part + ((turned_x[rest, hi : hi + columns] - turned_q[hi : hi + columns]) ** 2).sum(1)
    at = np.concatenate([head, rest])
    return at, np.concatenate([exact, np.sqrt(((x[rest] - q) ** 2).sum(1))])


def search(df: DataFrame, is_query: Column, k: int = 10, probe: float = PROBE, lists: int = LISTS, columns: int = COLUMNS, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score. ``df``: vec_id, embedding; ``is_query``: of vec_id."""
    spark = df.sparkSession
    rows = usable(df, zero=False)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = sample(rows, SAMPLE)
    centres = kmeans(fitted, max(1, min(lists, math.isqrt(total), len(fitted))))
    probes = min(len(centres), max(PROBE_LEAST, math.ceil(probe * len(centres))))
    cells = stage(assign(rows, centres).select("vec_id", "v", "cell"))
    counts = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    blocks = blocks_of(counts)
    turn = rotation(fitted.shape[1])
    sent = spark.sparkContext.broadcast((centres, blocks, turn, np.array([counts.get(c, 0) for c in range(len(centres))])))
    queries = cells.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    query_blocks = max(1, math.ceil(queries.count() / BLOCK))

    def deal(batches):
        c, block, _, size = sent.value
        for batch in batches:
            near = np.argsort(squared(matrix(batch["q"]), c), axis=1, kind="stable")
            # on until there are k besides the query's own row
            enough = (np.cumsum(size[near], axis=1) > k).argmax(1) + 1
            enough = np.where(size.sum() > k, enough, len(c))
            out = [(i, cell, b) for i, own in enumerate(near.tolist()) for cell in own[: max(probes, int(enough[i]))] for b in range(block.get(cell, 0))]
            i, cell, b = (pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32())))
            own = batch.take(i)
            qb = pa.array((own["query_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % query_blocks, pa.int32())
            yield pa.RecordBatch.from_arrays([cell, b, qb, own["query_id"], own["q"]], ["cell", "block", "query_block", "query_id", "q"])

    def solve(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if data.num_rows and asked.num_rows:
            turned = sent.value[2]
            x, ids = matrix(data["v"]), data["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            tx = x @ turned
            q = matrix(asked["q"])
            tq = q @ turned
            for i, own in enumerate(asked["query_id"].to_pylist()):
                other = np.flatnonzero(ids != own)
                at, d = scan(q[i], x, tq[i], tx, other, k, columns, epsilon)
                pick = np.lexsort((ids[at], d))[:k]
                for o, v in zip(out, (np.full(len(pick), own, np.int64), ids[at][pick], d[pick])):
                    o.append(v)
        cols = [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    kind = dict(rows.dtypes)["v"]
    right = queries.mapInArrow(deal, f"cell int, block int, query_block int, query_id long, q {kind}")
    key = ["cell", "block", "query_block"]
    found = in_blocks(cells, counts, query_blocks).groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(solve, FOUND)
    return best(found, k, False)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all ``embeddings``."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op6_nearest": op6_nearest}
ORACLES: dict[str, str] = {}
