"""Exact top-k search by inner product as a Voronoi join.

Vectors become integers, floor(1024 x), and are grouped by their nearest pivot. A cell's summary is
its count and radius; with them q.x <= q.p + |q| * radius bounds every score in the cell. A query is
first solved in the cells with the largest q.p that hold enough vectors, which gives a score that its
k-th best reaches at least. Then it is replicated to exactly the cells whose bound reaches that score;
queries are replicated to cells, and a cell's data once per 4096 queries in all. Each block is solved by a matrix product
of integers, exact in double precision, or in Python's integers where they are too large for it.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
those of a rarer dimension or without an id; scores beyond 64 bits count as the largest or smallest;
a query finds every row but those of its own id; repeated rows are found each; with fewer than k
candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import stage, table
from assaywork.llm.vectors import BLOCK, assign, best, blocks_of, in_blocks, matrix, sample, usable

SCALE = 1024.0
#: Pivots at most; the pivots and the summaries are what is broadcast.
PIVOTS = 256
SLACK = 1e-9
FOUND = "query_id long, vec_id long, score long"


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, as 64-bit integers."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if big < 2**53:
        return (q @ x.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in r] for r in m], object) for m in (q, x))
    limit = 2**63 - 1
    return np.array([[max(-limit - 1, min(limit, int(v))) for v in r] for r in a @ b.T], np.int64)


def solve(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """left: blocks of vectors (cell, block, query_block, vec_id, v); right: queries dealt to blocks
    (the same keys, query_id, q, least). The k best of each query in each block that reach ``least``."""

    def one(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if data.num_rows and queries.num_rows:
            x, ids = whole(matrix(data["v"])), data["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            for lo in range(0, queries.num_rows, 256):
                part = queries.slice(lo, 256)
                s = products(whole(matrix(part["q"])), x)
                for i, (own, least) in enumerate(zip(part["query_id"].to_pylist(), part["least"].to_pylist())):
                    at = np.flatnonzero((ids != own) & (s[i] >= (-(2**63) if least is None else least)))
                    at = at[np.argsort(-s[i][at].astype(object) if len(at) and s[i][at].min() == -(2**63) else -s[i][at], kind="stable")[:k]]
                    for o, v in zip(out, (np.full(len(at), own, np.int64), ids[at], s[i][at])):
                        o.append(v)
        cols = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    key = ["cell", "block", "query_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(one, FOUND)


def search(df: DataFrame, is_query: Column, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score. ``df``: vec_id, embedding; ``is_query``: of vec_id."""
    spark = df.sparkSession
    rows = usable(df, zero=True)
    total = rows.count()
    p = whole(sample(rows, max(1, min(pivots, math.isqrt(total)))))
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = stage(assign(rows, p, whole))
    summary = {r["cell"]: (r["n"], r["radius"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    counts = {c: n for c, (n, _) in summary.items()}
    blocks = blocks_of(counts)
    queries = cells.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    query_blocks = max(1, math.ceil(queries.count() / BLOCK))
    used = np.array(sorted(summary), np.int64)
    n_of, r_of = (np.array([summary[c][i] for c in used], float) for i in (0, 1))
    sent = spark.sparkContext.broadcast((p[used], used, n_of, r_of, blocks))

    def deal(first: bool):
        def run(batches):
            pv, at, n, radius, block = sent.value
            for batch in batches:
                q = whole(matrix(batch["q"]))
                score = q @ pv.T
                bound = score + np.sqrt((q * q).sum(1))[:, None] * radius
                out = [[], [], [], [], []]
                for i in range(len(q)):
                    order = np.argsort(-score[i], kind="stable")
                    near = order[: int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1]
                    if first:
                        pick, least = near, None
                    else:
                        least = batch["least"][i].as_py()
                        pick = np.setdiff1d(np.flatnonzero(bound[i] * (1 + SLACK * np.sign(bound[i])) >= least) if least is not None else np.arange(len(at)), near)
                    for c in at[pick].tolist():
                        for b in range(block[c]):
                            for o, v in zip(out, (i, c, b, least, 0)):
                                o.append(v)
                own = batch.take(pa.array(out[0], pa.int64()))
                qb = pa.array((own["query_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % query_blocks, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), qb, own["query_id"], own["q"], pa.array(out[3], pa.int64())], ["cell", "block", "query_block", "query_id", "q", "least"])

        return run

    kind = dict(rows.dtypes)["v"]
    dealt = f"cell int, block int, query_block int, query_id long, q {kind}, least long"
    left = in_blocks(cells.select("vec_id", "v", "cell"), counts, query_blocks)
    near = stage(solve(left, queries.mapInArrow(deal(True), dealt), k))
    reached = best(near, k, True).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = queries.join(reached, "query_id", "left")
    far = solve(left, rest.mapInArrow(deal(False), dealt), k)
    return best(near.unionByName(far), k, True)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector against all ``embeddings``."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op10_topk": op10_topk}
ORACLES = {
    "op10_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as u
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.u, c.u), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""
}
