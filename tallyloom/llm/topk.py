"""Exact top-k search: columnar branch-and-bound over dimension blocks.

Vectors are held column by column.  A block of queries meets a block of
candidates in one task: inner products accumulate one block of dimensions after
the other, and after each block a candidate is dropped for a query once its
partial product plus the bound of what is left (the product of both remaining
norms, by Cauchy-Schwarz) cannot reach the query's k-th best.  Survivors are
compacted before the next block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .registry import register, table

K_BEST = 20
SCALE = 64
EVERY = 20
DIMS = 16  # dimensions per block
QUERIES = 512  # queries of a grid cell
CANDIDATES = 4096  # candidates of a grid cell
FIRST = 1024  # candidates whose whole products give a query's first bound
SPARSE = 0.05  # share of surviving pairs below which they are taken one by one
EXACT = 1 << 53  # sums of products up to here are exact in doubles


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)`` with ``v`` = floor(scale * x) as DOUBLE, whole vectors of finite numbers only."""
    e = F.col(embedding)
    whole = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.filter(whole).select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """One row per dimension, one column per vector; missing dimensions are 0."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((dims, len(column)))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
    return out


def best_of_cell(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, candidate, score)`` positions of each query's k best candidates, ties to the smaller id, itself left out."""
    total = len(q)
    exact = float(np.abs(q).sum(axis=0).max(initial=0)) * float(np.abs(c).max(initial=0)) < EXACT
    if not exact:
        q, c = q.astype(object).astype(int).astype(object), c.astype(object).astype(int).astype(object)

    def rest(x, a):  # the norms of the dimensions from ``a`` on
        return np.sqrt((x[a:].astype(float) ** 2).sum(axis=0)) * (1 + 1e-9) + 1e-9

    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[:, order]
    some = c[:, : max(4 * k, FIRST)]  # a first bound from a few whole products
    first = q.T @ some
    own = qid[:, None] == cid[None, : some.shape[1]]
    first = np.where(own, -np.inf if exact else -(1 << 200), first)
    need = np.full(len(qid), -np.inf)
    if first.shape[1] >= k + 1:
        need = np.sort(first.astype(float), axis=1)[:, -k]
    # all pairs block by block, as long as many survive
    a, partial = 0, np.zeros((len(qid), len(cid)), q.dtype)
    while True:
        b = min(a + dims, total)
        if b > a:
            partial += q[a:b].T @ c[a:b]
        a = b
        reach = np.outer(rest(q, a), rest(c, a))
        reach += partial if exact else partial.astype(float)
        alive = reach >= need[:, None]
        if a >= total or alive.mean() < SPARSE:
            break
        column = alive.any(axis=0)
        if column.mean() < 0.5:  # candidates that no query needs any more
            cid, c, partial = cid[column], c[:, column], partial[:, column]
    # then only the surviving pairs
    qi, ci = np.nonzero(alive)
    score = partial[qi, ci]
    while a < total:
        b = min(a + dims, total)
        for d in range(a, b):
            score = score + q[d][qi] * c[d][ci]
        a = b
        keep = score.astype(float) + rest(q, a)[qi] * rest(c, a)[ci] >= need[qi]
        qi, ci, score = qi[keep], ci[keep], score[keep]
    keep = qid[qi] != cid[ci]
    qi, ci, score = qi[keep], ci[keep], score[keep]
    by = np.lexsort((ci, -score.astype(float), qi)) if exact else np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -score[i], ci[i])), np.int64)
    qi, ci, score = qi[by], ci[by], score[by]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qid[qi[keep]], cid[ci[keep]], score[keep]


def top_k(
    vectors: DataFrame, vec_id: str, embedding: str, every: int = EVERY, k: int = K_BEST, queries: int = QUERIES, candidates: int = CANDIDATES
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its k largest integer inner products.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those with the query's own id.  Vectors that are null or hold null
    or non-finite components take no part; rows without id neither.  Of
    different lengths the shorter is filled up with zeros.  Repeated ids: each
    row is a candidate of its own, and a query of the smallest of its vectors.
    Scores beyond 2**53 are computed in whole numbers; one that no long holds is
    an error.  An empty table gives no rows.
    """
    rows = materialise(quantised(vectors, vec_id, embedding).filter("vec_id is not null"), "quantised")
    count, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries = asked.count()
    cells_q, cells_c = max(1, -(-n_queries // queries)), max(1, -(-count // candidates))
    # a block is a hash class of rows; ``salt`` spreads rows of one id
    salt = F.xxhash64("vec_id", "v")
    left = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(cells_q)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(cells_c - 1))).alias("cb"))
    right = rows.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(cells_q - 1))).alias("qb"), F.pmod(salt, F.lit(cells_c)).cast("int").alias("cb"))
    dims = dims or 0

    def cell(one: pa.Table, two: pa.Table) -> pa.Table:
        one, two = one.combine_chunks(), two.combine_chunks()
        read = lambda t: (t["vec_id"].to_numpy(), matrix(t["v"].combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64())), dims))
        (qid, q), (cid, c) = read(one), read(two)
        if len(qid) and len(cid):
            qid, cid, score = best_of_cell(qid, q, cid, c, k)
        else:
            qid = cid = score = np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(qid, pa.int64()), "vec_id": pa.array(cid, pa.int64()), "score": pa.array([int(s) for s in score], pa.int64())})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(cell, "query_id long, vec_id long, score long")
    # at most k rows per query and candidate block meet here; the rank limit also cuts before the shuffle
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP4_SQL = f"""
WITH v AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND vec_id IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {K_BEST}"""


@register("op4_top_k", OP4_SQL)
def op4_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
