"""Exact top-k inner-product search by columnar branch and bound.

Blocks of candidate vectors lie in vertical layout (one row per dimension). Scores accumulate over
blocks of dimensions; after each block the mass that is left in query and candidate bounds what a
candidate can still gain, and only those that can still reach the k-th best lower bound are compacted
into the next block. Every (query block, candidate block) pair is a task of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

EXACT = 2.0**52


def quantised(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(embedding: Column) -> Column:
    """True for vectors without a null or non-finite component; null for a null vector."""
    infinite = F.lit(float("inf"))
    return F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite))


def vertical(column: pa.ChunkedArray | pa.Array, dims: int | None = None) -> np.ndarray:
    """A list column as dimensions x rows; shorter vectors count as zero in the dimensions that they lack."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    dims = max(int(sizes.max(initial=0)), dims or 0)
    if (sizes == dims).all():
        return np.ascontiguousarray(flat.reshape(len(sizes), dims).T)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    return np.ascontiguousarray(out.T)


def _remaining(x: np.ndarray, blocks: list[np.ndarray]) -> np.ndarray:
    """Row b: the length of each vector in the dimensions of block b and later ones; last row zero."""
    mass = np.stack([(x[d].astype(np.float64) ** 2).sum(0) for d in blocks] + [np.zeros(x.shape[1])])
    return np.sqrt(np.cumsum(mass[::-1], 0)[::-1])


def search_block(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of each query's k best in this block, ties to smaller ids.

    ``q`` and ``v`` are vertical integer arrays. Sums that could pass 2**52 are taken in 64-bit integers.
    """
    dims = q.shape[0]
    spread = (np.abs(q).astype(np.float64).sum(1) + 1) * (v.astype(np.float64).std(1) + 1e-9)
    order = np.argsort(-spread, kind="stable")
    blocks = [order[a : a + width] for a in range(0, dims, width)]
    left_q, left_v = _remaining(q, blocks), _remaining(v, blocks)
    exact = left_q[0].max(initial=0) * left_v[0].max(initial=0) < EXACT if dims else True
    fq, fv = (q.astype(np.float64), v.astype(np.float64)) if exact else (q, v)
    fv = [np.ascontiguousarray(fv[d]) for d in blocks]
    out_q, out_c, out_s = [], [], []
    first = fq[blocks[0]].T @ fv[0] if blocks else np.zeros((q.shape[1], v.shape[1]))
    for i in range(q.shape[1]):
        alive = np.flatnonzero(ids != query_ids[i])
        partial = first[i, alive]
        for b in range(1, len(blocks) + 1):
            if len(alive) > k:
                slack = left_q[b, i] * left_v[b, alive] * (1 + 1e-9) + 1e-3 if b < len(blocks) else 0.0
                low = partial - slack
                bar = np.partition(low, len(low) - k)[len(low) - k]
                stay = partial + slack >= bar
                alive, partial = alive[stay], partial[stay]
            if b < len(blocks):
                partial = partial + fq[blocks[b], i] @ fv[b][:, alive]
        best = np.lexsort((ids[alive], -partial))[:k]
        out_q.append(np.full(len(best), i))
        out_c.append(alive[best])
        out_s.append(partial[best].astype(np.int64))
    return np.concatenate(out_q or [np.zeros(0, int)]), np.concatenate(out_c or [np.zeros(0, int)]), np.concatenate(out_s or [np.zeros(0, np.int64)])


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = 10, dims_per_block: int = 8, query_block: int = 512, candidate_block: int = 8192) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: each query's k best candidates by integer inner product.

    Both tables hold ``vec_id`` and ``v`` (array<long>). A candidate with the query's id is left out, ties
    go to the smaller vec_id, fewer than k candidates are all returned, and queries repeated in the table
    are searched once. Rows with a null id or vector take no part; missing trailing dimensions count as
    zero. Scores are exact while they fit 64 bits. Tables are dealt in blocks by hash, each query block
    meets each candidate block once, and only k rows per block pair and query go on.
    """
    queries = queries.select("vec_id", "v").filter("vec_id is not null and v is not null").distinct()
    candidates = candidates.select("vec_id", "v").filter("vec_id is not null and v is not null")
    nq = max(1, -(-queries.count() // query_block))
    nc = max(1, -(-candidates.count() // candidate_block))
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n)).cast("int")
    left = queries.withColumn("qb", block(nq, 1)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).withColumn("part", F.xxhash64("v"))
    right = candidates.withColumn("cb", block(nc, 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        qi, ci, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
        if a.num_rows and b.num_rows:
            q, v = vertical(a["v"]), vertical(b["v"])
            dims = max(q.shape[0], v.shape[0])
            q, v = (np.pad(x, ((0, dims - x.shape[0]), (0, 0))) for x in (q, v))
            qi, ci, s = search_block(a["vec_id"].to_numpy(), q, b["vec_id"].to_numpy(), v, k, dims_per_block)
        take = lambda t, name, at: t[name].to_numpy()[at] if t.num_rows else np.zeros(0, np.int64)
        return pa.table({"query_id": take(a, "vec_id", qi), "part": take(a, "part", qi), "vec_id": take(b, "vec_id", ci), "score": s})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(search, "query_id long, part long, vec_id long, score long")
    best = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    return rows.filter(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding"), scale).alias("v"))


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = written(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors, k=10)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
