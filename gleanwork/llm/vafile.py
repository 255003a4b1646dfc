"""Exact top-k search with vector-approximation files.

Each vector has a small approximation: its cell in a grid. A query first scans cells only, which bound its score with
every vector from both sides; exact vectors are then read from the best bound downward until none that remains can be
among the k best.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

BITS = 4  # of each component's cell
BLOCK_ROWS = 4096  # vectors in one block of the file
QUERY_ROWS = 512  # queries scanned against a block at once
SCALE = 1024


def grid(vectors: np.ndarray) -> np.ndarray:
    """Cell edges, [2**BITS + 1, dim]: quantiles of each component; the outer edges are the block's extremes, so every
    vector lies within its cell."""
    return np.quantile(vectors, np.linspace(0, 1, (1 << BITS) + 1), axis=0)


def cells(vectors: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each component the cell [edges[c], edges[c + 1]] that holds it."""
    out = np.empty(vectors.shape, np.uint8)
    for j in range(vectors.shape[1]):
        out[:, j] = np.clip(np.searchsorted(edges[1:-1, j], vectors[:, j], side="right"), 0, (1 << BITS) - 1)
    return out


def search_block(ids, vectors, cell, edges, query_ids, queries, k: int):
    """(query index, id, score) of the k best of this block for each query other than its own row; ties to smaller id.

    Scores are integers below 2**53, which doubles hold exactly; bounds are widened by their rounding error.
    """
    dims = np.arange(vectors.shape[1])
    low, high = edges[cell, dims], edges[cell + 1, dims]
    middle, half = (low + high) / 2, (high - low) / 2
    guess, spread = queries @ middle.T, np.abs(queries) @ half.T
    spread += 1e-9 * (np.abs(queries) @ (np.abs(middle) + half).T) + 1e-6
    upper, lower = guess + spread, guess - spread
    found = []
    for q in range(len(queries)):
        own = ids == query_ids[q]
        up, lo = np.where(own, -np.inf, upper[q]), np.where(own, -np.inf, lower[q])
        n = len(ids) - int(own.sum())
        if n <= 0:
            continue
        if n > k:
            kth = np.partition(lo, len(lo) - k)[len(lo) - k]
            near = np.flatnonzero(up >= kth)
        else:
            near = np.flatnonzero(~own)
        near = near[np.argsort(-up[near], kind="stable")]
        best_s = np.zeros(0)
        best_i = np.zeros(0, np.int64)
        at, step = 0, max(k, 32)
        while at < len(near):
            if len(best_s) >= k and up[near[at]] < best_s[-1]:
                break  # no vector that remains reaches the k-th best
            pick = near[at : at + step]
            best_s = np.concatenate([best_s, vectors[pick] @ queries[q]])
            best_i = np.concatenate([best_i, ids[pick]])
            order = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[order], best_i[order]
            at, step = at + step, step * 2
        found.append((np.full(len(best_s), query_ids[q]), best_i, best_s.astype(np.int64)))
    return found


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, dim, v: floor(1024 * x) of each component as long. Rows with a null id, a null or empty vector, or a
    null or non-finite component are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    ok = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(ok)
    return rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _build(block_rows: int):
    def build(batches):
        """Blocks of one dimension each: the approximation file (edges, cells) and the exact vectors, as bytes."""
        import pyarrow as pa

        held: dict[int, list] = {}

        def block(dim, rows):
            ids = np.array([r[0] for r in rows], np.int64)
            v = np.array([r[1] for r in rows], np.int64)
            edges = grid(v.astype(np.float64))
            c = cells(v.astype(np.float64), edges)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (ids, edges, c, v)],
                ["dim", "n", "ids", "edges", "cells", "vectors"],
            )

        for batch in batches:
            for vec_id, dim, v in zip(*(c.to_pylist() for c in batch.columns)):
                rows = held.setdefault(dim, [])
                rows.append((vec_id, v))
                if len(rows) == block_rows:
                    yield block(dim, held.pop(dim))
        for dim, rows in held.items():
            yield block(dim, rows)

    return build


def _scan(k: int):
    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                read = lambda b, t: np.frombuffer(r[b], t)
                got = search_block(
                    read("ids", np.int64), read("vectors", np.int64).reshape(-1, dim).astype(np.float64), read("cells", np.uint8).reshape(-1, dim),
                    read("edges", np.float64).reshape(-1, dim), read("q_ids", np.int64), read("q_vectors", np.int64).reshape(-1, dim).astype(np.float64), k,
                )
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], ["query_id", "vec_id", "score"])

    return scan


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `queries` its k best rows of `vectors` by inner product.

    Both come from integer_vectors. A query meets vectors of its own dimension, other than those of its own id. Ties go
    to the smaller vec_id; k rows or all there are. Rows that repeat an id are candidates each. Nulls don't reach this
    point. No queries or no vectors: an empty result. Products must stay below 2**53.

    Blocks of queries meet blocks of the file by an equi-join on the query block's number; each pair of blocks gives k
    rows a query at most, of which the k best are kept. Tables of bytes of a fixed length: a vector that is very common
    makes no block larger.
    """
    schema = "dim int, n int, ids binary, edges binary, cells binary, vectors binary"
    file = materialise(vectors.select("vec_id", "dim", "v").mapInArrow(_build(block_rows), schema), "vafile")
    asked = materialise(queries.select("vec_id", "dim", "v").mapInArrow(_build(query_rows), schema), "queries")
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).withColumn("q", F.monotonically_increasing_id())
    asked = materialise(asked, "asked")
    numbers = asked.groupBy("dim").agg(F.collect_list("q").alias("qs"))
    pairs = file.select("dim", "ids", "edges", "cells", "vectors").join(numbers, "dim").withColumn("q", F.explode("qs")).drop("qs")
    found = pairs.join(asked.drop("dim"), "q").drop("q").mapInArrow(_scan(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_vector_approximation(spark, sf_dir):
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP6_SQL = """
with v as (
  select cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as k from s
)
select query_id, cast(k as integer) as rank, vec_id, score from r where k <= 10
"""
