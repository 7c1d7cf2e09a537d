"""Exact top-k inner products by no-random-access aggregation.

Vectors become integers, floor(scale * x). A block of vectors is read as sorted lists, one per dimension, from the end that
favours the query. After reading to some depth, a vector's lower bound adds the worst value of each list that it has not been
seen in, its upper bound the last value read there. Reading stops for a query when no vector outside those that may still be
among its k best has an upper bound that reaches the k-th lower bound; the scores of those are then resolved. Blocks are
independent, their k best meet in one ranking per query.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Vectors of a block, and queries that meet it at a time.
BLOCK, QUERIES = 4096, 512
#: Shares of a list read before the bounds are compared.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): vectors of finite components, as whole numbers; those null or with a null, NaN or infinite component go."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    ok = x.isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(False))
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def blocks_of(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (ids, data, dim) of up to ``size`` vectors of one dimension, packed where they lie."""
    def pack(batches):
        held: dict[int, tuple[list, list]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            ids, rows = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.array(rows, np.int64).tobytes()]),
                                               pa.array([dim], pa.int32())], ["ids", "data", "dim"])

        for batch in batches:
            for number, row in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                ids, rows = held.setdefault(len(row), ([], []))
                ids.append(number)
                rows.append(row)
                if len(ids) == size:
                    yield packed(len(row))
        for dim in list(held):
            yield packed(dim)

    return vectors.mapInArrow(pack, "ids binary, data binary, dim int")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in floating point if every sum fits there, in longs if it fits there, else an error."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise OverflowError("an inner product may not fit a long")


def search_block(ids: np.ndarray, data: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k best rows of the block, itself left out; ties to the smaller id."""
    n, dim = data.shape
    order = np.argsort(data, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    ordered = np.take_along_axis(data, order, axis=0)
    lowest, highest = ordered[0], ordered[-1]
    exact = int(np.abs(data).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(dim, 1) * 2 < 1 << 53
    left = np.arange(len(queries))
    out_q, out_r, out_s = [], [], []
    for share in DEPTHS if exact and n > 4 * k else (1.0,):
        depth = max(1, int(np.ceil(n * share)))
        if depth >= n:
            scores = product(data, queries[left])
            may = np.ones(scores.shape, bool)
            done = np.arange(len(left))
        else:
            plus, minus = np.maximum(queries[left], 0).astype(np.float64).T, np.minimum(queries[left], 0).astype(np.float64).T
            top, bottom = rank >= n - depth, rank < depth
            read = np.where(top, data, 0) @ plus + np.where(bottom, data, 0) @ minus
            upper = read + np.where(top, 0, ordered[n - depth]) @ plus + np.where(bottom, 0, ordered[depth - 1]) @ minus
            lower = read + np.where(top, 0, lowest) @ plus + np.where(bottom, 0, highest) @ minus
            own = ids[:, None] == q_ids[left][None, :]
            lower[own] = -np.inf
            floor = np.partition(lower, n - k, axis=0)[n - k]
            may = (upper >= floor) & ~own
            done = np.flatnonzero(may.sum(axis=0) <= max(4 * k, n // 16))  # no outsider can qualify; resolve these
            scores = None
        for j in done:
            rows = np.flatnonzero(may[:, j])
            mine = scores[rows, j] if scores is not None else product(data[rows], queries[left[j]:left[j] + 1])[:, 0]
            keep = ids[rows] != q_ids[left[j]]
            rows, mine = rows[keep], mine[keep]
            best = np.lexsort((ids[rows], -mine))[:k]
            out_q.append(np.full(len(best), left[j]))
            out_r.append(rows[best])
            out_s.append(mine[best])
        left = np.delete(left, done)
        if not len(left):
            break
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate([empty, *x]) for x in (out_q, out_r, out_s))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best vectors, its own id left out.

    A vector whose length differs from the query's is no candidate. Repeated rows are candidates each. Every block of vectors meets
    every block of queries by a join on the query block's number and a salt of the vector block, so neither side is broadcast and
    a few pairs of blocks are a task.
    """
    q = usable(queries, id_col, vec_col, scale)
    n_blocks = max(1, -(-q.count() // QUERIES))
    salts = max(1, vectors.count() // (2 * BLOCK))
    packed_q = blocks_of(q.repartition(n_blocks, F.pmod(F.xxhash64("id"), F.lit(n_blocks))), QUERIES)
    packed_q = packed_q.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dim").alias("q_dim"),
                               F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    packed = blocks_of(usable(vectors, id_col, vec_col, scale), BLOCK)
    packed = packed.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    met = packed.join(packed_q, (packed["salt"] == packed_q["salt"]) & (F.col("dim") == F.col("q_dim")))

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                data = np.frombuffer(row["data"], np.int64).reshape(len(ids), row["dim"])
                qs, rows, scores = search_block(ids, data, q_ids, np.frombuffer(row["q_data"], np.int64).reshape(len(q_ids), row["dim"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[qs]), pa.array(ids[rows]), pa.array(scores)], ["query_id", "vec_id", "score"])

    found = met.select("ids", "data", "q_ids", "q_data", "dim").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
