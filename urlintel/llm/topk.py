"""Exact top-k search: tiles of queries against tiles of vectors as matrix products.

Vectors become whole numbers, floor(scale * x), multiplied as 64-bit floats where every product is exact. Vectors are packed
into tiles, queries into blocks, with 16 bits a number where that is enough; each block meets each tile once (an equi-join
on a key that every tile has and every block is listed under). What moves for a pair of tile and block is both matrices,
so blocks are large, and cut into portions of PORTION queries when they are multiplied. A tile gives each query its best k; these lists merge in a tree: by group of tiles, then over all.

Defined results: vectors that are null, or hold null or non-finite components, take no part; empty vectors take part
and score 0; only vectors of the same length are compared; ties go to the smaller id; rows that share an id are each a
candidate, but never for their own id; scores beyond 64 bits become the nearest long; with fewer candidates than k all are returned; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stash import stash

K, SCALE, TILE, BLOCK, PORTION, FAN = 5, 256, 4096, 16384, 1024, 16
EXACT, LONG = float(1 << 53), 1 << 63


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (floor(scale * x) as doubles), dim; only finite vectors."""
    x = F.col(vector_col).cast("array<double>")
    ok = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"), F.size(vector_col).alias("dim"))


def as_bytes(matrix: np.ndarray) -> bytes:
    return matrix.astype("<i2" if not matrix.size or np.abs(matrix).max() < 1 << 15 else "<f8").tobytes()


def from_bytes(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * rows * dim else "<f8").reshape(rows, dim).astype(np.float64)


def packed(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Tiles of up to ``size`` vectors of one length: dim, tile, ids, matrix. A task packs what it reads; nothing moves."""

    def run(batches):
        held: dict[int, list] = {}
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            dims = batch.column(2).to_numpy()
            ids = batch.column(0).to_numpy()
            flat = batch.column(1)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                values = flat.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
                held.setdefault(dim, []).append((ids[own], np.floor(values * scale)))
                while sum(len(i) for i, _ in held[dim]) >= size:
                    i, m = (np.concatenate(x) for x in zip(*held[dim], strict=True))
                    yield one(dim, (part << 32) + made, i[:size], m[:size])
                    made += 1
                    held[dim] = [(i[size:], m[size:])]
        for dim, parts in held.items():
            i, m = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(i):
                yield one(dim, (part << 32) + made, i, m)
                made += 1

    def one(dim, tile, ids, matrix):
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([tile], pa.int64()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([as_bytes(matrix)], pa.binary())], ["dim", "tile", "ids", "matrix"])

    return rows.mapInArrow(run, "dim int, tile long, ids binary, matrix binary")


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; Python integers where 53 bits might not do."""
    if q.size == 0 or c.size == 0:
        return np.zeros((len(q), len(c)))
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < EXACT:
        return q @ c.T
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return exact(q) @ exact(c).T


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """The k best of a tile for each query of a block."""
    s = scores(q, c)
    own = q_ids[:, None] == c_ids[None, :]
    rows, columns = [], []
    if s.dtype != object:
        s[own] = -np.inf
        take = min(k, len(c_ids))
        bar = np.partition(s, len(c_ids) - take, axis=1)[:, len(c_ids) - take] if take else np.zeros(len(q))
        rows, columns = np.nonzero((s >= bar[:, None]) & ~own)
    else:
        rows, columns = np.nonzero(~own)
    value = s[rows, columns]
    by = np.lexsort((c_ids[columns], -value, rows)) if s.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -value[i], c_ids[columns[i]])), int)
    rows, columns, value = rows[by], columns[by], value[by]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    return q_ids[rows[keep]], c_ids[columns[keep]], value[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, tile: int = TILE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of highest inner product for each query, itself left out."""
    tiles = stash(packed(whole_numbers(vectors, scale, id_col, vector_col), tile, scale))
    asked = whole_numbers(queries, scale, id_col, vector_col)
    blocks = stash(packed(asked.repartition(1 + asked.count() // block, "vec_id"), block, scale))
    lists = tiles.select("dim", F.col("tile").alias("at")).join(blocks.select("dim", F.col("tile").alias("block")), "dim")
    pairs = lists.join(blocks.select(F.col("tile").alias("block"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q")), "block").join(tiles.select(F.col("tile").alias("at"), "ids", "matrix"), "at")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at, dim, q_ids, q, c_ids, c = (batch.column(j)[i].as_py() for j in range(6))
                q_ids, c_ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                q, c = from_bytes(q, len(q_ids), dim), from_bytes(c, len(c_ids), dim)
                for j in range(0, len(q_ids), PORTION):
                    a, b, value = best(q_ids[j : j + PORTION], q[j : j + PORTION], c_ids, c, k)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([max(-LONG, min(LONG - 1, int(x))) for x in value], pa.int64()), pa.array(np.full(len(a), at % FAN), pa.int32())], ["query_id", "vec_id", "score", "limb"])

    found = pairs.select("at", "dim", "q_ids", "q", "ids", "matrix").mapInArrow(run, "query_id long, vec_id long, score long, limb int")
    order = [F.desc("score"), F.asc("vec_id")]
    limb = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "limb").orderBy(*order))).filter(F.col("rank") <= k)
    return limb.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
