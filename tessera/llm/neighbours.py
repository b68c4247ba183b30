"""Nearest neighbours by a block matrix join.

Queries and candidates are packed into blocks: int8 codes under one scale for each block, and the norm of each vector's
quantisation error.  Blocks meet on a grid of rows and columns of blocks, so that a block is sent to one row or column of cells
and not to every other block.  A pair of blocks gives a tile of int8 products, hence distances of the coded vectors; with both
errors they bound the true distances from below and above.

A pair whose lower bound lies beyond the k-th upper bound of its query can't matter: first within a cell, then over all cells.
Only for the pairs that survive both are the vectors fetched; they are computed again in double precision, dimension by
dimension, and merged by a heap for each query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, spool

#: Vectors of a block.
QUERY_BLOCK = 1024
DATA_BLOCK = 4096
#: Pairs of blocks that a cell of the grid should have, where there are enough cells for all tasks.
CELL = 64
#: Above the largest relative error that the products and square roots of a tile can have.
SLACK = 1e-9


def usable(vector: str) -> Column:
    """Whether a vector is neither null nor empty nor zero, and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors, as rows of a matrix, for each dimension among the lists."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


_BLOCK = "ids binary, dim int, scale double, codes binary, error binary"
_BLOCK_ARROW = pa.schema([("ids", pa.binary()), ("dim", pa.int32()), ("scale", pa.float64()), ("codes", pa.binary()), ("error", pa.binary())])


def pack(ids: np.ndarray, x: np.ndarray) -> dict:
    """A block's row: ids, and the vectors as int8 codes with their errors."""
    scale = float(np.abs(x).max()) / 127 or 1.0
    codes = np.rint(x / scale).astype(np.int8)
    error = np.sqrt(((x - codes * scale) ** 2).sum(axis=1))
    return {"ids": ids.astype(np.int64).tobytes(), "dim": x.shape[1], "scale": scale, "codes": codes.tobytes(), "error": error.tobytes()}


def _packer(most: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in slices(batches, most):
            ids = b.column(0).to_numpy()
            for at, x in matrices(b.column(1)):
                own = held.setdefault(x.shape[1], [])
                own.append((ids[at], x))
                if sum(len(i) for i, _ in own) >= most:
                    yield packed(held.pop(x.shape[1]))
        for own in held.values():
            yield packed(own)

    def packed(own: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([pack(np.concatenate([i for i, _ in own]), np.concatenate([x for _, x in own]))], _BLOCK_ARROW)

    return run


class Block:
    """A block's row, unpacked."""

    def __init__(self, ids: bytes, dim: int, scale: float, codes: bytes, error: bytes):
        self.dim, self.scale = dim, scale
        self.ids, self.error = np.frombuffer(ids, np.int64), np.frombuffer(error, np.float64)
        self.codes = np.frombuffer(codes, np.int8).reshape(-1, dim)
        self.squares = (self.codes.astype(np.int64) ** 2).sum(axis=1) * scale**2
        self.floats = self.codes.astype(np.float32)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows, exactly: partial sums of 1000 dimensions stay below 2 ** 24, where float32 holds integers."""
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1000):
        total += a[:, k : k + 1000] @ b[:, k : k + 1000].T
    return total


def tile(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of a pair of blocks; infinite for a vector and itself."""
    square = q.squares[:, None] + c.squares[None, :] - 2 * q.scale * c.scale * _products(q.floats, c.floats)
    about = np.sqrt(np.maximum(square, 0))
    margin = (q.error[:, None] + c.error[None, :]) + SLACK * (about + 1e-12 + np.sqrt(q.squares.max() + c.squares.max()) * 1e-3)
    low, high = about - margin, about + margin
    low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf  # beyond what doubles hold: no bound
    own = q.ids[:, None] == c.ids[None, :]
    low[own], high[own] = np.nan, np.inf
    return low, high


class Survivors:
    """The pairs of one query block that may be among the k nearest of what was seen."""

    def __init__(self, q: Block, k: int):
        self.q, self.k = q, k
        self.best = np.full((len(q.ids), k), np.inf)  # the k least upper bounds of each query
        self.found: list[tuple[np.ndarray, ...]] = []

    def take(self, c: Block) -> None:
        low, high = tile(self.q, c)
        near = np.partition(high, min(self.k, high.shape[1]) - 1, axis=1)[:, : self.k]
        self.best = np.sort(np.concatenate([self.best, near], axis=1), axis=1)[:, : self.k]
        rows, cols = np.nonzero(low <= self.best[:, -1:])
        self.found.append((rows, c.ids[cols], low[rows, cols], high[rows, cols]))

    def batch(self) -> pa.RecordBatch:
        rows, ids, low, high = (np.concatenate(x) for x in zip(*self.found)) if self.found else [np.zeros(0, np.int64)] * 4
        good = low <= self.best[rows, -1]
        return pa.RecordBatch.from_arrays([pa.array(self.q.ids[rows[good]]), pa.array(ids[good]), pa.array(low[good].astype(float)), pa.array(high[good].astype(float))], ["query_id", "vec_id", "low", "high"])


def _cells(k: int):  # noqa: ANN202
    """Rows are a query block and a data block; those of a query block stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            for row in range(b.num_rows):
                values = [c[row] for c in b.columns]
                number = values[0].as_py()
                if number != last:
                    if now:
                        yield now.batch()
                    now, last = Survivors(Block(*(v.as_py() for v in values[1:6])), k), number
                if now.q.dim == values[7].as_py():
                    now.take(Block(*(v.as_py() for v in values[6:])))
        if now:
            yield now.batch()

    return run


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, summed in the order of the dimensions."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        total += d * d
    return np.sqrt(total)


def _scored(k: int):  # noqa: ANN202
    """Of each query's pairs in a batch, the k nearest: a query may have very many, where one vector has many copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.zeros(b.num_rows)
            for (at, x), (_, y) in zip(matrices(b.column(2)), matrices(b.column(3))):  # of one dimension, row by row
                score[at] = exact_distances(x, y)
            query, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            by = np.lexsort((ids, score, query))
            place = np.arange(len(by))
            first = np.maximum.accumulate(np.where(np.diff(query[by], prepend=query[by][:1] - 1) != 0, place, 0))
            by = by[place - first < k]
            yield pa.RecordBatch.from_arrays([pa.array(x[by]) for x in (query, ids, score)], ["query_id", "vec_id", "score"])

    return run


def _ranked(k: int):  # noqa: ANN202
    """A heap of the k best for each query; a query's rows stand together."""

    def out(query: int, heap: list[tuple[float, int]]) -> pa.RecordBatch:
        best = sorted((-d, -j) for d, j in heap)
        made = [pa.array([query] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([j for _, j in best], pa.int64()), pa.array([d for d, _ in best], pa.float64())]
        return pa.RecordBatch.from_arrays(made, ["query_id", "rank", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heap = None, []
        for b in batches:
            for query, j, d in zip(*(c.to_pylist() for c in b.columns)):
                if query != last:
                    if heap:
                        yield out(last, heap)
                    last, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -j))
                elif (-d, -j) > heap[0]:
                    heapq.heapreplace(heap, (-d, -j))
        if heap:
            yield out(last, heap)

    return run


def grid(queries: int, data: int, tasks: int) -> tuple[int, int]:
    """Rows (of data blocks) and columns (of query blocks) of cells.  The cells number ``tasks`` at least, if the pairs
    of blocks do, and move as few bytes as such a grid can: a data block is sent to every column, a query block to every row."""
    cells = min(queries * data, max(tasks, -(-queries * data // CELL)))
    columns = round(math.sqrt(cells * queries * QUERY_BLOCK / (data * DATA_BLOCK)))
    columns = min(max(columns, 1), queries)
    return min(max(-(-cells // columns), 1), data), columns


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k nearest other vectors of each whose id is divisible by ``every``.

    Nearness is the Euclidean distance in double precision, ties go to the smaller id.  Rows with a null id, and vectors that
    are null, empty, zero or hold null or non-finite components, take no part; vectors are compared with those of their own
    dimension only.  Of repeated ids one row counts, the one of the smallest vector in array order.  An empty table gives an
    empty result.  Other columns are ignored.  The search is exact.
    """
    spark = vectors.sparkSession
    rows = spool(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable("v")).groupBy("id").agg(F.min("v").alias("v")))
    asked = spool(rows.where(F.pmod("id", F.lit(every)) == 0))
    many = asked.count()
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    data = spool(rows.mapInArrow(_packer(DATA_BLOCK), _BLOCK))
    queries = spool(asked.repartition(-(-many // (8 * QUERY_BLOCK))).mapInArrow(_packer(QUERY_BLOCK), _BLOCK))
    down, along = grid(queries.count(), data.count(), spark.sparkContext.defaultParallelism)

    def dealt(blocks: DataFrame, prefix: str, own: str, n: int, other: str, m: int) -> DataFrame:
        placed = blocks.withColumn(own, F.pmod(F.xxhash64("ids"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return placed.select(own, other, *(F.col(c).alias(prefix + c) for c in blocks.columns))

    left = dealt(queries, "q_", "along", along, "down", down).withColumn("number", F.xxhash64("q_ids"))
    met = left.join(dealt(data, "c_", "down", down, "along", along), ["along", "down"]).sortWithinPartitions("number")
    bounds = spool(met.select("number", *(p + c for p in ("q_", "c_") for c in data.columns)).mapInArrow(_cells(k), "query_id long, vec_id long, low double, high double"))
    upper = bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("high"))).where(F.col("place") <= k)
    limit = upper.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("high")).otherwise(float("inf")).alias("limit"))
    left = bounds.join(limit, "query_id").where("low <= limit").select("query_id", "vec_id")
    pairs = left.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").join(rows.select(F.col("id").alias("vec_id"), F.col("v").alias("c")), "vec_id")
    scored = pairs.select("query_id", "vec_id", "q", "c").mapInArrow(_scored(k), "query_id long, vec_id long, score double")
    return scored.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_ranked(k), "query_id long, rank int, vec_id long, score double")


ORACLE_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
