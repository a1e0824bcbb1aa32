"""Nearest-neighbour distances of crops to a labelled pool, and similarity joins.

Rows are cut into blocks (one binary value each), blocks are dealt to groups, and
every group of queries meets every group of the pool in one cell of a grid, by an
equality join on the cell's number. A worker goes through the blocks of a cell
one pair after the other, as a product of two matrices, and holds no more than
one block of queries with its best values. Nothing passes through the driver, and
the grid's two sides follow the sizes of the tables, so that neither is sent
around more often than the other's size asks for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import vectors as V
from tessella.sources.staging import staged

#: Rows in a block of queries, and in one of the pool.
QUERY_BLOCK, POOL_BLOCK = 512, 4096

Stretch = tuple[int, int]


def _matrix(column: pa.Array) -> np.ndarray:
    """A matrix of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def units_of(x: np.ndarray, stretch: Stretch = (0, 1 << 30)) -> np.ndarray:
    x = x[:, stretch[0] : stretch[0] + stretch[1]]
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12)


def _floor_units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


#: A pool of fewer bytes, as estimated, is one group: it goes to every cell whole.
WHOLE = 1 << 25


def grid(queries: DataFrame, pool: DataFrame, cells: int | None = None) -> tuple[int, int]:
    """Groups of queries and of the pool: their product is about the number of shuffle partitions, their ratio that of the tables' sizes as the optimizer estimates them."""
    size = lambda df: float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) + 1
    if cells is None:
        cells = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if size(pool) < WHOLE:
            return cells, 1
    asked = min(cells, max(1, round(math.sqrt(cells * min(1e18, size(queries) / size(pool))))))
    return asked, -(-cells // asked)


def blocks(df: DataFrame, size: int, groups: int, key: str | None = None) -> DataFrame:
    """grp, name, data: at most `size` rows as one Arrow stream; name tells blocks apart. Blocks are dealt to the groups in turn; with a key (an integer column) a block's rows share its value, the grp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        for whole in batches:
            cuts = [whole] if whole.num_rows else []
            if key and cuts:
                order = np.argsort(whole.column(key).to_numpy(), kind="stable")
                whole = whole.take(pa.array(order))
                values = whole.column(key).to_numpy()
                starts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
                cuts = [whole.slice(x, y - x) for x, y in zip(starts, starts[1:])]
            for b in cuts:
                for at in range(0, b.num_rows, size):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema) as stream:
                        stream.write_batch(b.slice(at, size))
                    group = b.column(key)[0].as_py() if key else (part * 0x9E3779B1 + turn) % groups
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([part << 32 | turn]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["grp", "name", "data"])
                    turn += 1

    return df.mapInArrow(run, "grp int, name long, data binary")


def _opened(blob: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob.as_buffer()) as stream:
        return stream.read_next_batch()


def on_grid(queries: DataFrame, pool: DataFrame, groups: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Blocks of both sides with their cells (q, p)."""
    asked, held = groups
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks(queries, QUERY_BLOCK, asked).select(F.col("grp").alias("q"), every(held).alias("p"), "name", "data")
    return left, blocks(pool, POOL_BLOCK, held).select(every(asked).alias("q"), F.col("grp").alias("p"), "data")


def meet(left: DataFrame, right: DataFrame, best: Callable, schema: T.StructType) -> DataFrame:
    """Runs best(block of queries) over all blocks of the pool in each cell (q, p).

    best(batch) returns an object with add(batch of the pool) and result() -> batch.
    The join keeps every block of queries, so that an empty pool gives results, too,
    and, as an outer join, is never split on the side of the pool.
    """
    named = left.select("q", "p", "name", F.col("data").alias("asked"))
    pairs = named.hint("merge").join(right.select("q", "p", F.col("data").alias("held")), ["q", "p"], "left").select("name", "q", "p", "asked", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None
        for b in batches:
            for name, x, y in zip(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True), b.column(3), b.column(4), strict=True):
                if name != last:  # the pairs of a block of queries follow one another
                    if now is not None:
                        yield now.result()
                    last, now = name, best(_opened(x))
                if y.is_valid:
                    now.add(_opened(y))
        if now is not None:
            yield now.result()

    return pairs.mapInArrow(run, schema)


class _Distances:
    """For each stretch of the vectors the k least cosine distances of a block of queries."""

    def __init__(self, batch: pa.RecordBatch, k: int, stretches: list[Stretch], columns: list[str]):
        self.batch, self.k, self.stretches, self.columns = batch, k, stretches, columns
        x = _matrix(batch.column("embedding"))
        self.units = [units_of(x, s) for s in stretches]
        self.least = [np.empty((len(x), 0)) for _ in stretches]

    def add(self, pool: pa.RecordBatch) -> None:
        y = _matrix(pool.column("embedding"))
        for i, (s, units) in enumerate(zip(self.stretches, self.units, strict=True)):
            d = np.concatenate((self.least[i], 1 - units @ units_of(y, s).T), axis=1)
            self.least[i] = np.partition(d, self.k - 1, axis=1)[:, : self.k] if d.shape[1] > self.k else d

    def result(self) -> pa.RecordBatch:
        rows, n = self.batch.num_rows, self.least[0].shape[1]
        values = np.sort(np.stack(self.least, 1), axis=2).ravel()
        inner = pa.ListArray.from_arrays(np.arange(0, rows * len(self.least) * n + 1, n, np.int32) if n else np.zeros(rows * len(self.least) + 1, np.int32), pa.array(values))
        lists = pa.ListArray.from_arrays(np.arange(0, rows * len(self.least) + 1, len(self.least), np.int32), inner)
        return pa.RecordBatch.from_arrays([*[self.batch.column(c) for c in self.columns], lists], names=[*self.columns, "distances"])


def knn_distances(queries: DataFrame, pool: DataFrame, k: int = 1, widths: list[int] | None = None, cells: int | None = None, stretches: list[Stretch] | None = None) -> DataFrame:
    """Queries with `distances`, for each prefix width (or stretch: start and width) the k least cosine distances to the pool, ascending.

    Fewer than k pool vectors give shorter lists, an empty pool empty ones. Rows
    with a null vector are left out; repeated rows each have their lists.
    """
    stretches = stretches or [(0, w) for w in widths or [1 << 30]]
    queries = queries.where("embedding is not null")
    pool = pool.where("embedding is not null").select("embedding")
    groups = grid(queries, pool, cells)
    lists = T.StructField("distances", T.ArrayType(T.ArrayType(T.DoubleType())))
    if groups[1] == 1:
        names = queries.columns
        return meet(*on_grid(queries, pool, groups), lambda b: _Distances(b, k, stretches, names), T.StructType([*queries.schema, lists]))
    # A row's lists come from several cells: they are merged by the row's number, which is written down.
    rows = staged(queries.withColumn("__row", F.monotonically_increasing_id()), "queries")
    parts = meet(*on_grid(rows.select("__row", "embedding"), pool, groups), lambda b: _Distances(b, k, stretches, ["__row"]), T.StructType([T.StructField("__row", T.LongType()), lists]))
    at = lambda i: F.transform(F.col("all"), lambda d: d[i])
    merged = [F.slice(F.array_sort(F.flatten(at(i))), 1, k) for i in range(len(stretches))]
    found = parts.groupBy("__row").agg(F.collect_list("distances").alias("all")).select("__row", F.array(*merged).alias("distances"))  # bounded: k values for each group of the pool
    return rows.join(found, "__row").drop("__row")


def similarity_sum(crops: DataFrame, targets: DataFrame) -> DataFrame:
    """crop_id, similarity: the sum of each crop's cosines with all targets, as one product with the sum of their unit vectors."""
    u = targets.select(F.posexplode(V.unit(F.col("embedding"), "floor")).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    total = u.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s.x).alias("__sum"))  # one row, a vector
    return crops.join(F.broadcast(total)).select("crop_id", "image_id", V.dot(V.unit(F.col("embedding"), "floor"), F.col("__sum")).alias("similarity"))


SIMILAR = T.StructType([T.StructField("fp_id", T.LongType()), T.StructField("crop_id", T.LongType()), T.StructField("sim", T.DoubleType())])


class Similar:
    """The n most similar rows of the pool for each row of a block, ties to the smaller id."""

    def __init__(self, batch: pa.RecordBatch, n: int):
        self.n, self.ids = n, batch.column("crop_id").to_numpy()
        self.units = _floor_units(_matrix(batch.column("embedding")))
        self.row, self.sim, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, pool: pa.RecordBatch) -> None:
        own = pool.column("crop_id").to_numpy()
        sim = self.units @ _floor_units(_matrix(pool.column("embedding"))).T
        least = np.partition(sim, -self.n, axis=1)[:, -self.n, None] if sim.shape[1] > self.n else -np.inf
        row, col = np.nonzero(sim >= least)
        row, near, ids = np.concatenate((self.row, row)), np.concatenate((self.sim, sim[row, col])), np.concatenate((self.id, own[col]))
        order = np.lexsort((ids, -near, row))
        row = row[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.n
        self.row, self.sim, self.id = row[keep], near[order][keep], ids[order][keep]

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(self.sim)], names=["fp_id", "crop_id", "sim"])


def top_similar(crops: DataFrame, targets: DataFrame, n: int, cells: int | None = None) -> DataFrame:
    """J10, SK12: fp_id, crop_id, sim, rank: the true n nearest crops of each target, ties to the smaller id. Targets need unique ids."""
    targets = targets.where("embedding is not null").select("crop_id", "embedding")
    crops = crops.where("embedding is not null").select("crop_id", "embedding")
    found = meet(*on_grid(targets, crops, grid(targets, crops, cells)), lambda b: Similar(b, n), SIMILAR)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("fp_id").orderBy(F.desc("sim"), "crop_id"))).where(F.col("rank") <= n)
