"""Nearest neighbours by a block matrix join with quantised tiles.

Vectors are cut into blocks: base rows into blocks of base vectors, query rows
into blocks of queries. Blocks are dealt to groups, and every group of queries
meets every group of base blocks in one cell of a grid, by an equality join on
the two groups' numbers. A group of queries is bounded, so that a cell keeps all
its heaps; the more groups of queries there are, the fewer of base blocks. A
tile is a product of int8 matrices; with the rounding error of each vector,
known exactly, it bounds each distance from both sides. Only pairs whose lower
bound does not exceed the query's k-th best are computed again, in double
precision, and kept in a heap for each query; the cells' heaps are then merged.
The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import map_rows, parts

BLOCK = 2048
QUERY_BLOCK = 1024
#: Query blocks in a group, on average: the heaps of a cell.
QUERY_BLOCKS = 64


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale for each row and the exact length of each row's rounding error."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise distances; the squares are added one dimension after the other, so equal pairs give equal numbers."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += (a[:, d] - b[:, d]) ** 2
    return np.sqrt(total)


def blocks(df: DataFrame, groups: int, size: int) -> DataFrame:
    """dim, grp, ids, data (rows of numbers) blobs of at most `size` vectors, dealt to the groups in turn. Unusable vectors take no part."""
    single = df.schema["embedding"].dataType.elementType == T.FloatType()
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[int, list] = {}
        turn = TaskContext.get().partitionId() * 0x9E3779B1

        def put(dim: int) -> dict:
            nonlocal turn
            rows, turn = held.pop(dim), turn + 1
            return {"dim": [dim], "grp": [turn % groups], "ids": [np.array([i for i, _ in rows], "<i8").tobytes()], "data": [np.stack([v for _, v in rows]).astype(kind).tobytes()]}

        for b in batches:
            for i, v in zip(b["vec_id"], b["embedding"], strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) >= size:
                    yield put(len(x))
        for dim in list(held):
            yield put(dim)

    return map_rows(df.select("vec_id", "embedding"), run, "dim int, grp int, ids binary, data binary")


def _tile(ids: np.ndarray, q: np.ndarray, quantised: tuple, base_ids: np.ndarray, x: np.ndarray, base_quantised: tuple, heaps: list[list], k: int) -> None:
    """Offers the base vectors to the heap (negated distance and id) of each query."""
    (a, sa, ea), (b, sb, eb) = quantised, base_quantised
    product = a.astype(np.float32 if a.shape[1] <= 1000 else np.float64) @ b.T.astype(np.float32 if a.shape[1] <= 1000 else np.float64)  # whole numbers, exact
    na, nb = (a.astype(np.float64) ** 2).sum(1) * sa**2, (b.astype(np.float64) ** 2).sum(1) * sb**2
    near = np.sqrt(np.maximum(na[:, None] + nb - 2 * (sa[:, None] * sb) * product, 0))
    slack = ea[:, None] + eb + 1e-9 * (1 + np.sqrt(na)[:, None] + np.sqrt(nb))
    low, high = near - slack, near + slack
    same = ids[:, None] == base_ids
    low[same], high[same] = np.inf, np.inf
    bound = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(ids), np.inf)
    for i, h in enumerate(heaps):
        if len(h) >= k:
            bound[i] = min(bound[i], -h[0][0])
    rows, cols = np.nonzero((low <= bound[:, None]) & np.isfinite(low))
    for at in range(0, len(rows), 1 << 16):
        r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
        exact = euclidean(q[r], x[c])
        for i, d, v in zip(r.tolist(), exact.tolist(), base_ids[c].tolist(), strict=True):
            item = (-d, -v)
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], item)
            elif item > heaps[i][0]:
                heapq.heapreplace(heaps[i], item)


def nearest(df: DataFrame, queries: F.Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all rows of vec_id, embedding to each row that `queries` marks.

    Smallest Euclidean distance first, ties to the smaller vec_id; a row with
    the query's own id is none of its neighbours. Rows whose id or vector is
    null, whose vector is zero or empty or holds a null or non-finite number,
    take no part; vectors of another dimension than the query's neither. A
    repeated row is a candidate for each time it occurs; a repeated query id
    has the neighbours of each of its vectors merged. No queries, no rows.
    """
    asked = df.where(queries)
    query_groups = max(1, -(-asked.count() // (QUERY_BLOCK * QUERY_BLOCKS)))
    groups = -(-parts(df.sparkSession) // query_groups)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = blocks(df, groups, block).select("dim", "grp", every(query_groups).alias("q_grp"), "ids", "data")
    spread = blocks(asked, query_groups, QUERY_BLOCK).select("dim", F.col("grp").alias("q_grp"), every(groups).alias("grp"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    tiles = base.hint("merge").join(spread, ["dim", "grp", "q_grp"])
    kind = "<f4" if df.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        heaps: dict[tuple[bytes, bytes], tuple] = {}
        last: tuple = (None, None)
        cell = None
        for b in batches:
            for dim, grp, q_grp, ids, data, q_ids, q_data in zip(b["dim"], b["grp"], b["q_grp"], b["ids"], b["data"], b["q_ids"], b["q_data"], strict=True):
                if cell != (dim, grp, q_grp):  # rows come sorted by cell
                    yield from map(_rows, heaps.values())
                    heaps.clear()
                    cell = (dim, grp, q_grp)
                name = (q_ids, q_data)
                if name not in heaps:
                    q = np.frombuffer(q_data, kind).reshape(-1, dim).astype(np.float64)
                    heaps[name] = (np.frombuffer(q_ids, "<i8"), q, quantise(q), [[] for _ in range(len(q))])
                if last[0] != (ids, data):
                    x = np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)
                    last = ((ids, data), np.frombuffer(ids, "<i8"), x, quantise(x))
                q_id, q, quantised, own = heaps[name]
                _tile(q_id, q, quantised, last[1], last[2], last[3], own, k)
        yield from map(_rows, heaps.values())

    def _rows(kept: tuple) -> dict:
        flat = [(q, -v, -d) for q, h in zip(kept[0].tolist(), kept[3], strict=True) for d, v in h]
        return {"query_id": [r[0] for r in flat], "vec_id": [r[1] for r in flat], "score": [r[2] for r in flat]}

    found = map_rows(tiles, run, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by query; each query's candidates are merged by a heap of k."""
        query, heap = None, []

        def done() -> pd.DataFrame:
            best = sorted((-d, -v) for d, v in heap)
            return pd.DataFrame({"query_id": query, "rank": range(1, len(best) + 1), "vec_id": [v for _, v in best], "score": [d for d, _ in best]})

        for pdf in batches:
            for q, v, d in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist(), strict=True):
                if q != query:
                    if heap:
                        yield done()
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -v))
                elif (-d, -v) > heap[0]:
                    heapq.heapreplace(heap, (-d, -v))
        if heap:
            yield done()

    by_query = found.repartition("query_id").sortWithinPartitions("query_id", "score", "vec_id")
    return by_query.mapInPandas(merge, "query_id long, rank int, vec_id long, score double")


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each whose id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
), d AS (
  SELECT q.vec_id AS query_id, b.vec_id, sqrt(list_reduce([(q.v[i] - b.v[i]) * (q.v[i] - b.v[i]) FOR i IN range(1, len(q.v) + 1)], lambda a, x: a + x)) AS score FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0 AND len(q.v) = len(b.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""
