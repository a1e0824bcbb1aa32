"""Best-fit decreasing packing of pieces into sequences of a fixed capacity.

A bin's future depends on its free space alone and a piece's place on its
length alone, so the whole plan is made from the number of pieces of each
length, at most `capacity` numbers, whatever the size of the corpus. Bins of
equal free space are kept as runs of sequence numbers; a segment tree over the
free spaces finds the tightest one that still takes a piece in logarithmic
time. The executors then number the pieces of each length and look up their
places in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import TOKENIZER_FILE, map_rows, parts, table
from tessella.llm.tokens import pieces


class FreeSpace:
    """A segment tree over free spaces 0..capacity; each leaf has the runs (first bin, bins) of that space."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, space: int) -> None:
        i = space + self.size
        self.full[i] = bool(self.runs[space])
        while i > 1:
            i //= 2
            self.full[i] = self.full[2 * i] or self.full[2 * i + 1]

    def add(self, space: int, run: tuple[int, int]) -> None:
        self.runs[space].append(run)
        self._mark(space)

    def take(self, space: int) -> tuple[int, int]:
        run = self.runs[space].pop()
        self._mark(space)
        return run

    def tightest(self, need: int) -> int | None:
        """The least space >= need that has a bin."""
        i = need + self.size
        if self.full[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.full[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, first offset) by length and rank.

    As in best-fit decreasing, one piece after the other: a bin that has just
    taken a piece is the tightest for the next of that length, until it is full.
    """
    free, rows, bins = FreeSpace(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            space = free.tightest(length)
            if space is None:
                space, per = capacity, capacity // length
                first, n = bins, -(-left // per)
                bins += n
            else:
                first, n = free.take(space)
                per = space // length
            used = min(n, -(-left // per))
            if used < n:
                free.add(space, (first + used, n - used))
            rows.append((length, rank, first, per, capacity - space))
            placed = min(left, used * per)
            whole, last = divmod(placed, per)
            if whole and space - per * length:
                free.add(space - per * length, (first, whole))
            if last and space - last * length:
                free.add(space - last * length, (first + whole, 1))
            left, rank = left - placed, rank + placed
    return np.array(rows, np.int64).reshape(-1, 5)


def best_fit(df: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with a column length (1 to capacity). Input columns stay as they are.

    Pieces of one length are numbered within salts dealt by place in the input,
    so neither a common length nor a common id is one task. Equal rows share
    nothing: each is placed, and which of them comes first is left open. Null
    or non-positive lengths and lengths over the capacity raise an error; an
    empty table gives an empty one.
    """
    salted = table(df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(parts(df.sparkSession))).cast("int")), "pieces")
    by_salt = table(salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("__n").alias("n")).limit(capacity + 2).collect()}
    if any(k is None or not 0 < k <= capacity for k in counts):
        raise ValueError(f"lengths must be in 1..{capacity}")
    places = plan(counts, capacity)
    keys = places[:, 0] * (1 << 44) + places[:, 1]
    order = np.argsort(keys, kind="stable")
    places, keys = places[order], keys[order]
    before = by_salt.select("length", "__salt", F.coalesce(F.sum("__n").over(W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__own", F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1).join(before, ["length", "__salt"])
    names = df.columns

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            length, rank = np.array(b["length"], np.int64), np.array(b["__rank"], np.int64)
            row = places[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1]
            own = rank - row[:, 1]
            yield {n: b[n] for n in names} | {"sequence_id": (row[:, 2] + own // row[:, 3]).tolist(), "offset": (row[:, 4] + own % row[:, 3] * length).tolist()}

    schema = df.select("*").schema.add("sequence_id", "long").add("offset", "long")
    return map_rows(ranked.select(*names, (F.col("__own") + F.col("__before")).alias("__rank")), run, schema)


def op5_pack(spark, sf_dir: str, capacity: int = 4096, end_id: int = 1, file: str = TOKENIZER_FILE) -> DataFrame:
    """Packs all documents, cut at the capacity, into as few sequences as best-fit decreasing does."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity, end_id, file)


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, file: str = TOKENIZER_FILE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id. Repeated rows and rows
    without an id are each packed. No rows, no pieces; columns but doc_id and
    text are not read.
    """
    return best_fit(pieces(docs, file, end_id, capacity), capacity)
