"""SimHash near-duplicate groups by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most three agree, but for at
most one bit, on one of the two halves. So each fingerprint is indexed under
every half with one bit masked out (64 keys of 31 fixed bits), and an equality
join on (mask, masked value) finds every pair; a count of differing bits then
verifies it. Only distinct fingerprints are indexed: copies share one.

Keys are shuffled and sorted once, and each worker walks through them. A key of
no more than `bucket` members is verified there, and of its links only those
that join different parts are handed on, as components need no more. The
members of a larger key are never gathered: the same scheme goes on over the
bits that are still free. 32 of them give 32 masks of 15 bits more, and 16 of
those 16 masks of 7 bits more; the last level leaves 11 free bits, so 2,048
members of a key at most. No link is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, parts, table
from tessella.llm.graph import components

MAX_BITS = 3


def _halves(bits: list[int]) -> list[int]:
    """Masks that fix one half of the given bits less one."""
    masks = []
    for half in (bits[: len(bits) // 2], bits[len(bits) // 2 :]):
        for out in half:
            masks.append(sum(1 << b for b in half if b != out))
    return masks


def level_masks() -> list[np.ndarray]:
    """For each level its masks; the children of the i-th mask of a level are an equal stretch of the next, in the same order."""
    levels, now = [], [(0, list(range(64)))]
    for _ in range(3):
        after = []
        for mask, free in now:
            low, high = free[: len(free) // 2], free[len(free) // 2 :]
            for k, more in enumerate(_halves(free)):
                after.append((mask | more, high if k < len(low) else low))  # what the other half may differ in is left to compare
        levels.append(np.array([m for m, _ in after], np.uint64).view(np.int64))
        now = after
    return levels


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """The XXH64 (seed 42) of all shingles, repeats included; too few words are one shingle, none give none."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, 42)] if words else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    return np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(words: list[bytes], width: int) -> int:
    """Majority bits of the shingles' hashes; no words give 0."""
    return majority(shingle_hashes(words, width))


def fingerprints(df: DataFrame, width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of `keep` and fp (the fingerprint's bits as a signed long) of doc_id, text.

    A null text counts as an empty one, and an empty or blank one gives zero.
    Repeated rows stay, an empty table gives no rows, other columns are not read.
    """
    names = ["doc_id", *(keep or [])]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            fps = np.array([fingerprint((t or "").encode().lower().split(), width) for t in b["text"]], np.uint64)
            yield {n: b[n] for n in names} | {"fp": fps.view(np.int64).tolist()}

    return map_rows(df.select(*names, "text"), run, df.select(*names).schema.add("fp", "long"))


def forest(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a spanning forest of distinct fingerprints, unsigned."""
    if len(fps) == 2:
        return ([fps[:1]], [fps[1:]]) if int(fps[0] ^ fps[1]).bit_count() <= MAX_BITS else ([], [])
    a, b, new = [], [], np.ones(len(fps), bool)
    while new.any():
        front = [int(np.flatnonzero(new)[0])]
        new[front[0]] = False
        while front:
            i = front.pop()
            rest = np.flatnonzero(new)
            near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= MAX_BITS]
            new[near] = False
            a.append(np.repeat(fps[i], len(near)))
            b.append(fps[near])
            front += near.tolist()
    return a, b


def walk(bucket: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (m, masked value, fp) sorted by the first two: links (a, b, m null), and members (a, b null, m) of keys larger than `bucket`."""

    def batch(a: np.ndarray, b: np.ndarray | None, m: np.ndarray | None) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(len(a), kind)
        cols = [pa.array(a.view(np.int64)), none(pa.int64()) if b is None else pa.array(b.view(np.int64)), none(pa.int32()) if m is None else pa.array(m, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, value, fp, large = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64), None

        def key_of(i: int) -> tuple[int, int]:
            return int(m[i]), int(value[i])

        for rows in itertools.chain(batches, [None]):
            if rows is not None:
                m = np.concatenate((m, rows.column(0).to_numpy()))
                value = np.concatenate((value, rows.column(1).to_numpy()))
                fp = np.concatenate((fp, rows.column(2).to_numpy().view(np.uint64)))
            if not len(m):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (value[1:] != value[:-1]))))
            ends = np.append(starts[1:], len(m))
            split = np.zeros(len(starts), bool) if large is None else (np.arange(len(starts)) == 0) & (key_of(0) == large)
            split |= ends - starts > bucket
            whole = np.ones(len(starts), bool)
            whole[-1] = rows is None  # the last key may go on in the next batch
            if large is not None and rows is not None and not (len(starts) == 1 and split[0]):
                large = None
            out = split.copy()
            if split[-1]:
                large = key_of(starts[-1])
            if out.any():
                take = np.repeat(out, ends - starts)
                yield batch(fp[take], None, m[take])
            links_a: list[np.ndarray] = []
            links_b: list[np.ndarray] = []
            size = ends - starts
            two = starts[whole & ~split & (size == 2)]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS]
            links_a.append(fp[near])
            links_b.append(fp[near + 1])
            for i in np.flatnonzero(whole & ~split & (size > 2)).tolist():
                a, b = forest(fp[starts[i] : ends[i]])
                links_a += a
                links_b += b
            yield batch(np.concatenate(links_a), np.concatenate(links_b), None)
            keep = starts[-1] if not whole[-1] and not split[-1] else len(m)
            m, value, fp = m[keep:], value[keep:], fp[keep:]

    return run


def links(distinct: DataFrame, bucket: int = 256) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp) that differ in 1 to 3 bits; enough of them to connect all that are linked."""
    levels = level_masks()
    members, before, found = distinct.select(F.lit(0).alias("m"), "fp"), 1, []
    for depth, masks in enumerate(levels):
        each = len(masks) // before
        split = members.select(F.explode(F.sequence(F.col("m") * each, F.col("m") * each + (each - 1))).alias("m"), "fp")
        value = F.expr(f"fp & element_at(array({','.join(f'{x}L' for x in masks.tolist())}), m + 1)")
        keys = split.select("m", value.alias("value"), "fp").repartition(parts(distinct.sparkSession), "m", "value").sortWithinPartitions("m", "value")
        limit = bucket if depth < len(levels) - 1 else 1 << 11
        out = table(keys.mapInArrow(walk(limit), "a long, b long, m int"), "signatures")
        found.append(out.where("m is null").select("a", "b"))
        members, before = out.where("m is not null").select("m", F.col("a").alias("fp")), len(masks)
        if members.isEmpty():
            break
    return reduce(DataFrame.union, found)


def labels(distinct: DataFrame) -> DataFrame:
    """fp, component (the least fingerprint that is reachable) of distinct fingerprints; reads the same rows on every pass."""
    found = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    return distinct.select("fp").join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def groups(fps: DataFrame) -> DataFrame:
    """fp, component_id (the least doc_id) of every distinct fingerprint of doc_id, fp."""
    distinct = table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    labelled = distinct.join(labels(distinct), "fp")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return labelled.join(least, "component").select("fp", "component_id")


def near_duplicates(df: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for each row of doc_id, text.

    Null, empty and blank texts have fingerprint zero and are linked as any
    other. Repeated rows stay, each with its group. A null doc_id never is the
    component_id unless a group has no other id. An empty table gives no rows.
    """
    fps = table(fingerprints(df, width), "document-fingerprints")
    return fps.join(groups(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """SimHash groups over all documents: shingles of three words, three bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
