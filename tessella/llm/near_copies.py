"""Near copies: groups of texts whose sets of word shingles have at least a given Jaccard similarity.

First comes SimHash (simhash): texts whose fingerprints over the same shingles
differ in at most three bits are found by deletion-variant signatures, and each
is compared by its set with the fingerprint's first text. This joins the dense
groups of copies, however large, in nearly linear time. Fingerprints can't find
the rest, as a pair of similarity 0.8 differs in about ten bits of 64; so an
exact search follows for similar texts of different groups, none found by luck:
in one common order of all shingles, two sets that similar share one of their
first n - ceil(least * n) + 1 (prefix filter). Those prefixes are indexed, so the
order puts rare shingles first; how common one is comes from a sample, which
decides how fast the search is, never what it finds. Candidates that sizes and
places allow are tested by counts of hashes in 256 bins, which bound what two
sets can share, and then verified by the whole sets.

Texts of one set are one entry. A key of more than `bucket` entries is never
gathered: its members are first compared with a few of them in rounds, for each
step of size those that have the key earliest in their order, and then those of
groups that are still apart with each other, by joins. The first places of a set
are its rare shingles, which few others have; of edited copies of one text the
one that has a common shingle earliest is the least edited and similar to most.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import simhash
from tessella.llm.common import drop_table, map_rows, once, parts, repeated, sent, table
from tessella.llm.graph import components
from tessella.llm.lm_score import level

WIDTH, LEAST = 5, 0.8
#: For the order only: one text in sixteen is sampled (all of the first SAMPLE), and so many shingles are sent to all workers (12 bytes each).
SAMPLE_SHARE, SAMPLE, COMMON = 1 / 16, 6_000, 2_000_000
#: For a large key: in so many rounds its members are compared with some of them, so many of each step of size.
ROUNDS, LEADS = 2, 2


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; too few words are one shingle, none give none."""
    return np.unique(simhash.shingle_hashes((text or "").encode().lower().split(), width))


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def _common(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and sample counts of the most common shingles."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE / max(1, rows.count())))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            u, n = np.unique(np.concatenate([shingles(t, width) for t in b["text"]]), return_counts=True)
            yield {"key": u.view(np.int64), "n": n}

    taken = rows.where(F.pmod(F.xxhash64(F.lit("order"), "row"), F.lit(1 << 62)) < int(share * (1 << 62))).select("text")
    found = table(map_rows(taken, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 3"), "common-shingles")
    got = found.where(F.col("n") >= level(found, COMMON)).toArrow()
    key, n = (got[c].combine_chunks().to_numpy() for c in ("key", "n"))
    drop_table(found)
    key = key.view(np.uint64)
    at = np.argsort(key)
    return key[at], n[at].astype(np.int32)


BINS = 256


def bins(u: np.ndarray) -> bytes:
    """How many hashes fall in each bin; empty where a bin has more than a byte holds, and then no bound is known."""
    count = np.bincount((u & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else b""


def _name(u: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(u.tobytes())
    return h - (h >> 63 << 64)


def _sets(rows: DataFrame, width: int, least: float) -> DataFrame:
    """row, id, name (a hash of the set), size, prefix, fp (fingerprint) and bins of row, id, text."""
    order = rows.sparkSession.sparkContext.broadcast(_common(rows, width))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        key, n = order.value
        for b in batches:
            out: dict[str, list] = {"row": b["row"], "id": b["id"], "name": [], "size": [], "prefix": [], "fp": [], "bins": []}
            for t in b["text"]:
                hashes = simhash.shingle_hashes((t or "").encode().lower().split(), width)
                u, fp = np.unique(hashes), simhash.majority(hashes)
                count = np.zeros(len(u), np.int64)
                if len(key):
                    at = np.minimum(np.searchsorted(key, u), len(key) - 1)
                    count = np.where(key[at] == u, n[at], 0)
                out["name"].append(_name(u))
                out["size"].append(len(u))
                out["prefix"].append(u[np.lexsort((u, count))[: prefix_length(len(u), least)]].view(np.int64))
                out["fp"].append(fp - (fp >> 63 << 64))
                out["bins"].append(bins(u))
            yield out

    schema = rows.select("row", "id").schema.add("name", "long").add("size", "integer").add("prefix", T.ArrayType(T.LongType())).add("fp", "long").add("bins", "binary")
    return map_rows(rows.select("row", "id", "text"), run, schema)


def _possible(n, i, m, j, least: float):
    """Whether sets of n and m shingles whose first common one is their i-th and j-th can be similar enough; for arrays and columns."""
    need = (n + m) * (least / (1 + least)) - 1e-9
    return (n - i >= need) & (m - j >= need)


POSTING = "key long, name long, grp long, pos int, size int"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of the prefixes of name, grp, size, prefix."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            keys = b.column(3).flatten().to_numpy()
            n = np.diff(b.column(3).offsets.to_numpy())
            first = np.cumsum(n) - n
            name, grp, size = (np.repeat(b.column(k).to_numpy(), n) for k in range(3))
            pos = np.arange(len(keys)) - np.repeat(first, n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, name, grp, pos.astype(np.int32), size)], names=["key", "name", "grp", "pos", "size"])


def _walk(bucket: int, least: float):
    """Over rows (key, name, grp, pos, size) sorted by key: candidates (a, b) of different groups, and members (key, a, grp, pos, size; b null) of keys larger than `bucket`."""
    names, kinds = ["key", "a", "b", "grp", "pos", "size"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def batch(n: int, **cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name, grp, pos, size = (np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32))
        large = None  # the key that is handed on already and may go on
        for more in itertools.chain(batches, [None]):
            if more is not None:
                key, name, grp, pos, size = (np.concatenate((x, more.column(k).to_numpy())) for k, x in enumerate((key, name, grp, pos, size)))
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            length = np.diff(np.append(starts, len(key)))
            out = (length > bucket) | (False if large is None else key[starts] == large)
            if out.any():
                take = np.repeat(out, length)
                yield batch(int(take.sum()), key=key[take], a=name[take], grp=grp[take], pos=pos[take], size=size[take])
            if out[-1]:
                large = key[-1]
            whole = np.ones(len(starts), bool)
            whole[-1] = more is None
            pairs_a, pairs_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k in np.unique(length[whole & ~out & (length > 1)]).tolist():  # all keys of k members at once
                i, j = np.triu_indices(k, 1)
                first = starts[whole & ~out & (length == k)]
                for some in np.array_split(first, 1 + len(first) * len(i) // 1_000_000):
                    x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                    ok = (grp[x] != grp[y]) & _possible(size[x], pos[x], size[y], pos[y], least)
                    pairs_a.append(np.minimum(name[x[ok]], name[y[ok]]))
                    pairs_b.append(np.maximum(name[x[ok]], name[y[ok]]))
            a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
            if len(a):
                a, b = np.unique(np.stack((a, b)), axis=1)
            yield batch(len(a), a=a, b=b)
            keep = len(key) if out[-1] else starts[-1]
            key, name, grp, pos, size = key[keep:], name[keep:], grp[keep:], pos[keep:], size[keep:]

    return run


def _likely(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose bins allow enough common shingles; known: name, size, bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            both = np.flatnonzero([bool(p and q) for p, q in zip(x, y, strict=True)])
            most = sizes.copy()
            for at in np.array_split(both, 1 + len(both) // 4096):
                u, v = (np.frombuffer(b"".join(side[i] for i in at.tolist()), np.uint8).reshape(-1, BINS) for side in (x, y))
                most[at] = np.minimum(u, v).sum(1, dtype=np.int64)
            yield b.select(["a", "b"]).filter(pa.array(most >= sizes * (least / (1 + least)) - 1e-9))

    side = lambda c: known.select(F.col("name").alias(c), F.col("size").alias(f"{c}_size"), F.col("bins").alias(f"{c}_bins"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_size", "b_size", "a_bins", "b_bins")
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, firsts: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs a, b of set names whose sets are similar enough; firsts: name, row, size, bins."""
    named = lambda some: some.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    every = table(pairs.distinct(), "candidates")
    known = table(firsts.join(named(every), "name", "left_semi"), "candidate-bins")
    pairs = table(_likely(every, known, least), "likely-pairs")
    wanted = sent(table(known.join(named(pairs), "name", "left_semi").select("row"), "candidate-rows"))

    def sets_of(batches: Iterator[dict]) -> Iterator[dict]:
        seen: set = set()  # rows that repeat whole: one of them for each task
        for b in batches:
            found = []
            for row, t in zip(b["row"], b["text"], strict=True):
                if row not in seen:
                    seen.add(row)
                    found.append(shingles(t, width))
            yield {"name": [_name(u) for u in found], "hashes": [u.tobytes() for u in found]}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(k)] for k in (2, 3))
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            either = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64) - both
            yield b.select(["a", "b"]).filter(pa.array(both >= either * least - 1e-9))

    texts = rows.select("row", "text").join(wanted, "row", "left_semi")
    sets = table(map_rows(texts, sets_of, "name long, hashes binary"), "candidate-sets")
    single = once(sets, "name")
    side = lambda c: single.select(F.col("name").alias(c), F.col("hashes").alias(f"{c}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    found = table(both.mapInArrow(compared, "a long, b long"), "near-pairs")
    for done in (every, known, sets):
        drop_table(done)
    return found


def _labelled(df: DataFrame, links: DataFrame) -> DataFrame:
    """df with grp: the least name that is linked to its name."""
    found = components(links).select(F.col("node").alias("name"), F.col("component").alias("grp"))
    return df.join(found, "name", "left").withColumn("grp", F.coalesce("grp", "name"))


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (key, name, pos, size) with their groups, of the keys whose members are not one group."""
    left = _labelled(members, links)
    mixed = left.groupBy("key").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y").select("key")
    return table(left.join(mixed, "key", "left_semi"), "large-keys")


def _by_fingerprint(firsts: DataFrame) -> DataFrame:
    """Candidates a, b: each set with the first of its fingerprint, and the first ones of fingerprints within three bits."""
    leads = table(firsts.groupBy("fp").agg(F.min("name").alias("lead")), "fingerprints")
    same = firsts.select("name", "fp").join(leads, "fp").where("name <> lead").select(F.col("lead").alias("a"), F.col("name").alias("b"))
    lead = lambda c: leads.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead"))
    near = simhash.links(leads.select("fp")).join(lead("a"), "a").join(lead("b"), "b")
    return same.unionByName(near.select(F.least("a_lead", "b_lead").alias("a"), F.greatest("a_lead", "b_lead").alias("b")))


def groups(rows: DataFrame, width: int = WIDTH, least: float = LEAST, bucket: int = 64) -> DataFrame:
    """first (no_id, id, row) and component of every distinct set of row, id, text; first is the entry of the least id, nulls last, then the least row.

    row must name id and text. A null text counts as an empty one, and all texts
    without words are one set. Repeated rows are one entry; an empty table has no groups.
    """
    sets = table(_sets(rows, width, least), "shingle-sets")
    entry = F.struct(F.col("id").isNull().alias("no_id"), "id", "row").alias("first")
    many = repeated(sets, "name")  # the others need neither a shuffle nor a sort
    grouped = sets.join(many, "name", "left_semi").select("name", entry, "size", "prefix", "fp", "bins").groupBy("name").agg(F.min("first").alias("first"), *[F.first(c).alias(c) for c in ("size", "prefix", "fp", "bins")])
    alone = sets.join(many, "name", "left_anti").select("name", entry, "size", "prefix", "fp", "bins")
    firsts = table(alone.unionByName(grouped), "distinct-sets")
    drop_table(sets)
    by_row = firsts.select("name", F.col("first.row").alias("row"), "size", "bins")
    links = _verified(_by_fingerprint(firsts), by_row, rows, width, least)
    posts = _labelled(firsts.select("name", "size", "prefix"), links).select("name", "grp", "size", "prefix").mapInArrow(_postings, POSTING)
    walked = table(posts.repartition(parts(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_walk(bucket, least), "key long, a long, b long, grp long, pos int, size int"), "walked")
    pairs = walked.where("b is not null").select("a", "b")
    large = walked.where("b is null").select("key", F.col("a").alias("name"), "grp", "pos", "size")
    links = links.union(_verified(pairs, by_row, rows, width, least))
    left = large.drop("grp")
    for turn in range(ROUNDS):  # links to a few members of each key join most of its groups, pair by pair what is still apart
        if left.isEmpty():
            break
        left = _apart(left, links)
        step = F.round(F.ln("size") * 10).cast("int")  # sets that similar lie within two steps of a tenth
        part = F.pmod(F.xxhash64("name", F.lit(-1 - turn)), F.lit(LEADS))
        lead = F.min(F.struct("pos", F.xxhash64("name", F.lit(turn)).alias("h"), "name", "grp", "size"))  # the least edited, see above
        leads = left.groupBy("key", step.alias("step"), part.alias("part")).agg(lead.alias("l")).select("key", F.explode(F.sequence(F.col("step") - 2, F.col("step") + 2)).alias("step"), *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("name", "grp", "pos", "size")])
        to_lead = left.withColumn("step", step).join(leads, ["key", "step"]).where((F.col("grp") != F.col("l_grp")) & _possible(F.col("size"), F.col("pos"), F.col("l_size"), F.col("l_pos"), least))
        found = _verified(to_lead.select(F.least("name", "l_name").alias("a"), F.greatest("name", "l_name").alias("b")), by_row, rows, width, least)
        links, left = links.union(found), left.drop("grp")
    if not left.isEmpty():
        left = _apart(left, links)
        x, y = left.alias("x"), left.alias("y")
        apart = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.name") < F.col("y.name")) & (F.col("x.grp") != F.col("y.grp")) & _possible(F.col("x.size"), F.col("x.pos"), F.col("y.size"), F.col("y.pos"), least))
        links = links.union(_verified(apart.select(F.col("x.name").alias("a"), F.col("y.name").alias("b")), by_row, rows, width, least))
    return _labelled(firsts.select("name", "first"), links).select("first", F.col("grp").alias("component"))
