"""Language-model scores: context-tree weighting over bytes, beside a unigram word score.

The model predicts the bytes of the lower-cased text and its end by
context-tree weighting (context_tree): estimates of all depths up to `depth`
bytes are mixed by the weights that the training texts give them. All byte
strings of all training texts count; none is cut, at any size.

Counts of words and of byte strings are summed by key over the cluster. The
trees are computed in parts, each where its byte strings lie, and meet in a top
of bounded size. The words and the byte strings with the largest counts are
sent to all workers (at most `head` and `head_grams`); what else a text holds is
looked up by an equality join, so that neither a vocabulary nor a model need
fit a worker. The heads decide how fast this goes, not what comes out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import crc_mod, map_rows, parts, revived, table
from tessella.llm.context_tree import TOP, Mixture, Subtrees, Top, grams

DEPTH = 5
HEAD = 150_000
HEAD_GRAMS = 1_000_000
CHUNK = 1 << 21
#: Byte strings that a worker computes at once, if their subtrees allow a cut.
STRETCH = 1 << 19
WORD, GRAM, END = 0, 1, 2
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(1) << np.uint64(63)  # no byte string: they have fewer bits
_EMPTY = np.empty(0, np.int64)


def pieces_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of about CHUNK bytes."""
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t)
        if size >= CHUNK:
            yield now
            now, size = [], 0
    if now:
        yield now


def counts(df: DataFrame, depth: int) -> DataFrame:
    """kind, key, n over all texts: words by the XXH64 of their bytes, byte strings by their number, ends (one a text)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from xxhash import xxh64_intdigest

        words: Counter = Counter()
        keys, ns, held, ends = [], [], 0, 0

        def put(kind: int, key, n) -> dict:
            return {"kind": np.full(len(key), kind, np.int32), "key": key, "n": n}

        def flush_words() -> dict:
            out = put(WORD, np.array([xxh64_intdigest(w) for w in words], np.uint64).view(np.int64), list(words.values()))
            words.clear()
            return out

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, at = np.unique(np.concatenate(keys), return_inverse=True)
            return u, np.bincount(at, np.concatenate(ns), len(u)).astype(np.int64)

        for b in batches:
            texts = [(t or "").encode().lower() for t in b["text"]]
            ends += len(texts)
            for some in pieces_of(texts):
                for t in some:
                    words.update(t.split())
                u, n = np.unique(grams(some, depth)[0], return_counts=True)
                keys.append(u)
                ns.append(n)
                held += len(u)
                if len(words) > 300_000:
                    yield flush_words()
                if held > 2_000_000:
                    u, n = merged()
                    if len(u) > 1_000_000:
                        yield put(GRAM, u.view(np.int64), n)
                        keys, ns, held = [], [], 0
                    else:
                        keys, ns, held = [u], [n], len(u)
        if words:
            yield flush_words()
        if keys:
            u, n = merged()
            yield put(GRAM, u.view(np.int64), n)
        yield put(END, [0], [ends])

    return map_rows(df.select("text"), run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def level(df: DataFrame, most: int) -> int:
    """The least number such that at most `most` rows have it or more in n; found from a histogram of some hundred steps."""
    step = F.floor(F.log2("n") * 8)
    total, least = 0, 1
    for r in sorted(df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r["step"]):
        total += r["rows"]
        if total > most:
            return math.floor(2 ** ((r["step"] + 1) / 8)) + 1
    return least


class Head:
    """An open-addressing table of byte strings with the log10 of their last symbol's probability."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(key) * 2.5).bit_length())
        self.keys, self.values = np.full(1 << self.bits, _NONE), np.zeros(1 << self.bits, np.float32)
        left = np.arange(len(key))
        slot = self._slot(key)
        while len(left):
            free = self.keys[slot[left]] == _NONE
            at = left[free]
            self.keys[slot[at]] = key[at]
            placed = np.zeros(len(left), bool)
            placed[free] = self.keys[slot[at]] == key[at]
            self.values[slot[left[placed]]] = value[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 for what the table lacks, and the places of the latter."""
        slot = self._slot(key)
        got, out = self.keys[slot], self.values[slot]
        wrong = np.flatnonzero(got != key)
        missing = [np.empty(0, np.int64)]
        while len(wrong):
            out[wrong] = 0
            empty = self.keys[slot[wrong]] == _NONE
            missing.append(wrong[empty])
            wrong = wrong[~empty]
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[wrong]] == key[wrong]
            out[wrong[hit]] = self.values[slot[wrong[hit]]]
            wrong = wrong[~hit]
        return out, np.concatenate(missing)


def subtree_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(9)) & np.uint64((1 << 8 * (TOP + 1)) - 1)


def by_subtree(found: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over key, n, wanted, in batches that hold their subtrees whole. fn gets arrays and yields lists of arrays."""
    subtree = F.shiftrightunsigned("key", 9).bitwiseAND(F.lit((1 << 8 * (TOP + 1)) - 1))
    rows = found.select("key", "n", "wanted").repartition(parts(found.sparkSession), subtree).sortWithinPartitions(subtree)
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(key: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in fn(key, n, wanted)], names=names)

        def joined() -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*held, strict=True)]

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().astype(float), b.column(2).to_numpy(zero_copy_only=False)))
                size += b.num_rows
            if size >= STRETCH:
                key, n, wanted = joined()
                tree = subtree_of(key)
                cut = int(np.flatnonzero(tree != tree[-1])[-1]) + 1 if tree[0] != tree[-1] else 0
                yield from out(key[:cut], n[:cut], wanted[:cut])
                held, size = [(key[cut:], n[cut:], wanted[cut:])], len(key) - cut
        if held:
            yield from out(*joined())

    return rows.mapInArrow(run, schema)


def top_of(found: DataFrame, depth: int) -> Top:
    """The top of the trees of the byte strings key, n: gathered on the driver, 256 decisions for each of 65,536 contexts at most."""

    def part(key: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        return Subtrees(key, n, depth).for_top()

    made = by_subtree(found.withColumn("wanted", F.lit(False)), part, "node long, a double, b double, below double")
    got = made.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toArrow()
    cols = [c.combine_chunks().to_numpy() for c in got.columns]
    return Top(cols[0].view(np.uint64), *cols[1:])


def gram_values(found: DataFrame, top, depth: int) -> DataFrame:
    """key, value (log10 of the probability) of the rows key, n, wanted that are wanted; n of 0 is no count. top: a broadcast of the levels of a Top."""

    def part(key: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        asked = np.unique(key[wanted])
        if not len(asked):
            return asked, np.empty(0)
        seen = n > 0
        return asked, Subtrees(key[seen], n[seen], depth).log10(asked, revived(Top, {"levels": [revived(Mixture, m) for m in top.value]}))

    return by_subtree(found, part, "key long, value double")


def score(df: DataFrame, folds: int = 10, depth: int = DEPTH, head: int = HEAD, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of doc_id, text.

    bits_per_byte is the code length of the text and its end over the text's
    bytes (over one for an empty text). Null and empty texts have the end as
    their only token. Repeated rows each have their result. Without any
    training text counts are zero and every decision has probability one half;
    an empty table gives no rows. Columns but doc_id and text are not read.
    """
    sc = df.sparkSession.sparkContext
    rows = df.select("doc_id", "text", (crc_mod("doc_id", folds) == 0).alias("held_out"))
    counted = table(counts(rows.where("not held_out"), depth), "counts")
    words = counted.where(f"kind = {WORD}").select("key", "n")
    sums = {r["kind"]: r for r in counted.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()}
    n_of = lambda kind, what="n": sums[kind][what] if kind in sums else 0
    ends = n_of(END)
    total, vocabulary = n_of(WORD) + ends, n_of(WORD, "distinct") + (ends > 0)
    found = counted.where(f"kind = {GRAM}").select("key", "n")
    top = sc.broadcast([vars(m) for m in top_of(found, depth).levels])
    common = F.col("n") >= level(found, head_grams)
    got = gram_values(found.withColumn("wanted", common), top, depth).toArrow()  # at most head_grams rows of two numbers
    near = sc.broadcast(vars(Head(*(got[c].combine_chunks().to_numpy().view(t) for c, t in (("key", np.uint64), ("value", np.float64))))))
    most = words.where(F.col("n") >= level(words, head)).toPandas()
    frequent = sc.broadcast(dict(zip(most["key"].tolist(), most["n"].tolist(), strict=True)))  # at most `head` words
    end_part = math.log10(ends + 0.1)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from xxhash import xxh64_intdigest

        model, known, memo = revived(Head, near.value), frequent.value, {}
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            texts = [(t or "").encode().lower() for t in b["text"]]
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "part", "score", "rare", "times", "rare_grams", "gram_times")}
            for some in pieces_of(texts):
                key, starts = grams(some, depth)
                value, missing = model.look_up(key)
                out["score"] += np.add.reduceat(value.astype(float), starts).tolist()
                missing.sort()
                cuts = np.searchsorted(missing, np.append(starts, len(key)))
                for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    u, n = np.unique(key[missing[at:to]], return_counts=True) if to > at else (_EMPTY, _EMPTY)
                    out["rare_grams"].append(u.view(np.int64))
                    out["gram_times"].append(n)
            for doc, held, text in zip(b["doc_id"], b["held_out"], texts, strict=True):
                split = text.split()
                part, seen, rare, times = end_part, int(ends > 0), [], []
                for w, k in Counter(split).items():
                    if (had := memo.get(w)) is None:
                        if len(memo) > 200_000:
                            memo.clear()
                        h = xxh64_intdigest(w)
                        h -= (h >> 63) << 64
                        c = known.get(h)
                        had = memo[w] = (h, None) if c is None else (h, math.log10(c + 0.1))
                    if had[1] is None:
                        rare.append(had[0])
                        times.append(k)
                    else:
                        part += k * had[1]
                        seen += k
                for name, v in zip(("row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "part", "rare", "times"), (row, doc, held, len(split) + 1, len(text), seen, part, rare, times), strict=True):
                    out[name].append(v)
                row += 1
            yield out

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, part double, score double, rare array<long>, times array<long>, rare_grams array<long>, gram_times array<long>"
    partial = table(map_rows(rows, run, schema), "scores")
    left = lambda kind, keys, times: partial.select("row", F.inline(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times")))).withColumn("kind", F.lit(kind))
    rare_grams = left(GRAM, "rare_grams", "gram_times")
    asked = found.withColumn("wanted", F.lit(False)).unionByName(rare_grams.select("key").distinct().select("key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("wanted")))
    values = words.select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value")).unionByName(gram_values(asked, top, depth).withColumn("kind", F.lit(GRAM)))
    joined = left(WORD, "rare", "times").unionByName(rare_grams).join(values, ["kind", "key"], "left")
    word = F.col("kind") == WORD
    looked_up = joined.groupBy("row").agg(
        F.sum(F.when(word & F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.when(word, F.col("times") * F.log10(F.coalesce("value", F.lit(0.0)) + F.lit(0.1))).otherwise(0.0)).alias("more"),
        F.sum(F.when(word, 0.0).otherwise(F.col("times") * F.col("value"))).alias("more_score"),
    )
    whole = partial.drop("rare", "times", "rare_grams", "gram_times").join(looked_up, "row", "left")
    log_all = math.log10(total + 0.1 * (vocabulary + 1))
    zero = F.lit(0.0)
    model_score = F.col("score") + F.coalesce("more_score", zero)
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", zero) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), model_score.alias("score"),
        (-model_score / math.log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from nine tenths of them."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
