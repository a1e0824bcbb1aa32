"""Benchmark decontamination: rare n-gram seeds join texts to test items, local alignment scores them.

A seed is the shortest run of two to eight words of an item, from each of its
words on, that is rare: by the words' shares in the corpus it would occur no
more than EXPECTED times in all of it by chance, so the runs grow with the
corpus. (Shares of single words decide, not counts of the run: a leaked passage
may stand in a third of all texts.) The runs of all texts meet the seeds in an
equality join; a filter of bounded size, which knows the seeds' keys, keeps the
others out of it. Around the seeds that a text shares with an item, the two are
aligned by Smith-Waterman over words, match 1, mismatch and gap -1.

Words are 64-bit hashes throughout, computed over many texts at once. Neither
items nor seeds nor words are gathered on the driver; any number of items is one
pass over the texts for the words' counts and one for the runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import map_rows, powers, table

LONGEST = 8
EXPECTED = 0.05
#: An alignment counts from this share of the item's words on, or from so many words on, whatever the item's length.
LEAST, LONG = 0.5, 16
FILTER_BITS = 24
CHUNK = 1 << 20  # code points that are hashed at once
NOT_WORD = re.compile(r"\W")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_MIX = np.random.default_rng(17).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)


def folded(text: str) -> str:
    """The text in lower case, of the same length; signs but letters, digits and _ outside ASCII are blank."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return lower if lower.isascii() else NOT_WORD.sub(" ", lower)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in order: hash, first code point and end within the text; and where each text's words begin, with the number of all at the end."""
    plain = [folded(t or "") for t in texts]
    joined = "\n".join([*plain, ""])
    b = np.frombuffer(joined.encode(), np.uint8)
    inside = _IN_WORD[b]
    first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    last = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    size = last - first
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(begin, size)
    h = np.add.reduceat(_MIX[b[inside]] * powers(at), begin) if len(first) else np.empty(0, np.uint64)
    h = (h ^ (h >> np.uint64(29))) * _GOLD
    if len(joined) != len(b):
        point = np.cumsum((b & 0xC0) != 0x80)
        first, last = point[first] - 1, point[last - 1]
    bases = np.cumsum([0, *(len(p) + 1 for p in plain)])
    cuts = np.searchsorted(first, bases)
    base = np.repeat(bases[:-1], np.diff(cuts))
    return h ^ (h >> np.uint64(32)), first - base, last - base, cuts


def runs(h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """n and the keys of all runs of n words, for n of 1 to LONGEST."""
    key = np.full(len(h), np.uint64(0x5851F42D4C957F2D))
    for n in range(1, LONGEST + 1):
        if len(h) < n:
            return
        key = (key[: len(h) - n + 1] ^ h[n - 1 :]) * _GOLD
        key ^= key >> np.uint64(29)
        yield n, key


def seeds_of(h: np.ndarray, log_share: np.ndarray, rare: float) -> list[tuple[int, int, int]]:
    """key, length and place of an item's seeds; an item without a rare run has its first words."""
    if not len(h):
        return []
    total = np.concatenate(([0.0], np.cumsum(log_share)))
    keys = dict(runs(h))
    out = []
    for at in range(len(h)):
        n = next((n for n in range(2, LONGEST + 1) if at + n > len(h) or total[at + n] - total[at] <= rare), LONGEST)
        if at + n <= len(h):
            out.append((int(keys[n][at]), n, at))
    n = min(len(h), LONGEST)
    return out or [(int(keys[n][0]), n, 0)]


def slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a key in the filter."""
    shift = np.uint64(64 - FILTER_BITS)
    return (key >> shift).astype(np.int64), ((key * _GOLD) >> shift).astype(np.int64)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of a (item) in b: score and where it ends in each (exclusive)."""
    best, end_a, end_b = 0, 0, 0
    slope = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for i, w in enumerate(a):
        now = np.zeros(len(b) + 1, np.int64)
        np.maximum(row[:-1] + np.where(b == w, 1, -1), row[1:] - 1, out=now[1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope) - slope  # gaps along the text
        j = int(now.argmax())
        if now[j] > best:
            best, end_a, end_b = int(now[j]), i + 1, j
        row = now
    return best, end_a, end_b


def matches(item: np.ndarray, part: np.ndarray, diagonals: list[int], least: float, long: int) -> list[tuple[float, int, int]]:
    """Score, first and last word (exclusive) of the item's alignments in the part of a text around these diagonals (place in the text less place in the item); of those that overlap the best."""
    found, slack = [], len(item) // 4 + 2
    diagonals = sorted(set(diagonals))
    begin = 0
    for k in range(1, len(diagonals) + 1):
        if k < len(diagonals) and diagonals[k] - diagonals[k - 1] <= slack and diagonals[k] - diagonals[begin] <= 4 * len(item):
            continue
        low, high = max(0, diagonals[begin] - slack), min(len(part), diagonals[k - 1] + len(item) + slack)
        begin = k
        score, end_a, end_b = align(item, part[low:high])
        if score >= min(least * len(item), long):
            _, _, back = align(item[:end_a][::-1], part[low : low + end_b][::-1])
            found.append((score / len(item), low + end_b - back, low + end_b))
    kept: list[tuple[float, int, int]] = []
    for m in sorted(found, key=lambda m: (-m[0], m[1])):
        if all(m[2] <= x[1] or m[1] >= x[2] for x in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[1])


def pieces_of(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in lists of about CHUNK code points, each with the place of its first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK or i + 1 == len(texts):
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bits(keys: DataFrame) -> np.ndarray:
    """The filter of the keys (column key): 2^FILTER_BITS places, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(slots(b.column(0).to_numpy().view(np.uint64)))))], names=["at"])

    known = np.zeros(1 << FILTER_BITS, bool)
    at = keys.select("key").mapInArrow(run, "at long").distinct().toArrow()
    known[at["at"].combine_chunks().to_numpy()] = True
    return known


def _item_words(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id, words (their hashes) of every distinct item that has a word."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        item = TaskContext.get().partitionId() << 36
        for b in batches:
            out: dict[str, list] = {"item": [], "item_id": [], "words": []}
            for i, t in zip(b["item_id"], b["text"], strict=True):
                if len(h := hashed([t])[0]):
                    for k, v in zip(out, (item, i, _signed(h)), strict=True):
                        out[k].append(v)
                    item += 1
            yield out

    return table(map_rows(benchmark.select("item_id", "text").distinct(), run, "item long, item_id long, words array<long>"), "items")


def _counted(docs: DataFrame, words: DataFrame) -> DataFrame:
    """word, n over all texts: of the words (column word), and in a row of a null word the number of all."""
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(_bits(words.select(F.col("word").alias("key")))))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bits, every = np.unpackbits(known.value).astype(bool), 0
        for b in batches:
            for _, texts in pieces_of(b["text"]):
                h = hashed(texts)[0]
                every += len(h)
                one, two = slots(h)
                u, n = np.unique(h[bits[one] & bits[two]], return_counts=True)
                yield {"word": _signed(u), "n": n}
        yield {"word": [None], "n": [every]}

    return map_rows(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _seeds(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key, length, item, at of the rare runs of all items."""
    words = items.select("item", F.posexplode("words").alias("at", "word"))
    counted = table(_counted(docs, words), "word-counts")
    whole = max(1, (counted.where("word is null").first() or {"n": 0})["n"])
    rare = np.log10(EXPECTED / whole)
    share = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(whole)))
    known = words.join(counted, "word", "left").select("item", F.struct("at", "word", share.alias("share")).alias("w"))
    rows = known.groupBy("item").agg(F.array_sort(F.collect_list("w")).alias("w")).select("item", F.col("w.word").alias("words"), F.col("w.share").alias("shares"))  # bounded: the words of one item

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"key": [], "length": [], "item": [], "at": []}
            for item, w, shares in zip(b["item"], b["words"], b["shares"], strict=True):
                for key, n, at in seeds_of(np.array(w, np.int64).view(np.uint64), np.array(shares), rare):
                    for k, v in zip(out, (key - (key >> 63 << 64), n, item, at), strict=True):
                        out[k].append(v)
            yield out

    return table(map_rows(rows, run, "key long, length int, item long, at int"), "seeds")


def find(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, long: int = LONG, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns `keep`), item_id, score, start, end for every place of a text that aligns with an item; start and end are code points.

    The score is the alignment's over the item's words: 1 is a whole copy. A
    place counts from `least` on, or if at least `long` words align. Null and
    empty texts and items align with nothing; an item without an id is reported
    with a null item_id. Repeated rows of a text each have their rows; items that
    repeat with their id count once. Without texts or items there are no rows.
    Columns but text, `keep`, item_id are not read.
    """
    keep = keep or ["doc_id"]
    items = _item_words(benchmark)
    seeds = _seeds(docs, items)
    facts = seeds.agg(F.collect_set("length").alias("lengths")).first()
    lengths = set(facts.lengths)  # eight at most
    reach = items.agg(F.max(F.size("words"))).first()[0] or 0
    reach += reach // 4 + LONGEST + 2
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(_bits(seeds)))
    schema = docs.select(*keep).schema.add("__doc", "long").add("__part", "integer").add("__data", "binary").add("__keys", T.ArrayType(T.LongType())).add("__places", T.ArrayType(T.IntegerType()))

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        bits, doc = np.unpackbits(known.value).astype(bool), TaskContext.get().partitionId() << 36
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for offset, texts in pieces_of(b["__text"]):
                h, start, end, cuts = hashed(texts)
                text = np.repeat(np.arange(len(texts)), np.diff(cuts))
                places, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for n, key in runs(h):
                    if n in lengths:
                        one, two = slots(key)
                        at = np.flatnonzero(bits[one])
                        at = at[bits[two[at]] & (text[at] == text[at + n - 1])]
                        places.append(at)
                        keys.append(key[at])
                place, key = np.concatenate(places), np.concatenate(keys)
                order = np.argsort(place, kind="stable")
                place, key = place[order], key[order]
                # a new part begins with another text, or where the reaches of two hits do not touch
                new = np.ones(len(place), bool)
                new[1:] = (text[place[1:]] != text[place[:-1]]) | (place[1:] - place[:-1] > 2 * reach)
                begins = [*np.flatnonzero(new).tolist(), len(place)]
                for x, y in zip(begins, begins[1:]):
                    i = int(text[place[x]])
                    low, high = max(cuts[i], place[x] - reach), min(cuts[i + 1], place[y - 1] + reach)
                    for c in keep:
                        out[c].append(b[c][offset + i])
                    data = np.concatenate((_signed(h[low:high]), start[low:high], end[low:high]))
                    for c, v in zip(("__doc", "__part", "__data", "__keys", "__places"), (doc + offset + i, int(low - cuts[i]), data.tobytes(), _signed(key[x:y]), (place[x:y] - low).astype(np.int32)), strict=True):
                        out[c].append(v)
            doc += len(b["__text"])
            yield out

    parts = table(map_rows(docs.select(*keep, F.col("text").alias("__text")), scan, schema), "seeded-parts")
    hits = parts.select("__doc", "__part", F.inline(F.arrays_zip(F.col("__keys").alias("key"), F.col("__places").alias("place"))))
    pairs = hits.join(seeds, "key").groupBy("__doc", "__part", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("__diagonals"))  # bounded: places of one text
    both = pairs.join(items, "item").join(parts.drop("__keys", "__places"), ["__doc", "__part"]).select(*keep, "item_id", F.col("words").alias("__words"), "__data", "__diagonals")
    fields = docs.select(*keep).schema.add("item_id", "long").add("score", "double").add("start", "long").add("end", "long")

    def aligned(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in fields}
            for i, (words, data, diagonals) in enumerate(zip(b["__words"], b["__data"], b["__diagonals"], strict=True)):
                part, start, end = np.frombuffer(data, np.int64).reshape(3, -1)
                for score, first, last in matches(np.array(words, np.int64), part, diagonals, least, long):
                    row = [*(b[c][i] for c in keep), b["item_id"][i], score, int(start[first]), int(end[last - 1])]
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
            yield out

    return map_rows(both, aligned, fields)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Places of documents that align with benchmark items."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
