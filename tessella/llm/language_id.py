"""Language identification by fusing evidence as a Bayesian would.

Four kinds of evidence: the text's likelihood under byte-trigram models of
each language, the language its mark-up declares, the suffix of its address
(a path or host label such as /de/ or .fr), and a prior of its host. Host
priors are smoothed in a hierarchy: a host's counts lean on its domain's, those
on the whole table's. Counts and the reliability of declarations and suffixes
come from grouped aggregation of what the texts alone say, over all rows.

A row without letters has no language. Such a row, and one whose best language
stays under `least` in probability, is rejected: lang is null.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import map_rows, revived, table

BITS = 16
#: The sample's bound: so many rows are expected at most for each language.
MAX_TRAIN = 1500
TEMPER = 0.25  # neighbouring trigrams tell much the same, so a text counts as a quarter of its trigrams
HOST_WEIGHT = 20.0
TAG = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>")
#: Elements whose content is no prose of the page.
SKIPPED = frozenset("script style noscript template svg nav header footer aside form select button".split())
LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32  # capitals tell nothing, and runs of other signs count as a space
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def prose(page: str) -> str:
    """The text of a page without mark-up, menus, scripts and the like, references decoded. One pass, however broken the page."""
    out, at, lower, open_ended = [], 0, page.lower(), set()
    while m := TAG.search(page, at):
        out += [page[at : m.start()], " "]
        at = m.end()
        name = "" if m[2] is None else m[2].lower()
        end = "-->" if not name else f"</{name}" if name in SKIPPED and not m[1] else None
        if end and end not in open_ended:
            to = lower.find(end, at)
            if to < 0:
                open_ended.add(end)  # never closed: what follows counts
            else:
                at = to + len(end)
                if name:
                    at = lower.find(">", at) + 1 or len(page)
    return entities.unescape("".join([*out, page[at:]]))


def trigrams(text: str) -> np.ndarray:
    """Table slots of the letters' byte trigrams, words parted by one space."""
    b = _FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]
    space = b == 32
    b = b[~(space & np.concatenate(([False], space[:-1])))]
    if len(b) < 3:
        return np.empty(0, np.int64)
    key = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


class TextModel:
    """languages, each one's log probability of an unseen trigram slot, and by slot the languages that have it with what it adds to that."""

    def __init__(self, languages: list[str], lang: np.ndarray, slot: np.ndarray, n: np.ndarray):
        """lang, slot, n: the counts of slots, each pair once; memory goes by their number, so a rare language costs little."""
        self.languages = languages
        totals = np.bincount(lang, n, len(languages)) + 0.05 * (1 << BITS)
        self.unseen = np.log(0.05 / totals)
        order = np.argsort(slot, kind="stable")
        self.begins = np.searchsorted(slot[order], np.arange((1 << BITS) + 1))
        self.lang, self.more = lang[order].astype(np.int32), np.log((n[order] + 0.05) / 0.05).astype(np.float32)

    def likelihood(self, text: str | None) -> list[float] | None:
        """Tempered log likelihoods in the order of the languages; None for a text without letters."""
        if not text or not LETTER.search(text):
            return None
        slots = trigrams(text)
        if not len(slots):
            return None
        first, size = self.begins[slots], self.begins[slots + 1] - self.begins[slots]
        at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        return ((np.bincount(self.lang[at], self.more[at], len(self.languages)) + len(slots) * self.unseen) * TEMPER).tolist()


def train(docs: DataFrame, label: str = "lang", max_train: int = MAX_TRAIN) -> TextModel:
    """Byte-trigram models of every label that occurs; a share of each language's rows by a hash of id and text, so that max_train are expected.

    Without any labelled row the model has no language.
    """
    per = docs.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    languages = sorted(r[label] for r in per)
    if not languages:
        return TextModel([], np.empty(0, int), np.empty(0, int), np.empty(0))
    place = {v: i for i, v in enumerate(languages)}
    limits = docs.sparkSession.createDataFrame([(r[label], place[r[label]], int(min(1.0, max_train / r["n"]) * (1 << 62))) for r in per], "__label string, lang int, __limit long")
    labelled = docs.select(F.col(label).alias("__label"), F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 62)).alias("__sample"), "text")
    taken = labelled.join(F.broadcast(limits), "__label").where("__sample < __limit").select("lang", "text")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            u, n = np.unique(np.concatenate([trigrams(text or "") + (lang << BITS) for lang, text in zip(b["lang"], b["text"], strict=True)]), return_counts=True)
            yield {"lang": (u >> BITS).tolist(), "slot": (u & ((1 << BITS) - 1)).tolist(), "n": n.tolist()}

    got = map_rows(taken, run, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    return TextModel(languages, got["lang"].to_numpy(int), got["slot"].to_numpy(int), got["n"].to_numpy(float))


def letterless(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key column of rows whose text has no letter."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {key: [k for k, t in zip(b[key], b[text], strict=True) if not t or not LETTER.search(t)]}

    return map_rows(df.select(key, text), run, df.select(key).schema)


def shares(logs: list[float] | None) -> list[float] | None:
    """The text's own posterior of each language."""
    if logs is None:
        return None
    p = np.exp(np.array(logs) - max(logs))
    return (p / p.sum()).tolist()


def identify(df: DataFrame, model: TextModel, key: list[str], text: str, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, domain: Column | None = None, markup: bool = False, least: float = 0.5) -> DataFrame:
    """The key columns of df with lang (null where rejected), confidence, text_lang, declared, suffix, host.

    Evidence may be missing as a column or be null in a row; it then says
    nothing. declared and suffix are compared in lower case by their first
    part (de-AT is de); values that are no known language say nothing. A text
    that is null, empty or without letters says nothing (text_lang is null).
    Repeated rows each have their result; an empty table gives no rows; with a
    model of no language every row is rejected. Other columns are not read.
    """
    languages, n = model.languages, len(model.languages)
    blank = F.lit(None).cast("string")
    if not languages:
        return df.select(*key, blank.alias("lang"), F.lit(0.0).alias("confidence"), blank.alias("text_lang"), blank.alias("declared"), blank.alias("suffix"), (blank if host is None else host).alias("host"))
    known = F.array(*[F.lit(v) for v in languages])
    clean = lambda c: F.when(F.array_contains(known, p := F.lower(F.split_part(c, F.lit("-"), F.lit(1)))), p)
    rows = df.select(*key, F.col(text).alias("__text"), (blank if declared is None else clean(declared)).alias("__declared"), (blank if suffix is None else clean(suffix)).alias("__suffix"), (blank if host is None else host).alias("__host"), (blank if domain is None else domain).alias("__domain"))
    sent = df.sparkSession.sparkContext.broadcast(vars(model))
    kept = [c for c in rows.columns if c != "__text"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known = revived(TextModel, sent.value)
        for b in batches:
            texts = (prose(t) if markup and t else t for t in b["__text"])
            logs = [known.likelihood(t) for t in texts]
            yield {c: b[c] for c in kept} | {"__logs": logs, "__shares": [shares(x) for x in logs]}

    schema = rows.drop("__text").schema.add("__logs", T.ArrayType(T.DoubleType())).add("__shares", T.ArrayType(T.DoubleType()))
    scored = table(map_rows(rows, run, schema), "language-evidence")
    each = [F.col("__shares")[i].alias(f"s{i}") for i in range(n)]
    sums = lambda d, *by: d.groupBy(*by).agg(*[F.sum(F.coalesce(f"s{i}", F.lit(0.0))).alias(f"s{i}") for i in range(n)])
    by_host = table(sums(scored.select("__domain", "__host", *each), "__domain", "__host"), "hosts")
    total = np.array([x or 0.0 for x in sums(by_host).first()[:n]])
    world = F.array(*[F.lit(float(x)) for x in HOST_WEIGHT * (total + 1) / (total.sum() + n)])
    # every expression grows with the number of languages, none with its square
    held = F.array(*[F.col(f"s{i}") for i in range(n)])
    domains = sums(by_host, "__domain").select(F.col("__domain").alias("d"), held.alias("__in_domain"))
    hosts = by_host.select("__domain", "__host", held.alias("__in_host")).join(domains, F.col("__domain").eqNullSafe(F.col("d")), "left").drop("d")
    hosts = hosts.withColumnsRenamed({"__domain": "d", "__host": "h"})
    joined = scored.join(hosts, F.col("__host").eqNullSafe(F.col("h")) & F.col("__domain").eqNullSafe(F.col("d")), "left").drop("d", "h")
    none = F.array_repeat(F.lit(0.0), n)
    joined = joined.withColumn("__own", F.coalesce("__shares", none))
    less_own = lambda c: F.zip_with(c, "__own", lambda x, own: F.greatest(x - own, F.lit(0.0)))
    leaning = lambda c, up: F.transform(F.zip_with(c, up, lambda x, w: x + w), lambda x: x / (F.aggregate(c, F.lit(0.0), lambda a, y: a + y) + HOST_WEIGHT))
    joined = joined.withColumns({"__in_domain": less_own("__in_domain"), "__in_host": less_own("__in_host")})
    joined = joined.withColumn("__up", F.transform(leaning(F.col("__in_domain"), world), lambda x: HOST_WEIGHT * x))
    joined = joined.withColumn("__prior", F.transform(leaning(F.col("__in_host"), F.col("__up")), lambda x: F.log(x)))
    for c in ("__declared", "__suffix"):  # tables of languages by languages
        counted = confusion(sums(scored.where(F.col(c).isNotNull()).select(c, *each), c).collect(), languages, c)
        said = df.sparkSession.createDataFrame([(v, counted[:, j].tolist(), counted.sum(1).tolist()) for j, v in enumerate(languages)], f"{c} string, {c}_said array<double>, {c}_all array<double>")
        joined = joined.join(F.broadcast(said), c, "left")
        share = F.zip_with(F.zip_with(f"{c}_said", "__own", lambda x, own: x - own), F.zip_with(f"{c}_all", "__own", lambda x, own: x - own), lambda x, y: F.log(x / y))
        joined = joined.withColumn(f"{c}_log", F.coalesce(share, none))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    posterior = joined.withColumn("__post", plus(plus(plus(F.coalesce("__logs", none), F.col("__prior")), F.col("__declared_log")), F.col("__suffix_log")))
    best = F.array_max("__post")
    confidence = F.lit(1.0) / F.aggregate("__post", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    name = lambda c: F.element_at(known, F.array_position(c, F.array_max(c)).cast("int"))
    some = F.coalesce("__logs", "__declared_said", "__suffix_said").isNotNull()
    found = posterior.withColumn("__confidence", F.when(some, confidence))
    return found.select(
        *key, F.when(F.col("__confidence") >= least, name(F.col("__post"))).alias("lang"), F.coalesce("__confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("__logs").isNotNull(), name(F.col("__logs"))).alias("text_lang"), F.col("__declared").alias("declared"), F.col("__suffix").alias("suffix"), F.col("__host").alias("host"),
    )


def confusion(rows: list, languages: list[str], column: str) -> np.ndarray:
    """How often each value (column) is said where the texts have each language (row), smoothed."""
    n = len(languages)
    counts = np.ones((n, n)) * 0.5 + np.eye(n)
    for r in rows:
        counts[:, languages.index(r[column])] += [r[f"s{i}"] for i in range(n)]
    return counts


def page_evidence(url: Column, html: Column) -> dict[str, Column]:
    """declared, suffix, host and domain of a page."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    label = F.lower(F.regexp_extract(url, r"^[^?#]*?://[^/?#]*/([a-zA-Z]{2})(?:-[a-zA-Z]{2})?(?:[/?#]|$)", 1))
    end = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return {
        "declared": F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1),
        "suffix": F.when(label != "", label).otherwise(end),
        "host": F.when(host != "", host),
        "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
    }


def op8_language(spark, sf_dir: str) -> DataFrame:
    """page_id, url and the language of all pages; text models are learnt from documents.lang."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(pages, model, ["page_id", "url"], "html", **page_evidence(F.col("url"), F.col("html")), markup=True)
