"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Features are hashed indicators: byte n-grams of two to four bytes, words, and
n-grams over a coarse view of the words (repeat of the word before, kind of
the first and the last character), so that junk made of unseen words is seen
too. Ratios, weights (dual coordinate descent) and the calibration to
probabilities are fitted on a bounded sample of labelled rows; every text is
scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import crc_mod, map_rows, powers, revived, worker_cache

BITS = 18
#: The sample's bound: so many labelled rows are expected at most.
MAX_TRAIN = 6000
PENALTY = 1.0
_KIND = np.zeros(256, np.uint8)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 3
for _i, _c in enumerate(b"!?.,;:|#$%&*+-=/<>()[]{}@~^_\"'"):
    _KIND[_c] = 4 + _i
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)


def _slot(x: np.ndarray, salt: int) -> np.ndarray:
    return ((x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """The distinct feature numbers of a text. An empty text has one of its own, number 0."""
    b = np.frombuffer((text or "").encode(), np.uint8)
    if not len(b):
        return np.zeros(1, np.int64)
    x = b.astype(np.uint64)
    found = []
    gram = x
    for n in (2, 3, 4):
        if len(b) >= n:
            gram = (gram[:-1] << np.uint64(8)) | x[n - 1 :]
            found.append(_slot(gram, n << 40))
    space = _SPACE[b]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if len(first):
        last = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
        at = np.arange(len(b)) - np.repeat(np.concatenate(([0], first[1:])), np.diff(np.concatenate(([0], first[1:], [len(b)]))))
        hashed = np.where(space, np.uint64(0), _MIX[b] * powers(at))
        words = np.add.reduceat(hashed, first)
        again = np.concatenate(([False], words[1:] == words[:-1]))
        view = np.where(again, 1, 2 + _KIND[b[first]].astype(np.uint64) * np.uint64(64) + _KIND[b[last]]).astype(np.uint64)
        found.append(_slot(words, 5 << 40))
        for n in (1, 2, 3, 5):
            if len(view) >= n:
                gram = view[: len(view) - n + 1]
                for k in range(1, n):
                    gram = gram * np.uint64(8191) + view[k : len(view) - n + 1 + k]
                found.append(_slot(gram, (8 + n) << 40))
    return _distinct(np.concatenate(found)) if found else np.ones(1, np.int64)


def _distinct(slots: np.ndarray) -> np.ndarray:
    """Without sorting: of equal slots the last position stays in the table."""
    cache = worker_cache()
    if "slots" not in cache:
        cache["slots"] = np.zeros(1 << BITS, np.int32)
    at = np.arange(len(slots), dtype=np.int32)
    cache["slots"][slots] = at
    return slots[cache["slots"][slots] == at]


class Model:
    """weights by feature number, bias, and the slope and intercept of the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, intercept: float):
        self.weights, self.bias, self.slope, self.intercept = weights, bias, slope, intercept

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum(dtype=np.float64) / np.sqrt(len(row)) + self.bias)

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.intercept, -50, 50))))


def fit(rows: list[np.ndarray], y: np.ndarray, blend: float = 0.75) -> Model:
    """y: 1 or 0. With one class only, every score is that class's smoothed share."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))

    def train(index: np.ndarray) -> tuple[np.ndarray, float]:
        counts = np.ones((2, 1 << BITS))
        for i in index:
            counts[y[i]][rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        w, bias, _ = hinge_weights(rows, index, ratio, y)
        mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
        return ((1 - blend) * mean + blend * w) * ratio, bias

    at = np.arange(len(rows))
    raw = np.zeros(len(rows))
    for fold in range(3):  # margins for the calibration come from models that have not seen the row
        held = at % 3 == fold
        if len(set(y[~held].tolist())) == 2:
            part = Model(*train(at[~held]), 1.0, 0.0)
            raw[held] = [part.margin(rows[i]) for i in at[held]]
    w, bias = train(at)
    slope, intercept = _calibrate(raw, y)
    return Model(w.astype(np.float32), bias, slope, intercept)


def hinge_weights(rows: list[np.ndarray], index: np.ndarray, ratio: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 200, tolerance: float = 0.01) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of a linear model under hinge loss, by dual coordinate descent.

    Each indicator weighs its ratio / sqrt(features of the row). A row's dual
    variable lies between 0 and its cost, the penalty over its class's share.
    Rounds go over the rows in random order until no step violates the
    conditions of the optimum by more than the tolerance.
    """
    w, bias, rng = np.zeros(len(ratio)), 0.0, np.random.default_rng(0)
    values = [ratio[rows[i]] / np.sqrt(len(rows[i])) for i in index]
    sign = np.where(y[index] > 0, 1.0, -1.0)
    cost = penalty * np.where(sign > 0, len(index) / (2 * (sign > 0).sum()), len(index) / (2 * (sign < 0).sum()))
    alpha, norm = np.zeros(len(index)), np.array([v @ v + 1 for v in values])
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(index)):
            row = rows[index[i]]
            gradient = sign[i] * (w[row] @ values[i] + bias) - 1
            beyond = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost[i] else gradient
            if beyond:
                worst = max(worst, abs(beyond))
                step = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i]) - alpha[i]
                alpha[i] += step
                w[row] += step * sign[i] * values[i]
                bias += step * sign[i]
        if worst < tolerance:
            break
    return w, bias, alpha


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on the margin with smoothed targets, by Newton's method."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([((p - target) * margin).sum() + 1e-6 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, max_train: int = MAX_TRAIN) -> Model:
    """Learns from labelled rows outside the held-out fold; of repeated labels of an id the mean decides.

    Of more than max_train such rows a share is taken by a hash of the id, so
    that max_train are expected.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != 0)).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("__y"))
    share = min(1.0, max_train / max(1, known.count()))
    taken = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 62)) < int(share * (1 << 62)))
    # bounded: about max_train rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "y": b["__y"], "f": [features(t).astype("<i4").tobytes() for t in b["text"]]}

    got = sorted(((r.doc_id, bytes(r.f), r.y) for r in map_rows(rows, run, "doc_id long, y int, f binary").toLocalIterator()))
    if not got:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 0.0)
    return fit([np.frombuffer(f, "<i4").astype(np.int64) for _, f, _ in got], np.array([y for _, _, y in got]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of doc_id, text.

    Null and empty texts share one score; repeated rows each have theirs; an
    empty table gives no rows; other columns are not read.
    """
    blob = docs.sparkSession.sparkContext.broadcast(vars(model))  # 2^18 weights, whatever the input

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = revived(Model, blob.value)
        for b in batches:
            scores = [m.score(features(t)) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_rows(docs.select("doc_id", "text", (crc_mod("doc_id", folds) == 0).alias("held_out")), run, "doc_id long, held_out boolean, score double, predicted int")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels.quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
