"""Near copies of the pipeline's stage against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import near_copies


def near_texts():
    """Chains of copies in which one to four words are replaced, texts that share a passage only, and edge rows."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, texts = [word() for _ in range(60)], ["", None, " \n", "a b", "A  b", "one two three four five", "one two three four five six"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.3 else base
    return texts + [" ".join([*passage, *(word() for _ in range(rng.randint(5, 60)))]) for _ in range(30)]


def brute(texts):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and group[i] != group[j]:
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    return {min(i for i, g in enumerate(group) if g == k) for k in set(group)}


@pytest.mark.parametrize("bucket", [2, 64])
def test_groups_by_brute_force(spark, bucket):
    texts = near_texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").withColumn("row", F.xxhash64("id", "text"))
    kept = near_copies.groups(rows, bucket=bucket).groupBy("component").agg(F.min("first").alias("first")).select("first.id")
    assert {r.id for r in kept.collect()} == brute(texts)
    assert near_copies.groups(rows.limit(0)).count() == 0


def test_stage_joins_pairs_beyond_three_bits(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    assert kept == {ids[i] for i in brute([texts[i] for i in ids])}
    assert not {145, 177} & kept  # 7 and 11 bits from documents 6 and 1


def test_edited_copies_meet_few_pairs(spark, monkeypatch):
    """Copies of one text with one to three edits, fewer than half of them similar to each other: groups as by all pairs, from pairs in proportion to the copies."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(500):
        copy = list(words)
        for at in rng.sample(range(150), 1 + k % 3):
            copy[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").withColumn("row", F.xxhash64("id", "text"))
    compared, verified = [], near_copies._verified

    def counted(pairs, *args):
        compared.append(pairs.distinct().count())
        return verified(pairs, *args)

    monkeypatch.setattr(near_copies, "_verified", counted)
    kept = near_copies.groups(rows).groupBy("component").agg(F.min("first").alias("first")).select("first.id")
    assert {r.id for r in kept.collect()} == brute(texts)
    assert sum(compared) <= 10 * len(texts), compared
