"""Languages beyond the most frequent ones, and corpora without any label."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import language_id

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_label_is_learnt(spark):
    rng = random.Random(3)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefghij"]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for x in names}
    text = lambda x: " ".join(rng.choice(words[x]) for _ in range(40))
    rows = [(i, text(x), x, "s", 1) for i, x in enumerate(x for k, x in enumerate(names) for _ in range(2 + (k < 64)))]  # the last 16 are the rarest
    docs = spark.createDataFrame(rows, DOC)
    model = language_id.train(docs)
    assert model.languages == names
    got = language_id.identify(docs, model, ["doc_id", "lang"], "text", declared=F.col("lang"), host=F.col("source")).toDF("doc_id", "true", "lang", "confidence", "text_lang", "declared", "suffix", "host").collect()
    assert len(got) == len(rows) and all(r.true == r.lang == r.text_lang == r.declared for r in got)


def test_stage_without_labels_drops_letterless_texts(spark):
    import corpus_pipeline

    texts = [None, "", " 12 !!", "a", "çà 3", "½ _"]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], DOC)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert kept == {i for i, t in enumerate(texts) if t and language_id.LETTER.search(t)}
    assert not {0, 1, 2} & kept and {3, 4} <= kept


def fused(rows, model, columns):
    """The posterior of each row, one after the other, from the definition: prior of host over domain over table, each without the row."""
    n, w = len(model.languages), language_id.HOST_WEIGHT
    logs = [model.likelihood(r["text"]) for r in rows]
    own = [np.zeros(n) if x is None else np.array(language_id.shares(x)) for x in logs]
    whole = sum(own)
    world = (whole + 1) / (whole.sum() + n)
    out = []
    for i, r in enumerate(rows):
        others = [k for k in range(len(rows)) if k != i]
        in_domain = sum((own[k] for k in others if rows[k]["domain"] == r["domain"]), np.zeros(n))
        in_host = sum((own[k] for k in others if rows[k]["domain"] == r["domain"] and rows[k]["host"] == r["host"]), np.zeros(n))
        up = (in_domain + w * world) / (in_domain.sum() + w)
        post = np.log((in_host + w * up) / (in_host.sum() + w)) + (0 if logs[i] is None else np.array(logs[i]))
        for c in columns:
            if r[c] in model.languages:
                counts = np.ones((n, n)) * 0.5 + np.eye(n)
                for k in others:
                    if rows[k][c] in model.languages:
                        counts[:, model.languages.index(rows[k][c])] += own[k]
                v = model.languages.index(r[c])
                post = post + np.log(counts[:, v] / (counts.sum(1)))
        p = np.exp(post - post.max())
        says = logs[i] is not None or any(r[c] in model.languages for c in columns)
        out.append((p / p.sum()).max() if says else 0.0)
    return out


def test_fusion_by_definition(spark):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs)
    texts = [r.text for r in docs.select("text").limit(40).collect()]
    rows = []
    for i in range(60):
        text = rng.choice([None, "", "12 34", *[t[: rng.randint(3, 60)] for t in rng.sample([t for t in texts if t], 12)]])
        d = rng.choice(["a.org", "b.com", None])
        rows.append({"id": i, "text": text, "declared": rng.choice([None, "de", "en", "xx", "fr"]), "suffix": rng.choice([None, "es", "de", "zz"]), "host": d and rng.choice(["x.", "y."]) + d, "domain": d})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, text string, declared string, suffix string, host string, domain string")
    found = language_id.identify(df, model, ["id"], "text", F.col("declared"), F.col("suffix"), F.col("host"), F.col("domain"))
    got = {r.id: r for r in found.collect()}
    for r, want in zip(rows, fused(rows, model, ["declared", "suffix"]), strict=True):
        assert abs(got[r["id"]].confidence - want) < 1e-9, r
        assert (got[r["id"]].lang is None) == (want < 0.5)


def test_accuracy_on_rows_not_learnt_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    held = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    model = language_id.train(docs.where(~held), max_train=100)
    rows = language_id.identify(docs.where(held).withColumnRenamed("lang", "true"), model, ["true"], "text").collect()
    assert len(rows) > 200 and sum(r.true == r.lang for r in rows) / len(rows) > 0.95


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    for d in (docs, docs.limit(0)):
        model = language_id.train(d)
        assert model.languages == []
        assert [(r.lang, r.confidence) for r in language_id.identify(d, model, ["doc_id"], "text").collect()] == [(None, 0.0)] * d.count()


def test_prose_leaves_out_menus_and_broken_mark_up():
    page = "<nav><a>Home</a></nav><p>Caf&eacute; &amp; tea<script>var x</script><!-- no --> end<nav>open" + "<script" * 3 + "<style>" * 50_000
    assert language_id.prose(page).split() == ["Café", "&", "tea", "end", "open"]
    assert language_id.prose("a < b <!-- x").split() == ["a", "<", "b", "x"]
