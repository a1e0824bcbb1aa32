"""Extra columns whose names clash with those that the operators use change nothing."""

import pytest
from pyspark.sql import functions as F
from test_llm import SF, edge_docs, empty_docs, sf_docs

import corpus_pipeline
from tessella.llm import decontaminate, html_main, language_id, lm_score, neighbours, packing, quality, secret_scan, simhash, token_files

NAMES = "__row __text __doc __salt __label __sample __shares key n row id name fp kind part known rare times wanted grp size prefix bins item item_id score start held_out spans lang_ declared host dim ids data f y".split()


def clashing(df):
    return df.select("*", *[F.lit(f"clash {n}").alias(n) for n in NAMES if n not in df.columns])


def told(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()), key=repr)


def language(docs):
    model = language_id.train(docs)
    return language_id.identify(docs, model, ["doc_id"], "text", declared=F.col("lang"), host=F.col("source"))


OPERATORS = {
    "op1": lambda d: decontaminate.find(d, clashing(d.sparkSession.read.parquet(f"{SF}/benchmark.parquet"))),
    "op3": lambda d: token_files.read_token_files(*token_files.write_token_files(d)).drop("start"),
    "op4": secret_scan.scan,
    "op4_redacted": lambda d: secret_scan.redacted(d).select("doc_id", "text", "n_chars"),
    "op5": lambda d: packing.pack_documents(d).drop("sequence_id", "offset"),
    "op6": lambda d: quality.score(d, quality.train(d, clashing(d.sparkSession.read.parquet(f"{SF}/labels.parquet")))),
    "op8": language,
    "op9": lm_score.score,
    "op10": simhash.near_duplicates,
}


@pytest.fixture(scope="module")
def docs(spark):
    return edge_docs(spark).unionByName(sf_docs(spark).where("doc_id between 20 and 60"))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(spark, docs, name):
    assert told(OPERATORS[name](clashing(docs))) == told(OPERATORS[name](docs))
    assert told(OPERATORS[name](clashing(empty_docs(spark)))) == []


def test_pages_and_vectors(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20)
    assert told(html_main.extract(clashing(pages))) == told(html_main.extract(pages))
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    near = lambda d: neighbours.nearest(d, F.col("vec_id") % 100 == 0)
    assert told(near(clashing(vectors))) == told(near(vectors))


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage):
    fn = dict(corpus_pipeline.STAGES)[stage]
    want, got = fn(spark, docs, SF), fn(spark, clashing(docs), SF)
    if stage != "packing":
        assert set(want.columns) == set(docs.columns) and set(got.columns) == set(clashing(docs).columns)
    names = [c for c in want.columns if c not in ("sequence_id", "offset")]
    assert told(got.select(*names)) == told(want.select(*names))
    assert told(fn(spark, clashing(empty_docs(spark)), SF)) == []
