"""The corpus pipeline: documents through language ID, near-dedup, decontamination, secret removal and packing.

Each stage is a function of (spark, docs, sf_dir); it works on all rows that
the one before has kept, and its output is written and read again before the
next begins. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, language_id, near_copies, packing, secret_scan
from tessella.llm.common import once, sent, table


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a further column, whose name they lack, of 16 bytes that name a row by its id and text; rows that share both get the same verdict."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    known = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.when(F.col("text").isNull(), "/").otherwise(":"), F.coalesce("text", F.lit("")))
    return docs.withColumn(name, F.unhex(F.md5(known))), name


def _without(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The marked docs less those whose mark is in rows, without the mark."""
    return docs.join(sent(table(rows.select(name).distinct(), "rejected")), name, "left_anti").drop(name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letters, or no language with half of the probability.

    lang counts as declared, the source as the host. Null and empty texts have
    no letters and go. Where no row has a lang no language can be learnt, and
    only texts without letters are dropped. Repeated rows stay, each; an empty
    table stays empty; further columns stay as they are.
    """
    marked, row = _marked(docs)
    if docs.where("lang is not null").isEmpty():
        return _without(marked, language_id.letterless(marked, row, "text"), row)
    found = language_id.identify(marked, language_id.train(docs), [row], "text", declared=F.col("lang"), host=F.col("source"))
    return _without(marked, found.where("lang is null or text_lang is null"), row)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 0.8 Jaccard similarity of five-word shingles: the one of the least id (nulls last), of rows that share it the one of the least mark.

    Texts without words, null ones among them, are one group. A row that
    repeats whole stays once. Without rows there is no group; further columns stay.
    """
    marked, row = _marked(docs)
    found = near_copies.groups(marked.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), "text"))
    kept = table(found.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)), "kept")
    return once(marked, row).join(sent(kept), row, "left_semi").drop(row)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, whole or edited, or a long run of one.

    Null and empty texts hold none and stay; of repeated rows all go or all
    stay; without items or rows nothing goes; further columns stay.
    """
    marked, row = _marked(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(marked, decontaminate.find(marked, benchmark, keep=[row]), row)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts and counts n_chars again; no document is dropped. Null and empty texts, repeated rows and further columns stay as they are."""
    return secret_scan.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens: the columns of packing.pack_documents. Null and empty texts are the end id alone, repeated rows are each packed, no rows make no pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to the written output of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL has no byte-pair encoding, so no stage list of this kind can be written in it.
ORACLE_SQL = None
