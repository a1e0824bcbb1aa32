"""An approximate index over a pool of vectors: lists around centres, of which a query visits the nearest.

Every pool row is in the list of its nearest centre. The centres are fitted on a
bounded sample. Recall is measured against the exact search (recall_of); visiting
all lists is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import sampling
from tessella.operators import knn

#: Sampled rows for each list.
PER_LIST = 64


def fit_centres(pool: DataFrame, lists: int, seed: int = 42, steps: int = 8) -> np.ndarray:
    """Unit centres of `lists` lists by spherical k-means on about PER_LIST * lists rows, a seeded sample by crop_id."""
    pool = pool.where("embedding is not null")
    share = min(1.0, PER_LIST * lists / max(1, pool.count()))
    rows = pool.where(sampling.bucket(F.col("crop_id"), seed, 1 << 30) < int(share * (1 << 30))).orderBy("crop_id").select("embedding").toPandas()  # bounded
    if not len(rows):
        return np.empty((0, 0))
    x = knn.units_of(np.stack(rows["embedding"]).astype(float))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(steps):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = np.bincount(near, minlength=len(centres)) > 0
        centres = np.where(filled[:, None], knn.units_of(sums), centres)
    return centres


def _listed(df: DataFrame, centres: np.ndarray, visits: int) -> DataFrame:
    """crop_id, embedding, list: a row for each of the `visits` nearest centres."""
    sent = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = np.argsort(-(knn.units_of(np.stack(pdf["embedding"]).astype(float)) @ sent.value.T), axis=1)[:, :visits]
                pdf = pdf.loc[pdf.index.repeat(near.shape[1])].assign(list=near.ravel())
                yield pdf

    return df.where("embedding is not null").select("crop_id", "embedding").mapInPandas(run, "crop_id long, embedding array<float>, list int")


def nearest(queries: DataFrame, pool: DataFrame, centres: np.ndarray, k: int, visits: int) -> DataFrame:
    """query_id, crop_id, dist, rank: the k least cosine distances among the visited lists, ties to the smaller id.

    An equality join on the list, in blocks; a long list is dealt to several
    cells. Each cell's best k are merged by a ranking. Query ids must be unique.
    """
    salts = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, len(centres)))
    salt = F.pmod(F.col("name"), F.lit(salts)).cast("int")
    held = knn.blocks(_listed(pool, centres, 1), knn.POOL_BLOCK, 0, "list").select(F.col("grp").alias("q"), salt.alias("p"), "data")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("p")
    asked = knn.blocks(_listed(queries, centres, visits), knn.QUERY_BLOCK, 0, "list").select(F.col("grp").alias("q"), every, "name", "data")
    found = knn.meet(asked, held, lambda b: knn.Similar(b, k), knn.SIMILAR).select(F.col("fp_id").alias("query_id"), "crop_id", (1 - F.col("sim")).alias("dist"))
    w = W.partitionBy("query_id").orderBy("dist", "crop_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def visits_for(pool: DataFrame, centres: np.ndarray, k: int, least: float = 0.95, sample: int = 500, seed: int = 42) -> int:
    """The fewest lists to visit that find the share `least` of the k true neighbours of about `sample` pool rows, measured by the exact search."""
    pool = pool.where("embedding is not null")
    share = min(1.0, sample / max(1, pool.count()))
    asked = pool.where(sampling.bucket(F.col("crop_id"), seed + 1, 1 << 30) < int(share * (1 << 30))).select("crop_id", "embedding")
    near = knn.top_similar(pool, asked, k + 1).where("fp_id <> crop_id").join(pool.select("crop_id", F.col("embedding").alias("found")), "crop_id")
    rows = near.join(asked.select(F.col("crop_id").alias("fp_id"), "embedding"), "fp_id").select("embedding", "found").toPandas()  # bounded: k for each sampled row
    if not len(rows):
        return len(centres)
    asks, finds = (knn.units_of(np.stack(rows[c]).astype(float)) @ centres.T for c in ("embedding", "found"))
    home = finds.argmax(1)
    visit = (asks > asks[np.arange(len(home)), home][:, None]).sum(1) + 1  # the place of the neighbour's list in the query's order
    return int(np.sort(visit)[min(len(visit) - 1, int(np.ceil(least * len(visit))) - 1)])


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, crop_id) that were found."""
    hit = exact.join(found.select("query_id", "crop_id"), ["query_id", "crop_id"], "left_semi").count()
    return hit / max(1, exact.count())
