"""Models over vectors and features."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import sampling
from tessella.functions import vectors as V
from tessella.operators import boost
from tessella.sources.staging import staged


def fit_sample(df: DataFrame, one_in: int, seed: int, key: str = "crop_id") -> DataFrame:
    """About one row of so many, by a seeded hash."""
    return df.where(sampling.bucket(F.col(key), seed, one_in) == 0)


def fit_pca(crops: DataFrame, components: int, scale: bool = False, one_in: int = 5, seed: int = 42) -> PipelineModel:
    """Centred (and scaled) principal components, fitted on a seeded fifth, at most as many as dimensions and rows."""
    rows = fit_sample(crops.where("embedding is not null"), one_in, seed)
    head = rows.select(F.size("embedding").alias("d")).first()
    if head is None:
        raise ValueError("no vectors to fit on")
    k = min(components, head.d, rows.count())
    steps = [StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=scale), PCA(inputCol="__c", outputCol="__p", k=k)]
    return Pipeline(stages=steps).fit(rows.withColumn("__v", array_to_vector("embedding")))


def transform_pca(model: PipelineModel, crops: DataFrame) -> DataFrame:
    out = model.transform(crops.withColumn("__v", array_to_vector("embedding")))
    return out.withColumn("embedding", vector_to_array("__p")).drop("__v", "__c", "__p")


def l2(crops: DataFrame) -> DataFrame:
    """M03."""
    return crops.withColumn("embedding", V.unit(F.col("embedding"), "loose"))


def standardise_batches(crops: DataFrame) -> DataFrame:
    """Each dimension over its batch (column batch_id): less the mean, over the sample deviation + 1e-5."""
    long = crops.select("crop_id", "batch_id", F.posexplode("embedding").alias("at", "x"))
    stats = long.groupBy("batch_id", "at").agg(F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    vec = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda r: r[c])
    per = stats.groupBy("batch_id").agg(vec("m").alias("m"), vec("s").alias("s"))
    centred = F.zip_with("embedding", "m", lambda x, m: x - m)
    return crops.join(per, "batch_id").withColumn("embedding", F.zip_with(centred, "s", lambda x, s: x / (s + 1e-5))).drop("m", "s")


#: The bound of the rows that a utility model is fitted on, taken by a seeded hash of image_id.
MAX_ROWS = 50_000


def _sample(features: DataFrame, names: list[str], target: str, seed: int, most: int) -> DataFrame:
    """image_id, x (the features as doubles), y of about `most` rows at most, and fold_key (60 bits of a seeded hash)."""
    known = features.where(F.col(target).isNotNull())
    share = min(1.0, most / max(1, known.count()))
    key = sampling.bucket(F.col("image_id"), seed, 1 << 60)
    rows = known.select(F.col("image_id").cast("string").alias("image_id"), F.array(*[F.col(n).cast("double") for n in names]).alias("x"), F.col(target).cast("double").alias("y"), key.alias("fold_key"))
    return rows.where(F.pmod(F.xxhash64("fold_key"), F.lit(1 << 62)) < int(share * (1 << 62)))


def _arrays(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([[np.nan if v is None else v for v in r] for r in pdf["x"]], float).reshape(-1, width)
    return x, pdf["y"].to_numpy(float)


def fit_utility(features: DataFrame, names: list[str], target: str, rounds: int = 300, patience: int = 20, seed: int = 42, most: int = MAX_ROWS) -> boost.Boosted:
    """Boosted regression trees of a utility on features, stopped by a tenth of the rows that is held out.

    Fitted on a sample of `most` rows at most (a seeded hash of image_id), gathered on the driver.
    """
    pdf = _sample(features, names, target, seed, most).toPandas().sort_values("image_id")  # bounded by `most`
    x, y = _arrays(pdf, len(names))
    held = pdf["fold_key"].to_numpy() % 10 == 0
    if not held.any() or held.all():
        return boost.Boosted(x, y, None, rounds, patience)
    return boost.Boosted(x[~held], y[~held], (x[held], y[held]), rounds, patience)


def predict_utility(model: boost.Boosted, features: DataFrame, names: list[str]) -> DataFrame:
    """image_id, score of every row."""
    sent = features.sparkSession.sparkContext.broadcast(model.state())  # some hundred small trees

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = boost.Boosted.revived(sent.value)
        for pdf in batches:
            yield pd.DataFrame({"image_id": pdf["image_id"], "score": known.predict(pdf[names].to_numpy(float))})

    doubles = [F.col(n).cast("double").alias(n) for n in names]
    return features.select("image_id", *doubles).mapInPandas(run, features.select("image_id").schema.add("score", "double"))


def cross_validate(features: DataFrame, names: list[str], target: str, folds: int = 5, rounds: int = 300, patience: int = 20, seed: int = 42, most: int = MAX_ROWS) -> DataFrame:
    """Fold, n, rho (rank correlation on the held-out fold), rounds (kept by early stopping), gains (name, gain) of each fold.

    Folds go by a seeded hash of image_id and are fitted side by side, each on
    the same bounded sample (`most` rows).
    """
    rows = staged(_sample(features, names, target, seed, most), "utility-sample")
    each = rows.crossJoin(F.broadcast(features.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))))  # a bounded sample, once for each fold

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("image_id")
        fold = int(pdf["fold"].iloc[0])
        x, y = _arrays(pdf, len(names))
        held = pdf["fold_key"].to_numpy() % folds == fold
        model = boost.Boosted(x[~held], y[~held], (x[held], y[held]) if held.any() else None, rounds, patience)
        rho = boost.rank_correlation(model.predict(x[held]), y[held]) if held.any() else None
        gains = [{"name": n, "gain": float(g)} for n, g in zip(names, model.gains, strict=True)]
        return pd.DataFrame({"fold": [fold], "n": [int(held.sum())], "rho": [rho], "rounds": [len(model.trees)], "gains": [gains]})

    return each.groupBy("fold").applyInPandas(run, "fold int, n long, rho double, rounds int, gains array<struct<name:string,gain:double>>")


def save_model(model: boost.Boosted, spark: SparkSession, path: str) -> None:
    """SC19: a model as a table of one row, in any store that Spark writes."""
    spark.createDataFrame([(bytearray(pickle.dumps(model.state())),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> boost.Boosted:
    """SC19: what save_model wrote; load own models only."""
    return boost.Boosted.revived(pickle.loads(bytes(spark.read.parquet(path).first().model)))


def distortion(before: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change of the cosine distance of stated pairs (a, b) of crops; both stores must hold the same crops."""
    if not before.select("crop_id").join(after.select("crop_id").withColumn("__x", F.lit(1)), "crop_id", "full_outer").where("__x is null").isEmpty() or not after.join(before, "crop_id", "left_anti").isEmpty():
        raise ValueError("the stores hold different crops")

    def of(df: DataFrame, out: str) -> DataFrame:
        x, y = df.select(F.col("crop_id").alias("a"), F.col("embedding").alias("__a")), df.select(F.col("crop_id").alias("b"), F.col("embedding").alias("__b"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", V.cosine_distance(F.col("__a"), F.col("__b")).alias(out))

    both = of(before, "d0").join(of(after, "d1"), ["a", "b"])
    return both.agg(F.avg(F.abs(F.col("d1") - F.col("d0"))).alias("mean_change"), F.max(F.abs(F.col("d1") - F.col("d0"))).alias("max_change"))
