"""From crops to images: scores and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators.pool import DEFAULT_WEIGHT
from tessella.operators.ranking import average_rank, correlation

AGGREGATIONS = ("max", "min", "sum", "mean", "crop_weighted", "class_weighted_sum")


def by_image(scores: DataFrame, how: str = "max", weights: DataFrame | None = None, *by: str) -> DataFrame:
    """image_id, further columns `by`, score of crop scores (image_id, cls, score). weights (cls, weight) serve class_weighted_sum; unseen classes weigh 100."""
    s = F.col("score")
    if how == "class_weighted_sum":
        # one row for each class
        scores = scores.join(F.broadcast(weights), "cls", "left")
        return scores.groupBy("image_id", *by).agg(F.sum(s * F.coalesce("weight", F.lit(DEFAULT_WEIGHT))).alias("score"))
    forms = {"max": F.max(s), "min": F.min(s), "sum": F.sum(s), "mean": F.avg(s), "crop_weighted": F.avg(s) * F.sqrt(F.count(s))}
    if how not in forms:
        raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
    return scores.groupBy("image_id", *by).agg(forms[how].alias("score"))


def vector_features(crops: DataFrame) -> DataFrame:
    """Length of the mean vector, mean spread of the dimensions and mean distance between an image's crops.

    The mean distance of all pairs follows from the length of the sum of unit
    vectors, so no pair is built: (n^2 - |sum|^2) / (n (n - 1)).
    """
    raw = crops.select("image_id", F.posexplode("embedding").alias("at", "x")).groupBy("image_id", "at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    mean = raw.groupBy("image_id").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("mean_vec_norm"), F.avg("sd").alias("mean_dim_std"))
    unit = crops.select("image_id", F.posexplode(V.unit(F.col("embedding"))).alias("at", "x")).groupBy("image_id", "at").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    spread = unit.groupBy("image_id").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    intra = spread.select("image_id", F.when(F.col("n") > 1, (F.col("n") * F.col("n") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("intra_dist"))
    return mean.join(intra, "image_id")


def proxy_features(distances: DataFrame, crops: DataFrame) -> DataFrame:
    """Ten features of each image; distances: image_id, score."""
    s = F.col("score")
    d = distances.groupBy("image_id").agg(
        F.count(s).alias("n_crops"), F.max(s).alias("max_dist"), F.min(s).alias("min_dist"), F.avg(s).alias("mean_dist"),
        F.stddev_pop(s).alias("std_dist"), F.sum(s).alias("sum_dist"), F.percentile(s, 0.5).alias("median_dist"),
    )
    return d.join(vector_features(crops), "image_id")


def prefix_features(distances: DataFrame, names: list[str]) -> DataFrame:
    """Count; max, mean, sum and spread of each prefix's distance; steps between prefixes; spread over prefixes; agreement of their orders.

    distances: image_id, crop_id and a column for each prefix, coarse to fine.
    """
    cols = [F.col(n) for n in names]
    rows = distances.withColumn("__var", V.variance(cols))
    aggs = [F.count(F.lit(1)).alias("n_crops")]
    for n in names:
        aggs += [F.max(n).alias(f"max_{n}"), F.avg(n).alias(f"mean_{n}"), F.sum(n).alias(f"sum_{n}"), F.stddev_pop(n).alias(f"std_{n}")]
    for a, b in zip(names, names[1:]):
        aggs += [F.avg(F.col(b) - F.col(a)).alias(f"diff_mean_{a}_{b}"), F.stddev_pop(F.col(b) - F.col(a)).alias(f"diff_std_{a}_{b}")]
    aggs += [F.avg("__var").alias("var_mean"), F.max("__var").alias("var_max"), F.sum("__var").alias("var_sum")]
    ranked = average_rank(average_rank(distances, names[0], "__r0", "image_id"), names[-1], "__r1", "image_id")
    agree = ranked.groupBy("image_id").agg(F.when(F.count(F.lit(1)) > 2, correlation("__r0", "__r1")).alias("c"))
    return rows.groupBy("image_id").agg(*aggs).join(agree, "image_id").withColumn("scale_consistency", F.coalesce("c", F.lit(0.0))).drop("c")


def model_features(distances: DataFrame, names: list[str], labeled_images: int, start: float, stop: float, pool: int = 16551) -> DataFrame:
    """Features of the learned selection model: count, range of fractions, labelled share, four statistics of each prefix, spread."""
    rows = distances.withColumn("__var", V.variance([F.col(n) for n in names]))
    aggs = [F.count(F.lit(1)).alias("n_crops")]
    for n in names:
        aggs += [F.max(n).alias(f"max_{n}"), F.avg(n).alias(f"mean_{n}"), F.sum(n).alias(f"sum_{n}"), F.stddev_pop(n).alias(f"std_{n}")]
    aggs += [F.avg("__var").alias("var_mean"), F.max("__var").alias("var_max"), F.sum("__var").alias("var_sum")]
    return rows.groupBy("image_id").agg(*aggs).withColumns({"from_frac": F.lit(start), "to_frac": F.lit(stop), "pool_ratio": F.lit(labeled_images / pool)})


def best_crop(scores: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The best crop of each image, then the best k images; ties to the smaller ids."""
    order = F.asc("score") if ascending else F.desc("score")
    first = scores.withColumn("__n", F.row_number().over(W.partitionBy("image_id").orderBy(order, "crop_id"))).where("__n = 1").drop("__n")
    return first.orderBy(order, "image_id").limit(k)
