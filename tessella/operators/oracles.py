"""Utilities of images from their annotations. An image without boxes scores 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.pool import class_histogram, pool_stats
from tessella.operators.ranking import ordinal_percentile
from tessella.sources.staging import staged

def _rarity(eps: float) -> Column:
    return 1 / (F.coalesce(F.col("c"), F.lit(0)) / F.greatest(F.col("total_boxes"), F.lit(1)) + eps)


def _deviation() -> Column:
    return F.abs(F.col("a") - F.col("avg_area"))


def forms(classes: int = 20) -> dict[str, Callable[[], Column]]:
    """Expressions over an image's boxes (cls, a), the class counts c and the pool's statistics."""
    n, u = F.count("cls"), F.count_distinct("cls")
    return {
        "density": lambda: n * (1 + u / classes),
        "class_balance": lambda: F.sum(_rarity(0.001)),
        "diversity": lambda: u * u + 10 * F.coalesce(F.stddev_pop("a"), F.lit(0.0)) + 5 * F.avg(_deviation()),
        "combined": lambda: F.sum(_rarity(0.01)) + 2 * u + 0.5 * n + 5 * F.sum(_deviation()) / F.greatest(n, F.lit(1)),
        "balanced": lambda: 0.5 * n + 0.3 * F.avg(_rarity(0.01)) + 2 * u,
        "balanced_v1": lambda: 0.5 * n + 0.3 * F.avg(_rarity(0.001)) + 2 * u,
    }


def oracle(name: str, images: DataFrame, boxes: DataFrame, pool: DataFrame, classes: int = 20) -> DataFrame:
    """image_id, score of the images; the statistics come from the pool's images."""
    in_pool = boxes.join(pool.select("image_id"), "image_id", "left_semi")
    stats, counts = pool_stats(pool, boxes), class_histogram(in_pool).withColumnRenamed("n", "c")
    # one row, and one for each class
    rows = boxes.withColumn("a", F.col("w") * F.col("h")).join(F.broadcast(counts), "cls", "left").join(F.broadcast(stats))
    scored = rows.groupBy("image_id").agg(forms(classes)[name]().alias("score"))
    return images.select("image_id").join(scored, "image_id", "left").select("image_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))


def greedy_batches(images: DataFrame, boxes: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """K images in rounds of a tenth: the best by the combined utility against the pool so far, which then grows by them."""
    spark, step = images.sparkSession, max(1, k // 10)
    boxes = staged(boxes.select("image_id", "cls", "w", "h"), "boxes")  # read in every round
    images, pool = (staged(df.select("image_id"), "ids") for df in (images, pool))
    chosen = images.select("image_id").limit(0)
    left = k
    while left > 0:
        rest = images.select("image_id").join(chosen, "image_id", "left_anti").join(pool.select("image_id"), "image_id", "left_anti")
        best = oracle("combined", rest, boxes, pool.select("image_id").union(chosen))
        ids = [(r.image_id,) for r in best.orderBy(F.desc("score"), "image_id").limit(min(step, left)).collect()]  # a tenth of the budget
        if not ids:
            break
        chosen = chosen.union(spark.createDataFrame(ids, images.select("image_id").schema))
        left -= len(ids)
    return chosen


def percentiles(scores: DataFrame) -> DataFrame:
    """W02 of dist, var and n in __dist, __var and __n; scores: image_id, dist, var, n."""
    for c in ("dist", "var", "n"):
        scores = ordinal_percentile(scores, c, f"__{c}")
    return scores


def hybrid(scores: DataFrame, alpha: float, weight: float) -> DataFrame:
    """Percentile of distance times powers of the percentiles of variance and count; scores: image_id, dist, var, n."""
    return hybrid_grid(scores, [alpha], [weight]).select("image_id", "score")


def hybrid_grid(scores: DataFrame, alphas: list[float], weights: list[float]) -> DataFrame:
    """O10 for every alpha and weight: the percentiles are made once."""
    pairs = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(w)).alias("weight")) for a in alphas for w in weights))
    each = percentiles(scores).select("image_id", "__dist", "__var", "__n", F.inline(pairs))
    return each.select("alpha", "weight", "image_id", (F.col("__dist") * F.pow("__var", "alpha") * F.pow("__n", "weight")).alias("score"))
