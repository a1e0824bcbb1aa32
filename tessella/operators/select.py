"""Selection strategies: which images to label next. Every result is ordered by `rank` from 1."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import sampling
from tessella.functions import vectors as V
from tessella.operators import aggregate, knn, ranking
from tessella.operators.pool import background, class_weights
from tessella.sources.staging import staged

MODES = ("distance", "density", "matryoshka_variance", "gbm_oracle")


def split_crops(crops: DataFrame, labeled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crops of labelled and of other images."""
    ids = labeled.select("image_id")
    return crops.join(ids, "image_id", "left_semi"), crops.join(ids, "image_id", "left_anti")


def unlabeled(images: DataFrame, labeled: DataFrame) -> DataFrame:
    """J02."""
    return images.join(labeled.select("image_id"), "image_id", "left_anti")


def budget(images: int, start: float, stop: float, background_ratio: float = 0.0) -> tuple[int, int]:
    """Images to select and backgrounds to add; products of doubles are cut, so 10 images from 0.2 to 0.3 give 0."""
    target = images * (stop - start)
    return int(target * (1 - background_ratio)), int(target * background_ratio)


def check(mode: str, n: int | None, k: int | None) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if (n is None) == (k is None):
        raise ValueError("give exactly one of n and k")


def ranked(scores: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    best = ranking.top_k(scores, k, ascending)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.asc("score") if ascending else F.desc("score"), "image_id")))


def distance_scores(crops: DataFrame, labeled: DataFrame, width: int | None = None) -> DataFrame:
    """Crops of other images with score: the cosine distance to the nearest labelled crop."""
    known, rest = split_crops(crops, labeled)
    near = knn.knn_distances(rest, known, 1, [width or 1 << 30])
    return near.select("crop_id", "image_id", "cls", F.element_at(F.element_at("distances", 1), 1).alias("score"))


def distance(crops: DataFrame, labeled: DataFrame, k: int, aggregation: str = "max", width: int | None = None) -> DataFrame:
    """The images farthest from the labelled ones, over a prefix of the vectors if a width is given."""
    weights = class_weights(split_crops(crops, labeled)[0]) if aggregation == "class_weighted_sum" else None
    return ranked(aggregate.by_image(distance_scores(crops, labeled, width), aggregation, weights), k)


def closest_crops(crops: DataFrame, labeled: DataFrame, k: float) -> DataFrame:
    """The crops of other images nearest to the labelled ones, nearest first; k may be no whole number and is rounded up."""
    best = distance_scores(crops, labeled).orderBy("score", "crop_id").limit(math.ceil(k))
    return best.select("crop_id", "score", F.row_number().over(W.orderBy("score", "crop_id")).alias("rank"))


def density(crops: DataFrame, labeled: DataFrame, k: int, neighbours: int = 5, aggregation: str = "max", metric: str = "cosine", ascending: bool | None = None) -> DataFrame:
    """Images in sparse regions first (with `max` the crop of least density counts); other aggregations sort downward unless told."""
    known, rest = split_crops(crops, labeled)
    near = knn.knn_distances(rest, known, neighbours)
    d = F.element_at("distances", 1)
    d = F.transform(d, V.angular) if metric == "angular" else d
    scores = near.select("image_id", "cls", V.density(d).alias("score"))
    up = aggregation == "max" if ascending is None else ascending
    return ranked(aggregate.by_image(scores, "min" if up and aggregation == "max" else aggregation, class_weights(known) if aggregation == "class_weighted_sum" else None), k, up)


def prefix_distances(crops: DataFrame, labeled: DataFrame, widths: list[int]) -> tuple[DataFrame, list[str]]:
    """Nearest distances over each prefix, columns d<width>."""
    known, rest = split_crops(crops, labeled)
    near = knn.knn_distances(rest, known, 1, widths)
    return near.select("crop_id", "image_id", "cls", *[F.element_at(F.element_at("distances", i + 1), 1).alias(f"d{w}") for i, w in enumerate(widths)]), [f"d{w}" for w in widths]


def matryoshka_variance(crops: DataFrame, labeled: DataFrame, k: int, widths: list[int], how: str = "max") -> DataFrame:
    """The spread of the nearest distance over prefixes; its maximum (or mean) for each image."""
    rows, names = prefix_distances(crops, labeled, widths)
    return ranked(aggregate.by_image(rows.withColumn("score", V.variance([F.col(n) for n in names])), how), k)


def _split_once(crops: DataFrame, labeled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The crops of labelled and of other images, written down for several passes."""
    marked = crops.join(labeled.select("image_id").distinct().withColumn("__known", F.lit(True)), "image_id", "left")
    rows = staged(marked, "split-crops")
    return rows.where("__known").drop("__known"), rows.where("__known is null").drop("__known")


def coarse_to_fine(crops: DataFrame, labeled: DataFrame, k: int, dim: int, k1: float = 4.0, k2: float = 2.0, d1: int = 8, d2: int = 4) -> DataFrame:
    """K * k1 images by a coarse prefix, of them k * k2 by a finer one, of them k by whole vectors. From the first step on only an image's best crop goes on."""
    if k1 < 1 or k2 < 1 or d1 < 1 or d2 < 1:
        raise ValueError("multipliers and divisors must be 1 or more")
    known, rest = _split_once(crops, labeled)
    now, out = rest, rest
    for width, keep in ((max(1, dim // d1), int(k * k1)), (max(1, dim // d2), int(k * k2)), (dim, k)):
        near = knn.knn_distances(now, known, 1, [width])
        out = aggregate.best_crop(near.select("crop_id", "image_id", F.element_at(F.element_at("distances", 1), 1).alias("score")), keep)
        now = rest.join(out.select("crop_id"), "crop_id", "left_semi")
    return out.select("image_id", "score", F.row_number().over(W.orderBy(F.desc("score"), "image_id")).alias("rank"))


def _voted(ballots: DataFrame, k: int) -> DataFrame:
    """Ballots (image_id, place) by votes, then mean place, then id."""
    voted = ballots.groupBy("image_id").agg(F.count(F.lit(1)).alias("votes"), F.avg("place").alias("avg_rank"))
    order = (F.desc("votes"), "avg_rank", "image_id")
    return voted.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def voting(spaces: list[DataFrame], labeled: DataFrame, k: int, aggregation: str = "max") -> DataFrame:
    """Images by votes of the spaces' own selections, then mean place, then id."""
    if not spaces:
        raise ValueError("no spaces to vote")
    lists = [distance(s, labeled, k, aggregation).select("image_id", (F.col("rank") - 1).alias("place")) for s in spaces]
    return _voted(reduce(DataFrame.unionByName, lists), k)


def voting_stretches(crops: DataFrame, labeled: DataFrame, k: int, stretches: list[tuple[int, int]], aggregation: str = "max") -> DataFrame:
    """S07 where the spaces are stretches (start, width) of one vector: one pass over the crops finds the distances in all of them."""
    known, rest = split_crops(crops, labeled)
    weights = class_weights(known) if aggregation == "class_weighted_sum" else None
    near = knn.knn_distances(rest, known, 1, stretches=stretches)
    scores = near.select("image_id", "cls", F.posexplode(F.transform("distances", lambda d: F.element_at(d, 1))).alias("space", "score"))
    best = ranking.top_k_per(aggregate.by_image(scores, aggregation, weights, "space"), k, "space")
    return _voted(best.select("image_id", F.col("rank").alias("place")), k)


def two_budgets(scores: DataFrame, frg: int, bg: int) -> DataFrame:
    """The least scores of each status up to its budget; scores: image_id, status, score."""
    place = F.row_number().over(W.partitionBy("status").orderBy("score", "image_id"))
    most = F.col("rank") <= max(frg, bg)  # a plain bound, so that no more of a status is sorted in one task
    return scores.withColumn("rank", place).where(most & (F.col("rank") <= F.when(F.col("status") == "bg", bg).otherwise(frg)))


def modular_sample(images: DataFrame, position: Column, percent: int) -> DataFrame:
    """Rows whose position mod 100 is at most percent: percent + 1 of a hundred, as ever."""
    return images.where(position % 100 <= percent)


def every_kth(images: DataFrame, k: int, order: str = "image_id") -> DataFrame:
    """FL06."""
    return ranking.places(images, order).where((F.col("__below") + 1) % k == 0).drop("__below", "__total")


def nested_sample(parent: DataFrame, whole: int, fraction: float, seed: int, least: int = 0) -> DataFrame:
    """round(fraction * whole) rows of the parent (`least` at least) in a seeded order of image_id; smaller fractions of a parent lie within larger ones.

    Rows keep their columns, so a place in the pool (pos) gives the sample's
    order; see in_pool_order. More than the parent holds is an error only there.
    """
    n = max(least, round(fraction * whole))
    placed = ranking.places(parent.withColumn("__h", sampling.order_key(F.col("image_id"), seed)), "__h", "image_id")
    return placed.where(F.col("__below") < n).drop("__h", "__below", "__total")


def in_pool_order(parent: DataFrame, whole: int, fraction: float, seed: int) -> DataFrame:
    """The sample of one image at least, with `place` from 0 by the images' order (pos) in the pool. Raises where the parent has too few."""
    n = max(1, round(fraction * whole))
    chosen = staged(nested_sample(parent, whole, fraction, seed, 1), "sample")
    if chosen.count() < n:
        raise ValueError(f"{n} images wanted, the parent has fewer")
    return ranking.places(chosen, "pos", "image_id").withColumnRenamed("__below", "place").drop("__total")


def add_backgrounds(images: DataFrame, boxes: DataFrame, labeled: DataFrame, n: int, seed: int) -> DataFrame:
    """N unlabelled images without boxes by a seeded hash."""
    return nested_sample(background(unlabeled(images, labeled), boxes).select("image_id"), n, 1.0, seed)


def removal_candidates(crops: DataFrame, false_positives: DataFrame, percent: int = 3) -> DataFrame:
    """Images most like the false positives: the greatest summed similarity of their crops; int(n * percent / 100), one at least."""
    scores = knn.similarity_sum(crops, false_positives).groupBy("image_id").agg(F.max("similarity").alias("score"))
    return ranked(scores, max(1, int(scores.count() * percent / 100)))


def ordered_split(start: DataFrame, selected: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """SK01, ST06: the old split, the selection and the backgrounds, in this order, repeats kept; each has image_id, pos."""
    part = lambda df, n: df.select(F.lit(n).alias("section"), F.col("pos").cast("long").alias("pos"), "image_id")
    return part(start, 0).unionByName(part(selected, 1)).unionByName(part(backgrounds, 2))


def baseline_budget(start: DataFrame, baseline: DataFrame, pool: DataFrame) -> int:
    """Images that the baseline adds, after checks: no repeats, all in the pool, one at least."""
    for name, df in (("start", start), ("baseline", baseline)):
        if not df.groupBy("image_id").count().where("count > 1").isEmpty():
            raise ValueError(f"{name} has repeated images")
        if not df.join(pool, "image_id", "left_anti").isEmpty():
            raise ValueError(f"{name} has images outside the pool")
    k = baseline.join(start, "image_id", "left_anti").count()
    if not 1 <= k <= unlabeled(pool, start).count():
        raise ValueError("the baseline adds no image, or more than there are")
    return k
