"""Statistics of pools and selections of images with boxes (image_id, cls, w, h)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import ranking


def class_histogram(boxes: DataFrame, *by: str) -> DataFrame:
    """Boxes of each class, by further columns if named."""
    return boxes.groupBy(*by, "cls").agg(F.count(F.lit(1)).alias("n"))


def class_counts(boxes: DataFrame, classes: int) -> DataFrame:
    """FL05: the histogram of classes 0 to classes - 1."""
    return class_histogram(boxes.where(F.col("cls").between(0, classes - 1)))


def pool_stats(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row: num_images, total_boxes, classes_covered, avg_area (0 without boxes)."""
    b = boxes.join(images.select("image_id"), "image_id", "left_semi").agg(F.count(F.lit(1)).alias("total_boxes"), F.count_distinct("cls").alias("classes_covered"), F.coalesce(F.sum(F.col("w") * F.col("h")), F.lit(0.0)).alias("__area"))
    n = images.agg(F.count(F.lit(1)).alias("num_images"))
    return n.join(F.broadcast(b)).select("num_images", "total_boxes", "classes_covered", (F.col("__area") / F.greatest(F.col("total_boxes"), F.lit(1))).alias("avg_area"))


def class_weights(crops: DataFrame) -> DataFrame:
    """1 / (share + 0.01) of each class among the crops; J17 gives unseen ones DEFAULT_WEIGHT."""
    n = class_histogram(crops)
    return n.select("cls", (1 / (F.col("n") / F.sum("n").over(W.partitionBy()) + 0.01)).alias("weight"))


DEFAULT_WEIGHT = 1 / 0.01


def background(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """FL02: images without boxes."""
    return images.join(boxes.select("image_id"), "image_id", "left_anti")


def selection_quality(selected: DataFrame, boxes: DataFrame, *by: str, eps: float = 1e-10) -> DataFrame:
    """Size, coverage, mean area, entropy, share of the largest class and mean classes an image of each selection (columns by, image_id)."""
    b = selected.join(boxes, "image_id", "left")
    image = b.groupBy(*by, "image_id").agg(F.count("cls").alias("__n"), F.count_distinct("cls").alias("__u"), F.coalesce(F.sum(F.col("w") * F.col("h")), F.lit(0.0)).alias("__a"))
    whole = image.groupBy(*by).agg(
        F.count(F.lit(1)).alias("images"), F.sum((F.col("__n") == 0).cast("int")).alias("empty"), F.sum("__n").alias("boxes"),
        (F.sum("__n") / F.count(F.lit(1))).alias("boxes_per_image"), (F.sum("__a") / F.greatest(F.sum("__n"), F.lit(1))).alias("avg_area"), F.avg("__u").alias("avg_unique"),
    )
    per = b.where("cls is not null").groupBy(*by, "cls").agg(F.count(F.lit(1)).alias("__c"))
    share = per.withColumn("__p", F.col("__c") / F.sum("__c").over(W.partitionBy(*by)))
    spread = share.groupBy(*by).agg(F.count(F.lit(1)).alias("classes"), (-F.sum(F.col("__p") * F.ln(F.col("__p") + eps))).alias("entropy"), F.max("__p").alias("top_share"))
    joined = whole.join(spread, list(by), "left") if by else whole.join(F.broadcast(spread))
    return joined.na.fill(0, ["classes", "entropy", "top_share"])


def area_stats(boxes: DataFrame, *by: str) -> DataFrame:
    """Mean and median area."""
    a = F.col("w") * F.col("h")
    mean = boxes.groupBy(*by).agg(F.avg(a).alias("mean_area"), F.count(F.lit(1)).alias("n"))
    return ranking.with_columns_of(mean, ranking.percentiles_of(boxes, a, {"median_area": 0.5}, *by), *by)


def density_histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Bin, count and density of values in [low, high]; the last bin is closed."""
    x = F.col(column)
    inside = values.where(x.between(low, high)).withColumn("bin", F.least(F.floor((x - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1)))
    counts = inside.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy()) * ((high - low) / bins)))


def quartiles(values: DataFrame, column: str, *by: str) -> DataFrame:
    """Box-plot numbers."""
    return ranking.percentiles_of(values, F.col(column), {f"q{int(q * 100)}": q for q in (0.25, 0.5, 0.75)}, *by)


def threshold_counts(values: DataFrame, column: str, threshold: float) -> DataFrame:
    """FL04: rows at or below and at or above a threshold."""
    return values.agg(F.count_if(F.col(column) <= threshold).alias("left"), F.count_if(F.col(column) >= threshold).alias("right"))


def crop_counts(crops: DataFrame, maps: int = 1) -> DataFrame:
    """Crops an image: mean, max, the vectors to expect for so many maps, and the median."""
    per = crops.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return ranking.with_columns_of(per.agg(F.avg("n").alias("mean"), F.max("n").alias("max"), (F.sum("n") * maps).alias("expected")), ranking.percentiles_of(per, F.col("n"), {"median": 0.5}))
