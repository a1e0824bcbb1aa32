"""Predicted and true boxes: joins by overlap, one-to-one matching, suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import geometry as G

#: IoU levels 0.50 to 0.95; the step is the double that repeated addition of 0.05 to 0.5 gives, so 0.6 itself is missed.
LEVELS = [0.5 + i * ((0.5 + 0.05) - 0.5) for i in range(10)]


def _xyxy(alias: str) -> tuple:
    return G.corners(*[F.col(f"{alias}.{c}") for c in ("xc", "yc", "w", "h")])


def _overlapping(preds: DataFrame, truth: DataFrame, level: float, strict: bool, how: str) -> DataFrame:
    over = G.iou(_xyxy("p"), _xyxy("g"))
    hit = over > level if strict else over >= level
    return preds.alias("p").join(truth.alias("g"), (F.col("p.image_id") == F.col("g.image_id")) & (F.col("p.cls") == F.col("g.cls")) & hit, how)


def true_positives(preds: DataFrame, truth: DataFrame, level: float = 0.4, strict: bool = False) -> DataFrame:
    """Predictions that overlap a true box of their image and class."""
    return _overlapping(preds, truth, level, strict, "left_semi")


def false_positives(preds: DataFrame, truth: DataFrame, level: float = 0.4, strict: bool = False) -> DataFrame:
    """The other predictions."""
    return _overlapping(preds, truth, level, strict, "left_anti")


def real_false_positives(preds: DataFrame, truth: DataFrame, confidence: float = 0.47, cls: int = 1, level: float = 0.4) -> DataFrame:
    """FL03: confident ones of a class that match nothing."""
    return false_positives(preds.where((F.col("conf") >= confidence) & (F.col("cls") == cls)), truth, level, strict=True)


def best_iou(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """image_id, box_seq, cls, best_iou of every true box; 0 without a prediction of its class."""
    pairs = truth.alias("g").join(preds.alias("p"), ["image_id", "cls"], "left")
    over = F.coalesce(G.iou(_xyxy("g"), _xyxy("p"), "floor"), F.lit(0.0))
    return pairs.groupBy("image_id", F.col("g.box_seq").alias("box_seq"), "cls").agg(F.max(over).alias("best_iou"))


def miss_scores(images: DataFrame, truth: DataFrame, preds: DataFrame, pool: DataFrame) -> DataFrame:
    """Sum over classes of ln(1 + missed levels) / sqrt(boxes of the class in the pool + 1)."""
    missed = sum((F.col("best_iou") < F.lit(t)).cast("int") for t in LEVELS) / len(LEVELS)
    per_class = best_iou(truth, preds).groupBy("image_id", "cls").agg(F.sum(missed).alias("m"))
    n = truth.join(pool.select("image_id"), "image_id", "left_semi").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    # one row for each class
    part = F.ln(1 + F.col("m")) / F.sqrt(F.coalesce("n", F.lit(0)) + 1)
    scored = per_class.join(F.broadcast(n), "cls", "left").groupBy("image_id").agg(F.sum(part).alias("score"))
    return images.select("image_id").join(scored, "image_id", "left").select("image_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def soft_f1(images: DataFrame, truth: DataFrame, preds: DataFrame, level: float = 0.7) -> DataFrame:
    """image_id, status (frg or bg), score. Predictions in order take the first free true box of their class above the level.

    True positives and false positives weigh their confidence, misses 1; an
    image without boxes of both kinds scores 1. The fold is over one image.
    """
    box = lambda *more: F.array_sort(F.collect_list(F.struct("box_seq", "cls", "xc", "yc", "w", "h", *more)))
    g = truth.groupBy("image_id").agg(box().alias("gts"))
    p = preds.withColumn("conf", F.coalesce("conf", F.lit(0.0))).groupBy("image_id").agg(box("conf").alias("ps"))
    rows = images.select("image_id").join(g, "image_id", "left").join(p, "image_id", "left")
    xyxy = lambda b: G.corners(b.xc, b.yc, b.w, b.h)
    start = F.struct(F.col("gts").alias("rem"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"))

    def step(s: F.Column, q: F.Column) -> F.Column:
        fits = F.filter(s.rem, lambda b: (b.cls == q.cls) & (G.iou(xyxy(b), xyxy(q), "plus") > level))
        hit = F.size(fits) > 0
        rem = F.when(hit, F.filter(s.rem, lambda b: b.box_seq != F.element_at(fits, 1).box_seq)).otherwise(s.rem)
        return F.struct(rem.alias("rem"), (s.tp + F.when(hit, q.conf).otherwise(0.0)).alias("tp"), (s.fp + F.when(hit, 0.0).otherwise(q.conf)).alias("fp"))

    rows = rows.withColumn("gts", F.coalesce("gts", F.filter(F.array(F.struct(F.lit(0).cast(truth.schema["box_seq"].dataType).alias("box_seq"), F.lit(0).cast(truth.schema["cls"].dataType).alias("cls"), *[F.lit(0.0).alias(c) for c in ("xc", "yc", "w", "h")])), lambda _: F.lit(False))))
    folded = rows.withColumn("f", F.when(F.col("ps").isNull(), start).otherwise(F.aggregate("ps", start, step)))
    status = F.when(F.col("ps").isNull() | (F.size("ps") == 0), "bg").otherwise("frg")
    return folded.select("image_id", status.alias("status"), G.f_score(F.col("f.tp"), F.col("f.fp"), F.size("f.rem")).alias("score"))


def mean_confidence(images: DataFrame, preds: DataFrame) -> DataFrame:
    """image_id, status, score; an image without predictions is background of score 1."""
    m = preds.groupBy("image_id").agg(F.avg(F.coalesce("conf", F.lit(0.0))).alias("m"))
    return images.select("image_id").join(m, "image_id", "left").select("image_id", F.when(F.col("m").isNull(), "bg").otherwise("frg").alias("status"), F.coalesce("m", F.lit(1.0)).alias("score"))


def suppress(preds: DataFrame, level: float = 0.45, confidence: float = 0.25, most_before: int = 30_000, most_after: int = 300) -> DataFrame:
    """Greedy suppression within image and class by falling confidence, then the most confident of each image. Ties: smaller box_seq.

    most_before bounds an image's candidates, as the detector's own step does.
    """
    by_conf = W.partitionBy("image_id").orderBy(F.desc("conf"), "box_seq")
    kept = preds.where(F.col("conf") > confidence).withColumn("__n", F.row_number().over(by_conf)).where(F.col("__n") <= most_before)
    fields = ["box_seq", "xc", "yc", "w", "h", "conf"]
    boxes = kept.groupBy("image_id", "cls").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("o"), *fields))).alias("all"))
    xyxy = lambda b: G.corners(b.xc, b.yc, b.w, b.h)
    none = F.filter("all", lambda _: F.lit(False))
    fold = F.aggregate("all", none, lambda acc, b: F.when(F.exists(acc, lambda k: G.iou(xyxy(k), xyxy(b)) > level), acc).otherwise(F.concat(acc, F.array(b))))
    flat = boxes.select("image_id", "cls", F.explode(fold).alias("b")).select("image_id", "cls", *[F.col(f"b.{c}").alias(c) for c in fields])
    return flat.withColumn("__n", F.row_number().over(by_conf)).where(F.col("__n") <= most_after).drop("__n")


def head_boxes(head: DataFrame, confidence: float) -> DataFrame:
    """FL07, D16: best class of each anchor of a detector head (image_id, anchor, cx, cy, w, h, scores) above a confidence."""
    best = F.array_max("scores")
    return head.where(best > confidence).select("image_id", F.col("anchor").alias("box_seq"), (F.array_position("scores", best) - 1).cast("int").alias("cls"), F.col("cx").alias("xc"), F.col("cy").alias("yc"), "w", "h", best.alias("conf"))
