"""Readers and writers of split lists, label files and logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions import names as N
from tessella.functions import vectors as V

CROPS = "crop_id long, image_id long, cls int, embedding array<float>"
LOSSES = "im_file string, epoch int, loss_iou double, loss_cls double, loss_dfl double"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """SC03: pos, line of one text file, blank lines kept. A list is one file, read whole so that its order is known."""
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("pos", "line"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """SC02: pos, path, image_id of a split list; order and repeats kept, blank lines left out."""
    line = F.trim("line")
    return read_lines(spark, path).where(line != "").select("pos", line.alias("path"), N.stem(line).alias("image_id"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """SC01: the set of image_id of one or many lists."""
    line = F.trim("value")
    return spark.read.text(path).where(line != "").select(N.stem(line).alias("image_id")).distinct()


def _lines(whole: DataFrame) -> DataFrame:
    """image_id, box_seq, t (tokens) of image_id, value (a label file's text); lines of less than five tokens are left out."""
    lines = whole.select("image_id", F.posexplode(F.split("value", r"\r?\n")).alias("box_seq", "line"))
    return lines.withColumn("t", F.split(F.trim("line"), r"\s+")).where(F.size("t") >= 5)


def _label_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(N.stem(F.col("_metadata.file_name")).alias("image_id"), "value")


def parse_labels(whole: DataFrame) -> DataFrame:
    """SC04, SC06: image_id, box_seq, cls, xc, yc, w, h, conf of image_id, value (a label file's text); a sixth token is conf."""
    num = lambda i: F.get("t", F.lit(i)).try_cast("double")
    return _lines(whole).select("image_id", "box_seq", num(0).cast("int").alias("cls"), num(1).alias("xc"), num(2).alias("yc"), num(3).alias("w"), num(4).alias("h"), F.when(F.size("t") == 6, num(5)).alias("conf"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """SC04, SC06: the labels of a folder of label files."""
    return parse_labels(_label_files(spark, path))


def parse_polygons(whole: DataFrame, images: DataFrame) -> DataFrame:
    """SC07: boxes around the polygons of image_id, value; images gives width and height of each image_id. All vertices count."""
    t = _lines(whole).join(images, "image_id")
    points = F.transform(F.slice("t", F.lit(2), F.size("t") - 1), lambda x: x.cast("double"))
    return t.withColumn("b", G.polygon_box(points, F.col("width"), F.col("height"))).select("image_id", "box_seq", F.get("t", F.lit(0)).cast("int").alias("cls"), "b.*")


def read_polygons(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """SC07: the polygons of a folder of label files as boxes."""
    return parse_polygons(_label_files(spark, path), images)


def with_alias(crops: DataFrame, names: dict[int, str], wanted: int | str | None) -> DataFrame:
    """FL01: crops of one class by its number or its name; None for all. An unknown name raises."""
    if isinstance(wanted, str):
        numbers = {v: k for k, v in names.items()}
        if wanted not in numbers:
            raise ValueError(f"no class is named {wanted}")
        wanted = numbers[wanted]
    return crops if wanted is None else crops.where(F.col("cls") == wanted)


def ground_truth(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """SC05: every image with its boxes, area and corners; images without boxes stay, with nulls."""
    x1, y1, x2, y2 = G.corners(*[F.col(c) for c in ("xc", "yc", "w", "h")])
    return images.join(boxes.withColumns({"area": F.col("w") * F.col("h"), "x1": x1, "y1": y1, "x2": x2, "y2": y2}), "image_id", "left")


def read_images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """SC08: image_id, path, bytes of the files of a folder; pixels stay unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(N.stem(F.col("path")).alias("image_id"), "path", F.col("length").alias("bytes"))


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, GIF or JPEG file; None for others."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8" and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame's head
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 1 if mark == 0xFF else 2 + (0 if 0xD0 <= mark <= 0xD9 else int.from_bytes(data[at + 2 : at + 4], "big"))
    return None


def read_sizes(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """SC09: image_id, path, width, height of the images of a folder, from their heads; null where a file is no known image. Empty files are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [image_size(c) or (None, None) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "width": pd.array([w for w, _ in sizes], "Int64"), "height": pd.array([h for _, h in sizes], "Int64")})

    return files.mapInPandas(run, "path string, width long, height long").select(N.stem(F.col("path")).alias("image_id"), "path", "width", "height")


def sized_images(images: DataFrame, least_width: int = 640, least_height: int = 360) -> DataFrame:
    """SC08: images of 16:9 of a size at least."""
    return images.where((F.col("width") * 9 == F.col("height") * 16) & (F.col("width") >= least_width) & (F.col("height") >= least_height))


def embedding_matrix(crops: DataFrame, width: int | None = None, normalise: bool = True) -> DataFrame:
    """SC12: crops whose vectors are cut to a prefix and brought to length one."""
    v = F.col("embedding") if width is None else V.prefix(F.col("embedding"), width)
    return crops.where("embedding is not null").withColumn("embedding", V.unit(v) if normalise else v)


def write_similarity(similarity: DataFrame, path: str, batch: str | None = None) -> None:
    """SK05: the similarity table crop_id, similarity (a number, or one for each false positive).

    Whole, or one batch after the other: a batch that is written again replaces itself only.
    """
    if batch is None:
        similarity.write.mode("overwrite").parquet(path)
    else:
        similarity.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """SC17: what write_similarity wrote, all batches together."""
    found = spark.read.parquet(path)
    return found.drop("batch")


def write_neighbours(neighbours: DataFrame, path: str) -> None:
    """SK12: fp_id, rank, crop_id, sim of the nearest crops of each false positive, by false positive and rank."""
    neighbours.select("fp_id", "rank", "crop_id", "sim").repartitionByRange("fp_id").sortWithinPartitions("fp_id", "rank").write.mode("overwrite").parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """SK07: the finished table at path; else what make() gives, written there first. A half-written table counts as none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_crops(spark: SparkSession, *paths: str, cls: int | None = None, labels: DataFrame | None = None) -> DataFrame:
    """SC10, SC11, SC13: stored vectors, of one class if named; with labels, every labelled crop must have its vector."""
    crops = spark.read.schema(CROPS).parquet(*paths)
    if labels is not None and not labels.join(crops, "crop_id", "left_anti").isEmpty():
        raise ValueError("crops without a vector")
    return crops if cls is None else crops.where(F.col("cls") == cls)


def complete(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that raises where a key of left has no row in right."""
    if not left.join(right, key, "left_anti").isEmpty():
        raise ValueError(f"no {key} for some rows")
    return left.join(right, key)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """SC14: a training log with trimmed headers; all cells stay text (see metrics.clean_number)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.toDF(*[c.replace("\0", "").strip() for c in raw.columns])


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """SC15."""
    return spark.read.schema(LOSSES).option("header", True).csv(path)


def write_split(split: DataFrame, path: str, folder: str = "images") -> None:
    """SK01: one line for each row in order of section and pos. One file, as a list's order is that of its lines."""
    line = F.concat(F.lit(f"./{folder}/"), F.col("image_id").cast("string"), F.lit(".jpg"))
    split.orderBy("section", "pos").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def inference_list(paths: DataFrame, root: str) -> DataFrame:
    """SK04: the root before each path without its first character."""
    return paths.select(F.concat(F.lit(root), F.substr("path", F.lit(2))).alias("value"))


def write_once(df: DataFrame, path: str, expected: int) -> bool:
    """SK03, SK06: writes df unless a finished table of that many rows is there. True if it wrote."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) and spark.read.parquet(path).count() == expected:
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def manifest(candidates: DataFrame, target: str) -> DataFrame:
    """SK09: source, destination of files to move; nothing is moved."""
    return candidates.select(F.col("path").alias("source"), F.concat(F.lit(target.rstrip("/") + "/"), N.basename(F.col("path"))).alias("destination"))
