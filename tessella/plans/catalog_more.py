"""Queries of names, boxes, files, stored tables and smaller filters, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions import names as N
from tessella.functions import vectors as V
from tessella.operators import ann, chains, knn, matching, metrics, ml, pool, select
from tessella.plans.catalog import FPS, KNN5, NEAR, R, _iou_of, query
from tessella.sources import files
from tessella.sources.staging import shared_folder, staged


def _path(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/files/{name}-{uuid.uuid4().hex}"


# Names

PATHS = "SELECT image_id, './images/train/v' || (image_id % 3) || '.' || image_id || '.jpg' AS path FROM images"


def _paths(t) -> DataFrame:
    return t.images.select("image_id", F.concat(F.lit("./images/train/v"), F.col("image_id") % 3, F.lit("."), "image_id", F.lit(".jpg")).alias("path"))


@query("pj01_paths", f"SELECT image_id, regexp_extract(path, '[^/]*$') AS base, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') AS stem, regexp_replace(path, '[.][^./]*$', '.txt') AS label FROM ({PATHS})")
def _(t):
    p = F.col("path")
    return _paths(t).select("image_id", N.basename(p).alias("base"), N.stem(p).alias("stem"), N.with_suffix(p, ".txt").alias("label"))


@query("pj02_crop_names", "SELECT image_id, box_seq, image_id || '_cropped' || CASE WHEN box_seq > 0 THEN '_' || box_seq ELSE '' END AS name, CAST(image_id AS VARCHAR) AS image FROM boxes")
def _(t):
    named = t.boxes.select("image_id", "box_seq", N.crop_name(F.col("image_id").cast("string"), F.col("box_seq")).alias("name"))
    return named.withColumn("image", N.crop_image(F.col("name")))


@query("sk04_inference_list", f"SELECT '/data' || substr(path, 2) AS value FROM ({PATHS})")
def _(t):
    return files.inference_list(_paths(t), "/data")


@query("sk09_manifest", f"SELECT path AS source, 'moved/' || regexp_extract(path, '[^/]*$') AS destination FROM ({PATHS}) WHERE image_id % 10 = 0")
def _(t):
    return files.manifest(_paths(t).where("image_id % 10 = 0"), "moved/")


@query("sk10_display", "SELECT run, CAST(epoch AS INTEGER) AS epoch, event_id, CASE WHEN event_id % 7 = 0 THEN '—' ELSE printf('%.4f', r) END AS cell FROM results")
def _(t):
    return t.results.select("run", "epoch", "event_id", metrics.display(F.when(F.col("event_id") % 7 != 0, F.col("r"))).alias("cell"))


# Boxes

SIZED = "(SELECT image_id, 300 + image_id % 700 AS width, 200 + image_id % 500 AS height FROM images)"


def _sized(t) -> DataFrame:
    return t.images.select("image_id", (300 + F.col("image_id") % 700).alias("width"), (200 + F.col("image_id") % 500).alias("height"))


@query("sc05_ground_truth", "SELECT image_id, box_seq, cls, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in {"area": "w*h", "x1": "xc-w/2", "y1": "yc-h/2", "x2": "xc+w/2", "y2": "yc+h/2"}.items()) + " FROM images LEFT JOIN boxes USING (image_id)")
def _(t):
    return files.ground_truth(t.images.select("image_id"), t.boxes).select("image_id", "box_seq", "cls", "area", "x1", "y1", "x2", "y2")


@query("pj10_polygons", f"SELECT image_id, box_seq, cls, round((trunc((xc-w/2)*width)+trunc((xc+w/2)*width))/2/width*1000, 6) AS xc, round((trunc((yc-h/2)*height)+trunc((yc+h/2)*height))/2/height*1000, 6) AS yc, round((trunc((xc+w/2)*width)-trunc((xc-w/2)*width))/width*1000, 6) AS w, round((trunc((yc+h/2)*height)-trunc((yc-h/2)*height))/height*1000, 6) AS h FROM boxes JOIN {SIZED} USING (image_id)")
def _(t):
    x1, y1, x2, y2 = G.corners(*[F.col(c) for c in ("xc", "yc", "w", "h")])
    line = F.concat_ws(" ", "cls", x1, y1, x2, y1, x2, y2, x1, y2)
    whole = t.boxes.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_seq", line.alias("line")))), lambda b: b.line), "\n").alias("value"))
    found = files.parse_polygons(whole, _sized(t))
    return found.select("image_id", "box_seq", "cls", *[(F.col(c) * 1000).alias(c) for c in ("xc", "yc", "w", "h")])  # in thousandths: no ties at the sixth place


@query("sc04_labels", f"SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY box_seq) - 1 AS INTEGER) AS box_seq, cls, {', '.join(f'round({c}, 6) AS {c}' for c in ('xc', 'yc', 'w', 'h', 'conf'))} FROM preds")
def _(t):
    line = F.concat_ws(" ", "cls", "xc", "yc", "w", "h", "conf")
    whole = t.preds.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_seq", line.alias("line")))), lambda b: b.line), "\n").alias("value"))
    return files.parse_labels(whole)


@query("pj11_normalised", "SELECT " + " AND ".join(f"{e} BETWEEN 0 AND 1" for e in ("xc", "yc", "w", "h", "round(xc-w/2, 7)", "round(yc-h/2, 7)", "round(xc+w/2, 7)", "round(yc+h/2, 7)")) + " AS inside, count(*) AS n FROM preds GROUP BY 1")
def _(t):
    box = tuple(F.col(c) for c in ("xc", "yc", "w", "h"))
    return t.preds.groupBy(G.is_normalised(box).alias("inside")).agg(F.count(F.lit(1)).alias("n"))


FIT = f"f AS (SELECT *, least(640.0::DOUBLE / height, 640.0::DOUBLE / width) AS gain FROM {SIZED}), p AS (SELECT *, round_even((640 - round_even(width * gain, 0)) / 2 - 0.1, 0) AS l, round_even((640 - round_even(height * gain, 0)) / 2 - 0.1, 0) AS t FROM f)"


@query("pj13_letterbox", f"WITH {FIT} SELECT image_id, {R('gain')} AS gain, l + 0 AS left_pad, t + 0 AS top_pad FROM p")
def _(t):
    return _sized(t).withColumn("f", G.letterbox(F.col("width"), F.col("height"), 640, 640)).select("image_id", F.col("f.gain").alias("gain"), (F.col("f.left") + 0.0).alias("left_pad"), (F.col("f.top") + 0.0).alias("top_pad"))


_back = lambda c, pad, most: f"round(least(greatest(({c} - {pad}) / gain, 0), {most}) * 1000, 6)"


@query("pj14_unletterbox", f"WITH {FIT} SELECT image_id, box_seq, {_back('(xc-w/2)*640', 'l', 'width')} AS x1, {_back('(yc-h/2)*640', 't', 'height')} AS y1, {_back('(xc+w/2)*640', 'l', 'width')} AS x2, {_back('(yc+h/2)*640', 't', 'height')} AS y2 FROM boxes JOIN p USING (image_id)")
def _(t):
    rows = t.boxes.join(_sized(t), "image_id").withColumn("f", G.letterbox(F.col("width"), F.col("height"), 640, 640))
    canvas = tuple(c * 640 for c in G.corners(*[F.col(c) for c in ("xc", "yc", "w", "h")]))
    out = G.unletterbox(canvas, F.col("f"), F.col("width"), F.col("height"))
    return rows.select("image_id", "box_seq", *[(c * 1000).alias(n) for c, n in zip(out, ("x1", "y1", "x2", "y2"), strict=True)])


@query("pj15_label_lines", "SELECT image_id, box_seq, cls || ' ' || round(xc, 4) || ' ' || round(yc, 4) || ' ' || round(w, 4) || ' ' || round(h, 4) AS line FROM boxes")
def _(t):
    return t.boxes.select("image_id", "box_seq", G.label_line(F.col("cls"), *[F.round(c, 4) for c in ("xc", "yc", "w", "h")]).alias("line"))


_low = lambda c, n, size: f"least(CAST(trunc(least(greatest(({c}-{n}/2)*{size}, 0), {size})) AS INTEGER), {size} - 1)"
_high = lambda c, n, size: f"greatest(CAST(trunc(least(greatest(({c}+{n}/2)*{size}, 0), {size})) AS INTEGER), {_low(c, n, size)} + 1)"


@query("pj16_crop_windows", f"SELECT image_id, box_seq, {_low('xc', 'w', 40)} AS x1, {_low('yc', 'h', 30)} AS y1, {_high('xc', 'w', 40)} AS x2, {_high('yc', 'h', 30)} AS y2 FROM preds")
def _(t):
    x1, y1, x2, y2 = G.corners(*[F.col(c) for c in ("xc", "yc", "w", "h")])
    out = G.crop_window((x1 * 40, y1 * 30, x2 * 40, y2 * 30), F.lit(40), F.lit(30))
    return t.preds.select("image_id", "box_seq", *[c.alias(n) for c, n in zip(out, ("x1", "y1", "x2", "y2"), strict=True)])


_inter = "greatest(least(g.xc+g.w/2, p.xc+p.w/2) - greatest(g.xc-g.w/2, p.xc-p.w/2), 0) * greatest(least(g.yc+g.h/2, p.yc+p.h/2) - greatest(g.yc-g.h/2, p.yc-p.h/2), 0)"
_union = f"(g.w*g.h + p.w*p.h - {_inter})"
_pixel = "greatest(least(g.xc+g.w/2, p.xc+p.w/2)*640 - greatest(g.xc-g.w/2, p.xc-p.w/2)*640 + 1, 0) * greatest(least(g.yc+g.h/2, p.yc+p.h/2)*640 - greatest(g.yc-g.h/2, p.yc-p.h/2)*640 + 1, 0)"


@query("pj17_overlaps", f"SELECT g.image_id, g.box_seq, round({_iou_of('g', 'p')}, 6) AS safe, round({_inter} / ({_union} + 1e-12), 6) AS plus, round({_inter} / greatest({_union}, 1e-9), 6) AS floor, round({_pixel} / ((g.w*640+1)*(g.h*640+1) + (p.w*640+1)*(p.h*640+1) - {_pixel}), 6) AS pixel FROM boxes g JOIN preds p ON g.image_id = p.image_id AND g.box_seq = p.box_seq")
def _(t):
    both = t.boxes.alias("g").join(t.preds.alias("p"), ["image_id", "box_seq"])
    of = lambda a, k=1: tuple(c * k for c in G.corners(*[F.col(f"{a}.{c}") for c in ("xc", "yc", "w", "h")]))
    return both.select("image_id", "box_seq", *[G.iou(of("g"), of("p"), form).alias(form) for form in ("safe", "plus", "floor")], G.iou(of("g", 640), of("p", 640), "pixel").alias("pixel"))


@query("pj18_soft_score", "SELECT image_id, round((2*sum(conf)+1e-6) / (2*sum(conf)+sum(w)+count(*)+1e-6), 6) AS score FROM preds GROUP BY 1")
def _(t):
    sums = t.preds.groupBy("image_id").agg(F.sum("conf").alias("tp"), F.sum("w").alias("fp"), F.count(F.lit(1)).alias("fn"))
    return sums.select("image_id", G.f_score(F.col("tp"), F.col("fp"), F.col("fn")).alias("score"))


# Filters and budgets


@query("fl01_named_class", "SELECT crop_id FROM crops WHERE cls = 1")
def _(t):
    return files.with_alias(t.crops, {0: "none", 1: "one"}, "one").select("crop_id")


@query("fl04_threshold", 'SELECT count(*) FILTER (w*h <= 0.1) AS "left", count(*) FILTER (w*h >= 0.1) AS "right" FROM boxes')
def _(t):
    return pool.threshold_counts(t.boxes.withColumn("a", F.col("w") * F.col("h")), "a", 0.1)


@query("fl05_class_counts", "SELECT cls, count(*) AS n FROM boxes WHERE cls BETWEEN 0 AND 9 GROUP BY 1")
def _(t):
    return pool.class_counts(t.boxes, 10)


@query("fl06_every_kth", "SELECT image_id FROM images QUALIFY row_number() OVER (ORDER BY image_id) % 7 = 0")
def _(t):
    return select.every_kth(t.images.select("image_id"), 7)


@query("fl07_head_boxes", f"SELECT image_id, box_seq, cls, {', '.join(f'round({c}, 6) AS {c}' for c in ('xc', 'yc', 'w', 'h', 'conf'))} FROM preds WHERE conf > 0.4")
def _(t):
    scores = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.when(i == F.col("cls"), F.col("conf")).otherwise(F.col("conf") / (i + 2)))
    return matching.head_boxes(t.preds.select("image_id", F.col("box_seq").alias("anchor"), F.col("xc").alias("cx"), F.col("yc").alias("cy"), "w", "h", scores.alias("scores")), 0.4)


@query("fl08_class_difference", "WITH c AS (SELECT cls, count(*) FILTER (strategy = 'random') AS a, count(*) FILTER (strategy = 'distance') AS b FROM splits JOIN boxes USING (image_id) WHERE pct = 30 AND strategy IN ('random', 'distance') GROUP BY 1) SELECT cls, a, b, a - b AS diff FROM c WHERE abs(a - b) > 3")
def _(t):
    part = lambda s: t.splits.where((F.col("strategy") == s) & (F.col("pct") == 30))
    return chains.class_difference(part("random"), part("distance"), t.boxes)


@query("j05_complete", "SELECT crop_id, image_id, labeled FROM crops JOIN crop_images USING (image_id)")
def _(t):
    return files.complete(t.crops.select("crop_id", "image_id"), t.crop_images, "image_id")


@query("j19_budget", "SELECT count(*) AS k FROM images WHERE image_id NOT IN (SELECT image_id FROM splits WHERE strategy = 'random' AND pct = 20) AND image_id IN (SELECT image_id FROM splits WHERE strategy = 'random' AND pct = 30)")
def _(t):
    part = lambda pct: t.splits.where((F.col("strategy") == "random") & (F.col("pct") == pct)).select("image_id")
    return t.spark.createDataFrame([(select.baseline_budget(part(20), part(30), t.images.select("image_id")),)], "k long")


@query("d10_resolve", "SELECT strategy, pct, image_id FROM splits WHERE pct > 20 UNION ALL SELECT n.strategy, s.pct, s.image_id FROM splits s, (SELECT DISTINCT strategy FROM splits) n WHERE s.strategy = 'random' AND s.pct <= 20")
def _(t):
    return chains.resolve(t.splits, "random", 20).select("strategy", "pct", "image_id")


# Vectors


@query("t04_closest_crops", f"WITH {NEAR.format(w=64)} SELECT crop_id, {R('score')} AS score, CAST(row_number() OVER (ORDER BY score, crop_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 21")
def _(t):
    return select.closest_crops(t.crops, t.labeled_crops, 20.5)


@query("pj21_angular", f"WITH {NEAR.format(w=64)} SELECT crop_id, round(sqrt(2 * greatest(score, 0)), 6) AS angle FROM d")
def _(t):
    return select.distance_scores(t.crops, t.labeled_crops).select("crop_id", V.angular(F.col("score")).alias("angle"))


@query("pj23_maps", "SELECT crop_id, map_idx, round(list_sum(v), 4) AS total, len(v) AS n FROM (SELECT crop_id, unnest([{'i': 0, 'v': CAST(embedding[1:16] AS DOUBLE[])}, {'i': 1, 'v': CAST(embedding[17:64] AS DOUBLE[])}, {'i': 9, 'v': CAST(embedding[17:64] || embedding[1:16] AS DOUBLE[])}], recursive := true) FROM crops) t(crop_id, map_idx, v)")
def _(t):
    maps = [F.slice("embedding", 1, 16), F.slice("embedding", 17, 48)]
    each = t.crops.select("crop_id", V.separated(maps)).unionByName(t.crops.select("crop_id", F.lit(9).alias("map_idx"), V.concatenated(maps[::-1]).alias("embedding")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return each.select("crop_id", "map_idx", F.round(total, 4).alias("total"), F.size("embedding").cast("long").alias("n"))


@query("sc12_matrix", "SELECT crop_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS at, round(unnest(v) / (n + 1e-12), 6) AS x FROM (SELECT crop_id, v, sqrt(list_sum([x*x FOR x IN v])) AS n FROM (SELECT crop_id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM crops))")
def _(t):
    return files.embedding_matrix(t.crops, 16).select("crop_id", F.posexplode("embedding").alias("at", "x"))


@query("j08_index_all_lists", f"WITH {KNN5} SELECT crop_id, CAST(r AS INTEGER) AS rank, {R('dist')} AS dist FROM p WHERE r <= 5")
def _(t):
    known, rest = select.split_crops(t.crops, t.labeled_crops)
    known = staged(known, "index")
    centres = ann.fit_centres(known, 16)
    found = ann.nearest(rest, known, centres, 5, len(centres))
    return found.select(F.col("query_id").alias("crop_id"), "rank", "dist")


@query("j08_index")
def _(t):
    """Recall against the exact search is measured in the tests."""
    known, rest = select.split_crops(t.crops, t.labeled_crops)
    known = staged(known, "index")
    centres = ann.fit_centres(known, 16)
    return ann.nearest(rest, known, centres, 5, ann.visits_for(known, centres, 5))


@query("j18_distortion", "WITH e AS (SELECT crop_id, CAST(embedding AS DOUBLE[]) AS v FROM crops), d AS (SELECT abs(list_cosine_similarity(a.v, b.v) - list_cosine_similarity(a.v[1:16], b.v[1:16])) AS c FROM e a JOIN e b ON b.crop_id = a.crop_id + 1) SELECT round(avg(c), 6) AS mean_change, round(max(c), 6) AS max_change FROM d")
def _(t):
    crops = t.crops.select("crop_id", "embedding")
    pairs = crops.select(F.col("crop_id").alias("a"), (F.col("crop_id") + 1).alias("b"))
    return ml.distortion(crops, crops.withColumn("embedding", F.slice("embedding", 1, 16)), pairs)


# Stored tables and files, written to the shared folder and read back


@query("sk05_similarity_table", f"WITH {FPS} SELECT crop_id, {R('sum(list_cosine_similarity(fp.e, al.e))')} AS similarity FROM fp, al GROUP BY 1")
def _(t):
    path, crops = _path(t, "similarity"), t.crops.where("cls <> 1")
    for batch in (0, 1):
        files.write_similarity(knn.similarity_sum(crops.where(F.col("crop_id") % 2 == batch), t.crops.where("cls = 1")).select("crop_id", "similarity"), path, str(batch))
    return files.read_similarity(t.spark, path)


@query("sk12_neighbour_table", f"WITH {FPS}, p AS (SELECT fp_id, crop_id, list_cosine_similarity(fp.e, al.e) AS sim FROM fp, al) SELECT fp_id, CAST(row_number() OVER (PARTITION BY fp_id ORDER BY sim DESC, crop_id) AS INTEGER) AS rank, crop_id, {R('sim')} AS sim FROM p QUALIFY rank <= 3")
def _(t):
    path = _path(t, "neighbours")
    files.write_neighbours(knn.top_similar(t.crops.where("cls <> 1"), t.crops.where("cls = 1"), 3), path)
    return t.spark.read.parquet(path)


@query("sc11_stored_crops", "SELECT crop_id, image_id, cls FROM crops WHERE cls = 1")
def _(t):
    path = _path(t, "crops")
    t.crops.write.parquet(path)
    return files.read_crops(t.spark, path, cls=1, labels=t.crops.select("crop_id")).select("crop_id", "image_id", "cls")


@query("sc02_split_list", "SELECT row_number() OVER (ORDER BY image_id % 3, image_id DESC) - 1 AS pos, './images/' || image_id || '.jpg' AS path, CAST(image_id AS VARCHAR) AS image_id FROM images WHERE labeled")
def _(t):
    path = _path(t, "split")
    files.write_split(t.labeled.select((F.col("image_id") % 3).alias("section"), (-F.col("image_id")).alias("pos"), "image_id"), path)
    found = files.read_list(t.spark, path)
    return found.select(F.col("pos").cast("long").alias("pos"), "path", "image_id")


@query("sc15_losses", "SELECT CAST(im_file AS VARCHAR) AS im_file, CAST(epoch AS INTEGER) AS epoch, round(loss_iou, 4) AS loss_iou, round(loss_cls, 4) AS loss_cls, round(loss_dfl, 4) AS loss_dfl FROM per_sample_loss")
def _(t):
    path = _path(t, "losses")
    t.per_sample_loss.select("im_file", "epoch", "loss_iou", "loss_cls", "loss_dfl").write.option("header", True).csv(path)
    four = [F.round(c, 4).alias(c) for c in ("loss_iou", "loss_cls", "loss_dfl")]
    return files.read_losses(t.spark, path).select("im_file", "epoch", *four)
