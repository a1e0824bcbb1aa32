"""Hand-made rows for the operators, and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions import names as N
from tessella.functions import vectors as V
from tessella.operators import aggregate, ann, boost, chains, knn, matching, metrics, ml, oracles, pool, ranking, select
from tessella.sources import config, files

BOX = "image_id string, box_seq int, cls int, xc double, yc double, w double, h double"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_iou(spark):
    pairs = [((0, 0, 1, 1), (0, 0, 1, 1), 1), ((0, 0, 1, 1), (2, 2, 3, 3), 0), ((0, 0, 1, 1), (1, 0, 2, 1), 0), ((1, 1, 1, 1), (1, 1, 1, 1), 0), ((0, 0, 2, 1), (1, 0, 3, 1), 1 / 3)]
    for form in ("safe", "plus", "floor"):
        for a, b, want in pairs:
            x, y = one(spark, G.iou(lits(*a), lits(*b), form), G.iou(lits(*b), lits(*a), form))
            assert x == pytest.approx(want, abs=1e-6) and x == y
    assert one(spark, G.iou(lits(0, 0, 9, 9), lits(0, 0, 9, 9), "pixel"))[0] == 1
    assert one(spark, G.iou((F.lit(None).cast("double"),) * 4, lits(0, 0, 1, 1)))[0] is None


def test_boxes(spark):
    b = one(spark, G.polygon_box(F.array(*lits(0.5, 0.5, 0.3, 0.4)), F.lit(1000), F.lit(1000))).c0
    assert (b.xc, b.yc, b.w, b.h) == pytest.approx((0.4, 0.45, 0.2, 0.1))
    assert one(spark, *G.whole_corners(lits(-1.5, 3, 2, 2)))[:2] == (-2, 2)
    fit = one(spark, G.letterbox(F.lit(1280), F.lit(720), 640, 640)).c0
    assert (fit.gain, fit.left, fit.top) == (0.5, 0, 140)
    assert one(spark, *G.crop_window(lits(5, 5, 5, 5), F.lit(10), F.lit(10)))[:] == (5, 5, 6, 6)
    assert one(spark, G.is_normalised(lits(0.5, 0.5, 1, 1)), G.is_normalised(lits(0.6, 0.5, 1, 1)))[:] == (True, False)
    assert one(spark, *G.unletterbox(lits(10, 150, 700, 400), F.struct(F.lit(0.5).alias("gain"), F.lit(0.0).alias("left"), F.lit(140.0).alias("top")), F.lit(1280), F.lit(720)))[:] == (20, 20, 1280, 520)
    assert one(spark, G.f_score(*lits(0, 0, 0)), G.f_score_of(*lits(0, 0)))[:] == (1, None)


def test_vectors(spark):
    v = F.array(*lits(3, 4))
    assert one(spark, V.norm(v), V.cosine_distance(v, v), V.density(F.array(*lits(0, 0, 0, 0, 0))), V.variance(list(lits(1, 3))))[:] == (5, pytest.approx(0, abs=1e-9), pytest.approx(5e6), 1)
    assert V.prefix_widths(64, [8, 4, 2, 1, 1, 100]) == [8, 16, 32, 64, 1] and V.slice_count([16, 24], 10) == 8
    assert one(spark, V.angular(F.lit(0.5)))[0] == 1


def test_names(spark):
    p = F.lit("./images/train/a.b.jpg")
    assert one(spark, N.stem(p), N.basename(p), N.with_suffix(p, ".txt"), N.fraction_text(F.lit(0.3)), N.fraction_text(F.lit(1.0)), N.crop_image(F.lit("x_cropped_2")))[:] == ("a.b", "a.b.jpg", "./images/train/a.b.txt", "0.3", "1", "x")
    assert N.expand("${a}/${b}", {"a": 1, "b": "${a}"}) == "1/${a}"
    with pytest.raises(Exception, match="no crop name"):
        one(spark, N.crop_image(F.lit("x")))
    assert one(spark, N.crop_image(F.lit("x"), strict=False), N.crop_name(F.lit("x"), F.lit(0)), N.crop_name(F.lit("x"), F.lit(2)))[:] == ("x", "x_cropped", "x_cropped_2")


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("./images/a.b.jpg\n\n./images/c.jpg\n./images/a.b.jpg\n")
    assert [r.image_id for r in files.read_list(spark, str(tmp_path / "list.txt")).orderBy("pos").collect()] == ["a.b", "c", "a.b"]
    assert {r.image_id for r in files.read_split(spark, str(tmp_path / "list.txt")).collect()} == {"a.b", "c"}
    labels = tmp_path / "labels"
    labels.mkdir()
    (labels / "a.txt").write_text("1 0.5 0.5 0.2 0.2\n2 0.1 0.1 0.1 0.1 0.9\n3 4\n")
    (labels / "b.txt").write_text("")
    got = files.read_labels(spark, str(labels)).orderBy("box_seq").collect()
    assert [(r.image_id, r.cls, r.conf) for r in got] == [("a", 1, None), ("a", 2, 0.9)]
    truth = files.ground_truth(spark.createDataFrame([("a",), ("b",)], "image_id string"), files.read_labels(spark, str(labels)))
    assert truth.where("cls is null").first().image_id == "b"
    sized = spark.createDataFrame([("a", 100, 100)], "image_id string, width int, height int")
    assert files.read_polygons(spark, str(labels), sized).count() == 2
    (tmp_path / "results.csv").write_text(" epoch, map \n1, 0.5\n2, n/a\n3,\0 0.7\n")
    log = files.read_metrics(spark, str(tmp_path / "results.csv")).withColumn("run", F.lit("r"))
    assert log.columns[:2] == ["epoch", "map"] and metrics.best_metric(log, "map").first().best == 0.7
    split = select.ordered_split(*[spark.createDataFrame([(0, x)], "pos long, image_id string") for x in "cba"])
    files.write_split(split, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [f"./images/{x}.jpg" for x in "cba"]
    df = spark.range(3)
    assert files.write_once(df, str(tmp_path / "once"), 3) and not files.write_once(df, str(tmp_path / "once"), 3)
    with pytest.raises(ValueError, match="no k"):
        files.complete(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([], "k int"), "k")


def test_config():
    good = {"plots": True, "ranges": [0.2, 0.3], "mode": "density", "yolo_args": {"pretrained": False, "seed": 0}}
    assert config.lint(good) == [] and config.lint(good | {"mode": "random", "ranges": []}) == []
    bad = {"mode": "distance", "dataset_name": "COCO", "ranges": [0.2], "prepare_args": {"seg2line": True, "use_dim": 4, "odd": 1}, "yolo_args": {"matryoshka_weights": "[1, 2]", "matryoshka_granularity_divs": "8,4,1"}}
    assert {r for _, r, _ in config.lint(bad, "a_scratch.yaml", frozenset(["seg2line", "use_dim"]))} == {"plots", "ranges", "seg2line", "nested", "lengths", "seed", "pretrained", "layers", "subdir", "keys"}
    assert {r for _, r, _ in config.lint(good | {"prepare_args": {"skip_pca": True, "use_standard_scaler": True}})} == {"scaler"}
    assert {r for _, r, _ in config.lint(bad | {"type": "random_train"})} == {"plots", "lengths", "seed"}
    cfg = config.read_config("mode: density # x\nranges: [0.2, 0.3]\nplots: false\nyolo_args:\n  seed: 1\n  name: \"${mode}_x\"\n")
    assert cfg["ranges"] == [0.2, 0.3] and cfg["yolo_args"]["name"] == "${mode}_x" and config.lint(cfg) == []
    with pytest.raises(ValueError):
        config.read_config("- a")
    assert config.arguments({"skip_pca": True, "use_dim": 4, "divs": [8, 4]}, frozenset(["skip_pca", "use_dim", "divs"])) == ["--skip-pca", "--use-dim", "4", "--divs", "8", "4"]
    with pytest.raises(ValueError):
        config.arguments({"x": 1}, frozenset())
    assert config.with_train_list("path: .\ntrain: 'lists/old.txt' # keep\nval: v\n", "old.txt", "new.txt") == "path: .\ntrain: 'lists/new.txt' # keep\nval: v\n"
    assert config.with_train_list("train: a.txt\ntrain: b/old.txt", "old.txt", "new.txt") == "train: a.txt\ntrain: b/new.txt"
    for text in ("val: old.txt", "train: other.txt", "train:"):
        with pytest.raises(ValueError):
            config.with_train_list(text, "old.txt", "new.txt")
    assert config.threshold("0.47\nx") == 0.47
    timer = config.StepTimer(iter([0.0, 1.5]).__next__)
    timer.mark("a")
    assert timer.text() == "a\t1.500\n"


def test_stored_tables(spark, tmp_path):
    a, b = (spark.createDataFrame([(i, float(i) / 2)], "crop_id long, similarity double") for i in (1, 2))
    path = str(tmp_path / "similarity")
    files.write_similarity(a, path, "1")
    files.write_similarity(b, path, "2")
    files.write_similarity(b, path, "2")  # a batch that is done again
    assert sorted(map(tuple, files.read_similarity(spark, path).collect())) == [(1, 0.5), (2, 1.0)]
    made = []
    make = lambda: made.append(1) or a
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), make).count() == 1
    assert made == [1]
    c = crops(spark)
    files.write_neighbours(knn.top_similar(c.where("cls <> 1"), c.where("cls = 1"), 3), str(tmp_path / "near"))
    assert spark.read.parquet(str(tmp_path / "near")).columns == ["fp_id", "rank", "crop_id", "sim"]
    assert files.with_alias(c, {1: "car"}, "car").count() == files.with_alias(c, {}, 1).count() == 15 and files.with_alias(c, {}, None).count() == 60
    with pytest.raises(ValueError):
        files.with_alias(c, {1: "car"}, "cat")
    m = files.embedding_matrix(c, 4).first().embedding
    assert len(m) == 4 and sum(v * v for v in m) == pytest.approx(1)


def test_image_sizes(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (300).to_bytes(4, "big") + (200).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\x03" * 6
    for name, data in (("a.jpg", jpeg), ("b.jpg", png), ("c.jpg", b"\xff\xd8"), ("d.jpg", b"x"), ("e.jpg", b"GIF89a\x05\x00\x04\x00")):
        (tmp_path / name).write_bytes(data)
    got = {r.image_id: (r.width, r.height) for r in files.read_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a": (640, 480), "b": (300, 200), "c": (None, None), "d": (None, None), "e": (5, 4)}
    assert sorted((r.image_id, r.bytes) for r in files.read_images(spark, str(tmp_path)).collect())[1] == ("b", len(png))
    sizes = spark.createDataFrame([("x", 1280, 720), ("y", 640, 480), ("z", 320, 180)], "image_id string, width int, height int")
    assert [r.image_id for r in files.sized_images(sizes).collect()] == ["x"]
    lines = spark.createDataFrame([("a", "3 " + " ".join(["0.5 0.5"] * 60_000 + ["0.9 0.8"]))], "image_id string, value string")
    box = files.parse_polygons(lines, spark.createDataFrame([("a", 1000, 1000)], "image_id string, width int, height int")).first()
    assert (box.cls, box.w, box.h) == (3, pytest.approx(0.4), pytest.approx(0.3))


def test_soft_f1(spark):
    images = spark.createDataFrame([(x,) for x in ("none", "fp", "fn", "two")], "image_id string")
    box = (0, 0.5, 0.5, 0.2, 0.2)
    truth = spark.createDataFrame([("fn", 0, *box), ("two", 0, *box)], BOX)
    preds = spark.createDataFrame([("fp", 0, *box, 0.9), ("two", 0, *box, 0.8), ("two", 1, *box, 0.6)], BOX + ", conf double")
    got = {r.image_id: (r.status, r.score) for r in matching.soft_f1(images, truth, preds).collect()}
    assert got["none"] == ("bg", 1.0) and got["fp"][1] < 1e-5 and got["fn"] == ("bg", pytest.approx(0, abs=1e-5))
    assert got["two"] == ("frg", pytest.approx(1.6 / 2.2, abs=1e-6))


def test_suppression_and_levels(spark):
    rows = [("a", 0, 0, 0.5, 0.5, 0.2, 0.2, 0.5), ("a", 1, 0, 0.5, 0.5, 0.2, 0.2, 0.9), ("a", 2, 1, 0.5, 0.5, 0.2, 0.2, 0.8), ("a", 3, 0, 0.9, 0.9, 0.1, 0.1, 0.3), ("a", 4, 0, 0.1, 0.1, 0.1, 0.1, 0.2)]
    preds = spark.createDataFrame(rows, BOX + ", conf double")
    assert {r.box_seq for r in matching.suppress(preds).collect()} == {1, 2, 3}
    assert {r.box_seq for r in matching.suppress(preds, most_after=2).collect()} == {1, 2}
    assert [sum(x < t for t in matching.LEVELS) for x in (0, 0.5, 0.72, 1.0)] == [10, 9, 5, 0]
    head = spark.createDataFrame([("a", 0, 0.5, 0.5, 0.1, 0.1, [0.1, 0.9]), ("a", 1, 0.5, 0.5, 0.1, 0.1, [0.1, 0.2])], "image_id string, anchor int, cx double, cy double, w double, h double, scores array<double>")
    assert [(r.box_seq, r.cls) for r in matching.head_boxes(head, 0.25).collect()] == [(0, 1)]


def test_budgets():
    assert select.budget(10, 0.2, 0.3) == (0, 0) and select.budget(1000, 0.25, 0.5, 0.1) == (225, 25)
    for bad in (("odd", 1, None), ("distance", None, None), ("distance", 1, 2)):
        with pytest.raises(ValueError):
            select.check(*bad)


def test_jaccard_conventions(spark):
    for empty in (1.0, 0.0):
        assert one(spark, chains.jaccard_of(F.lit(0), F.lit(0), F.lit(0), empty), chains.jaccard_of(F.lit(2), F.lit(2), F.lit(2)), chains.jaccard_of(F.lit(0), F.lit(2), F.lit(0)))[:] == (empty, 1, 0)
    splits = spark.createDataFrame([("s", 20, "a"), ("s", 20, "b"), ("s", 30, "a"), ("s", 30, "c")], "strategy string, pct int, image_id string")
    r = chains.monotonicity(splits).first()
    assert (r.size_prev, r["size"], r.added, r.dropped, r.monotonic) == (2, 2, 1, 1, False)
    assert chains.resolve(splits.unionByName(splits.withColumn("strategy", F.lit("t"))), "s", 20).count() == 8


def crops(spark, n=60, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 8))
    return spark.createDataFrame([(i, i // 3, i % 4, [float(v) for v in r]) for i, r in enumerate(x)], "crop_id long, image_id long, cls int, embedding array<float>")


def test_knn_blocks_and_selection(spark):
    c = crops(spark)
    labeled = c.where("image_id < 8").select("image_id").distinct()
    known, rest = select.split_crops(c, labeled)
    as_map = lambda df: {r.crop_id: [[round(v, 9) for v in d] for d in r.distances] for r in df.collect()}
    whole = as_map(knn.knn_distances(rest, known, 3, [4, 8]))
    assert whole == as_map(knn.knn_distances(rest, known, 3, [4, 8], cells=9)) and all(len(d) == 3 for v in whole.values() for d in v)
    assert all(d == [[]] for d in as_map(knn.knn_distances(rest, known.limit(0), 3)).values())
    ids = lambda df: [r.image_id for r in df.orderBy("rank").collect()]
    best = ids(select.distance(c, labeled, 5))
    assert best == ids(select.voting([c], labeled, 5)) == ids(select.voting_stretches(c, labeled, 5, [(0, 8)])) == ids(select.coarse_to_fine(c, labeled, 5, 8, k1=10, k2=10, d1=1, d2=1))
    mean = {r.image_id: r.score for r in aggregate.by_image(select.distance_scores(c, labeled), "mean").collect()}
    total = {r.image_id: r.score for r in aggregate.by_image(select.distance_scores(c, labeled), "sum").collect()}
    assert all(abs(3 * mean[k] - total[k]) < 1e-9 for k in mean)
    with pytest.raises(ValueError):
        aggregate.by_image(select.distance_scores(c, labeled), "odd")
    rows = [(r.crop_id, r.cls, np.array(r.embedding, float)) for r in c.collect()]
    sim = {(f, o): float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) for f, a, x in rows if a == 1 for o, b, y in rows if b != 1}
    sums = {r.crop_id: r.similarity for r in knn.similarity_sum(c.where("cls <> 1"), c.where("cls = 1")).collect()}
    assert all(abs(sums[o] - sum(v for (_, x), v in sim.items() if x == o)) < 1e-6 for o in sums)
    want = sorted((f, n + 1, o) for f in {f for f, _ in sim} for n, (_, o) in enumerate(sorted((-v, o) for (x, o), v in sim.items() if x == f)[:4]))
    for cells in (None, 1, 9):
        assert sorted((r.fp_id, r["rank"], r.crop_id) for r in knn.top_similar(c.where("cls <> 1"), c.where("cls = 1"), 4, cells).collect()) == want


def test_knn_repeats_and_grids(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 4)).astype(np.float32)
    rows = [(i % 30, 0, 0, x[i % 20].tolist()) for i in range(90)] + [(99, 0, 0, None)]  # ids and vectors repeat
    df = spark.createDataFrame(rows, "crop_id long, image_id long, cls int, embedding array<float>").repartition(3)
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[20:])], "crop_id long, embedding array<float>").repartition(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.sort(1 - unit(x[:20].astype(float)[:, :3]) @ unit(x[20:].astype(float)[:, :3]).T, axis=1)[:, :4]
    want = sorted((i % 30, *near[i % 20].round(9)) for i in range(90))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "POOL_BLOCK", 11)
    for cells in (None, 1, 4, 30):
        got = knn.knn_distances(df, pool, 4, [3], cells)
        assert got.columns == [*df.columns, "distances"]
        assert sorted((r.crop_id, *np.round(r.distances[0], 9)) for r in got.collect()) == want


def test_lists_around_centres(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 16)) * 2
    x = centre[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[100:])], "crop_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:100])], "crop_id long, embedding array<float>")
    centres = ann.fit_centres(pool, 24)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    order = np.argsort(-(unit(x[:100].astype(np.float32).astype(float)) @ unit(x[100:].astype(np.float32).astype(float)).T), axis=1)[:, :5]
    exact = spark.createDataFrame([(i, int(j)) for i, r in enumerate(order) for j in r], "query_id long, crop_id long")
    assert ann.recall_of(ann.nearest(asked, pool, centres, 5, 8), exact) >= 0.9
    assert ann.recall_of(ann.nearest(asked, pool, centres, 5, len(centres)), exact) == 1
    assert ann.fit_centres(pool.limit(0), 4).shape == (0, 0)


def test_rank_properties(spark):
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 1, 2])], "image_id long, score double")
    assert [r.x for r in ranking.average_rank(s, "score", "x").orderBy("image_id").collect()] == [4, 1.5, 1.5, 3]
    assert ranking.spearman(s.withColumn("b", F.col("score")), "score", "b").first().rho == pytest.approx(1)
    assert ranking.spearman(s.withColumn("b", F.lit(1.0)), "score", "b").first().rho is None
    assert [r.image_id for r in ranking.top_k(s, 2, ascending=True).collect()] == [1, 2]
    assert ranking.overlap(s, s.where("image_id < 2"), 4).first().share == 0.5


def test_places_of_large_groups(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab") if i % 9 else None, rng.choice([0.0, 0.0, 0.0, 1.5, rng.random(), float("nan"), None])) for i in range(300)]
    s = spark.createDataFrame(rows, "image_id long, g string, score double").repartition(7)
    got = ranking.average_place(s, "score", "x", "g")
    assert got.columns == [*s.columns, "x"]
    table = lambda df: sorted((r.image_id, r.x) for r in df.collect())
    assert table(got) == table(ranking.average_rank(s, "score", "x", "g"))
    assert table(ranking.average_place(s, "score", "x")) == table(ranking.average_rank(s, "score", "x"))
    key = lambda r: (r[2] is not None, (r[2] != r[2], 0 if r[2] != r[2] else r[2]) if r[2] is not None else (), r[0])
    want = sorted((r[0], n / 299) for n, r in enumerate(sorted(rows, key=key)))
    assert table(ranking.ordinal_percentile(s, "score", "x")) == want
    assert ranking.places(s.where("image_id < 0"), "score").count() == 0
    assert sorted(r.image_id for r in select.every_kth(s, 7).collect()) == list(range(6, 300, 7))
    two = [(i, "bg" if i < 4 else "frg", float(-i)) for i in range(10)]
    chosen = select.two_budgets(spark.createDataFrame(two, "image_id long, status string, score double"), 3, 1)
    assert sorted(r.image_id for r in chosen.collect()) == [3, 7, 8, 9]


def test_pools(spark):
    images = spark.createDataFrame([("a",), ("b",)], "image_id string")
    none = spark.createDataFrame([], BOX)
    r = pool.pool_stats(images, none).first()
    assert (r.num_images, r.total_boxes, r.avg_area) == (2, 0, 0)
    boxes = spark.createDataFrame([("a", 0, 1, 0.5, 0.5, 0.2, 0.5)], BOX)
    for name in oracles.forms():
        assert {x.image_id: x.score for x in oracles.oracle(name, images, boxes, images).collect()}["b"] == 0
    q = pool.selection_quality(images, none).first()
    assert (q.images, q.empty, q.boxes, q.classes, q.entropy) == (2, 2, 0, 0, 0)
    assert pool.DEFAULT_WEIGHT == 100
    stats = metrics.loss_stats(spark.createDataFrame([("f", 1, 2.0)], "im_file string, epoch int, loss_iou double")).first()
    assert stats.std == 0 and stats.drop == 0


def test_baseline(spark):
    ids = lambda s: spark.createDataFrame([(x,) for x in s], "image_id string")
    assert select.baseline_budget(ids("a"), ids("abc"), ids("abcd")) == 2
    for start, base in (("aa", "ab"), ("a", "az"), ("a", "a")):
        with pytest.raises(ValueError):
            select.baseline_budget(ids(start), ids(base), ids("abcd"))


def test_percentiles_by_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, rng.random(), rng.random()])) for _ in range(400)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.low, r.mid, r.high) for r in ranking.percentiles_of(df, F.col("v"), {"low": 0.25, "mid": 0.5, "high": 0.75}, "g").collect()}
    assert set(got) == {"a", "b", None}
    for g, found in got.items():
        assert found == pytest.approx(tuple(np.percentile([v for x, v in rows if x == g and v is not None], [25, 50, 75])))
    assert ranking.percentiles_of(df, F.col("v"), {"m": 0.5}).first().m == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_boosted_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = np.where(x[:, 0] > 0.3, 4.0, 0.0) + x[:, 1] ** 2
    x[::17, 2] = np.nan
    model = boost.Boosted(x[:450], y[:450], (x[450:], y[450:]))
    error = np.abs(model.predict(x[450:]) - y[450:]).mean()
    assert error < 0.2 * np.abs(y[450:] - y.mean()).mean()
    assert 20 < len(model.trees) <= 300 and model.gains[0] > model.gains[1] > 10 * model.gains[2:].max()

    def walk(tree, row):  # one row after the other
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if row[tree.feature[node]] <= tree.cut[node] else tree.right[node]
        return tree.value[node]

    bins = boost.binned(x[:20], model.cuts)
    assert model.predict(x[:20]) == pytest.approx([model.start + model.rate * sum(walk(t, r) for t in model.trees) for r in bins])
    errors = [np.abs(y[450:] - p).mean() for p in np.cumsum([model.start + 0 * y[450:], *(model.rate * t.predict(boost.binned(x[450:], model.cuts)) for t in model.trees)], axis=0)]
    assert int(np.argmin(errors)) == len(model.trees)  # the best round is the last one kept
    noise = boost.Boosted(x[:300], rng.normal(size=300), (x[300:], rng.normal(size=300)))
    assert len(noise.trees) < 40
    first = boost.Boosted(x[:450], y[:450], None, 1, leaves=2, rate=1.0).trees[0]
    splits = [(s, f) for f in range(4) for s in np.unique(boost.binned(x[:450], model.cuts)[:, f])]
    b = boost.binned(x[:450], boost.bin_cuts(x[:450]))
    loss = lambda m: sum(((y[:450][k] - y[:450][k].mean()) ** 2).sum() for k in (m, ~m))
    able = [(loss(b[:, f] <= s), f, s) for s, f in splits if min((b[:, f] <= s).sum(), (b[:, f] > s).sum()) >= 20]
    assert loss(b[:, first.feature[0]] <= first.cut[0]) == pytest.approx(min(able)[0])
    assert boost.rank_correlation(np.array([1, 2, 2, 5.0]), np.array([1, 3, 3, 4.0])) == pytest.approx(1) and boost.rank_correlation(np.ones(3), np.arange(3.0)) is None


def test_utility_model(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    f = spark.createDataFrame([(i, float(a), float(b), float(3 * a + b)) for i, (a, b) in enumerate(x)], "image_id long, a double, b double, y double")
    cv = ml.cross_validate(f, ["a", "b"], "y").collect()
    assert sorted(r.fold for r in cv) == list(range(5)) and sum(r.n for r in cv) == 400 and all(r.rho > 0.9 and r.rounds <= 300 and r.gains[0].gain > r.gains[1].gain for r in cv)
    model = ml.fit_utility(f.where("image_id < 300"), ["a", "b"], "y")
    ml.save_model(model, spark, str(tmp_path / "model"))
    same = ml.load_model(spark, str(tmp_path / "model"))
    new = f.where("image_id >= 300")
    got = {r.image_id: r.score for r in ml.predict_utility(same, new, ["a", "b"]).collect()}
    assert len(got) == 100 and boost.rank_correlation(np.array([got[i] for i in range(300, 400)]), 3 * x[300:, 0] + x[300:, 1]) > 0.9


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(80, 5)) * [5, 3, 2, 1, 0.5] + 7).astype(np.float32).astype(float)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "crop_id long, embedding array<double>")
    for scale in (False, True):
        z = (x - x.mean(0)) / (x.std(0, ddof=1) if scale else 1)
        want = z @ np.linalg.svd(z, full_matrices=False)[2][:3].T
        rows = ml.transform_pca(ml.fit_pca(c, 3, scale, one_in=1), c).orderBy("crop_id").collect()
        got = np.array([r.embedding for r in rows])
        assert np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-6)


def test_samples(spark):
    images = spark.createDataFrame([(i, 1000 - i) for i in range(200)], "image_id long, pos long")
    small = {r.image_id for r in select.nested_sample(images, 200, 0.1, 7).collect()}
    large = {r.image_id for r in select.nested_sample(images, 200, 0.3, 7).collect()}
    assert len(small) == 20 and len(large) == 60 and small < large != {r.image_id for r in select.nested_sample(images, 200, 0.3, 8).collect()}
    placed = select.in_pool_order(images, 200, 0.1, 7).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(20)) and [r.pos for r in placed] == sorted(r.pos for r in placed) and {r.image_id for r in placed} == small
    assert select.in_pool_order(images, 200, 0.0001, 7).count() == 1
    with pytest.raises(ValueError):
        select.in_pool_order(images, 1000, 0.5, 7)


def test_models(spark):
    c = crops(spark)
    model = ml.fit_pca(c, 100, one_in=1)
    out = ml.transform_pca(model, c)
    assert out.select(F.size("embedding").alias("n")).first().n == 8
    pairs = spark.createDataFrame([(0, 1), (2, 9)], "a long, b long")
    assert ml.distortion(c, c.withColumn("embedding", F.transform("embedding", lambda x: x * 2)), pairs).first().max_change < 1e-6
    with pytest.raises(ValueError):
        ml.distortion(c, c.limit(3), pairs)
