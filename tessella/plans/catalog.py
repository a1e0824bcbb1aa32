"""Registry of queries over the domain views, each with its SQL where SQL can express it. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions import names as N
from tessella.functions import sampling
from tessella.functions import vectors as V
from tessella.operators import aggregate, chains, knn, matching, metrics, ml, oracles, pool, ranking, select
from tessella.plans.fixtures import oracle, view
from tessella.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The views of one directory by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.dir, name)

    @property
    def labeled_crops(self) -> DataFrame:
        return self.crop_images.where("labeled").select("image_id")

    @property
    def labeled(self) -> DataFrame:
        return self.images.where("labeled").select("image_id")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


K = 20
R = "round({}, 6)".format
# Nearest labelled crop over a prefix: d(crop_id, image_id, cls, score)
LAB = "lab AS (SELECT crop_id, cls, image_id, CAST(embedding AS DOUBLE[]) AS e FROM crops JOIN crop_images USING (image_id) WHERE labeled), unl AS (SELECT crop_id, cls, image_id, CAST(embedding AS DOUBLE[]) AS e FROM crops JOIN crop_images USING (image_id) WHERE NOT labeled)"
NEAR = LAB + ", d AS (SELECT u.crop_id, u.image_id, u.cls, min(1 - list_cosine_similarity(u.e[1:{w}], l.e[1:{w}])) AS score FROM unl u, lab l GROUP BY ALL)"
WEIGHTS = ", wt AS (SELECT cls, 1 / (count(*) / sum(count(*)) OVER () + 0.01) AS weight FROM lab GROUP BY cls)"
TOP = "SELECT image_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score {o}, image_id) AS INTEGER) AS rank FROM s ORDER BY score {o}, image_id LIMIT {k}"


def _s01(how: str, form: str, width: int = 64) -> None:
    sql = f"WITH {NEAR.format(w=width)}{WEIGHTS}, s AS (SELECT image_id, {form} AS score FROM d LEFT JOIN wt USING (cls) GROUP BY image_id) {TOP.format(o='DESC', k=K)}"
    name = f"s01_distance_{how.removesuffix('_sum')}" if width == 64 else f"s05_prefix_div{64 // width}"
    query(name, sql)(lambda t: select.distance(t.crops, t.labeled_crops, K, how, width))


for _how, _form in {"max": "max(score)", "sum": "sum(score)", "mean": "avg(score)", "crop_weighted": "avg(score) * sqrt(count(*))", "class_weighted_sum": "sum(score * coalesce(weight, 100))"}.items():
    _s01(_how, _form)
for _w in (32, 16):
    _s01("max", "max(score)", _w)

KNN5 = LAB + ", p AS (SELECT u.crop_id, u.image_id, 1 - list_cosine_similarity(u.e, l.e) AS dist, row_number() OVER (PARTITION BY u.crop_id ORDER BY 1 - list_cosine_similarity(u.e, l.e)) AS r FROM unl u, lab l)"


@query("s02_density", f"WITH {KNN5}, c AS (SELECT crop_id, image_id, sum(1 / (dist * dist + 1e-6)) AS score FROM p WHERE r <= 5 GROUP BY ALL), s AS (SELECT image_id, min(score) AS score FROM c GROUP BY 1) {TOP.format(o='ASC', k=K)}")
def _(t):
    return select.density(t.crops, t.labeled_crops, K)


@query("j07_knn_distances", f"WITH {KNN5} SELECT crop_id, CAST(r AS INTEGER) AS rank, {R('dist')} AS dist FROM p WHERE r <= 5")
def _(t):
    known, rest = select.split_crops(t.crops, t.labeled_crops)
    near = knn.knn_distances(rest, known, 5)
    return near.select("crop_id", F.posexplode(F.element_at("distances", 1)).alias("pos", "dist")).select("crop_id", (F.col("pos") + 1).alias("rank"), "dist")


WIDTHS = V.prefix_widths(64, [8, 4, 2, 1])
PREFIX = LAB + ", pre AS (SELECT u.crop_id, u.image_id, " + ", ".join(f"min(1 - list_cosine_similarity(u.e[1:{w}], l.e[1:{w}])) AS d{w}" for w in WIDTHS) + " FROM unl u, lab l GROUP BY ALL), var AS (SELECT *, list_var_pop([d8, d16, d32, d64]) AS v FROM pre)"


@query("s03_matryoshka_variance", f"WITH {PREFIX}, s AS (SELECT image_id, max(v) AS score FROM var GROUP BY 1) {TOP.format(o='DESC', k=K)}")
def _(t):
    return select.matryoshka_variance(t.crops, t.labeled_crops, K, WIDTHS)


@query("s06_coarse_to_fine", "WITH " + LAB + """,
c1 AS (SELECT u.crop_id, u.image_id, u.e, min(1 - list_cosine_similarity(u.e[1:8], l.e[1:8])) AS d FROM unl u, lab l GROUP BY ALL),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d DESC, crop_id) AS r FROM c1) WHERE r = 1 ORDER BY d DESC, image_id LIMIT 80),
c2 AS (SELECT u.crop_id, u.image_id, u.e, min(1 - list_cosine_similarity(u.e[1:16], l.e[1:16])) AS d FROM b1 u, lab l GROUP BY ALL),
b2 AS (SELECT * FROM c2 ORDER BY d DESC, image_id LIMIT 40),
s AS (SELECT u.image_id, min(1 - list_cosine_similarity(u.e, l.e)) AS score FROM b2 u, lab l GROUP BY ALL) """ + TOP.format(o="DESC", k=K))
def _(t):
    return select.coarse_to_fine(t.crops, t.labeled_crops, K, 64)


def _space(lo: int, n: int) -> str:
    return f"SELECT image_id, row_number() OVER (ORDER BY max(m) DESC, image_id) - 1 AS place FROM (SELECT u.crop_id, u.image_id, min(1 - list_cosine_similarity(u.e[{lo}:{lo + n - 1}], l.e[{lo}:{lo + n - 1}])) AS m FROM unl u, lab l GROUP BY ALL) GROUP BY image_id QUALIFY place < {K}"


@query("s07_voting", f"WITH {LAB}, ballots AS ({' UNION ALL '.join(_space(*x) for x in ((1, 16), (17, 16), (33, 32)))}), s AS (SELECT image_id, count(*) AS votes, avg(place) AS a FROM ballots GROUP BY 1) SELECT image_id, votes, {R('a')} AS avg_rank, CAST(row_number() OVER (ORDER BY votes DESC, a, image_id) AS INTEGER) AS rank FROM s ORDER BY votes DESC, a, image_id LIMIT {K}")
def _(t):
    return select.voting_stretches(t.crops, t.labeled_crops, K, [(0, 16), (16, 16), (32, 32)])


# Annotations: pool statistics over the labelled images, utilities of the others.
POOL = "lim AS (SELECT image_id FROM images WHERE labeled), pb AS (SELECT boxes.* FROM boxes JOIN lim USING (image_id)), pc AS (SELECT cls, count(*) AS c FROM pb GROUP BY 1), ps AS (SELECT count(*) AS total, coalesce(sum(w*h), 0) / greatest(1, count(*)) AS avg_area FROM pb), ub AS (SELECT b.image_id, b.cls, b.w*b.h AS a, 1/(coalesce(c, 0)/greatest(1, total)+0.01) AS r2, 1/(coalesce(c, 0)/greatest(1, total)+0.001) AS r3, avg_area FROM boxes b LEFT JOIN pc USING (cls), ps)"
FORMS = {
    "o01_density": ("density", "count(*) * (1 + count(DISTINCT cls) / 20)"),
    "o02_class_balance": ("class_balance", "sum(r3)"),
    "o03_diversity": ("diversity", "count(DISTINCT cls) * count(DISTINCT cls) + 10 * stddev_pop(a) + 5 * avg(abs(a - avg_area))"),
    "o04_combined": ("combined", "sum(r2) + 2 * count(DISTINCT cls) + 0.5 * count(*) + 5 * sum(abs(a - avg_area)) / count(*)"),
    "o05_balanced": ("balanced", "0.5 * count(*) + 0.3 * avg(r2) + 2 * count(DISTINCT cls)"),
    "o06_balanced_v1": ("balanced_v1", "0.5 * count(*) + 0.3 * avg(r3) + 2 * count(DISTINCT cls)"),
}


def _oracle(name: str, form: str, sql: str) -> None:
    query(name, f"WITH {POOL}, u AS (SELECT image_id, {sql} AS score FROM ub GROUP BY 1) SELECT image_id, CAST(round(coalesce(score, 0), 6) AS DOUBLE) AS score FROM images LEFT JOIN u USING (image_id) WHERE NOT labeled")(
        lambda t: oracles.oracle(form, select.unlabeled(t.images, t.labeled), t.boxes, t.labeled)
    )


for _name, (_form, _sql) in FORMS.items():
    _oracle(_name, _form, _sql)


def _greedy(rounds: int, step: int) -> str:
    """O09 written out: every round scores the images that are left against the pool so far, which then grows by the best."""
    parts = ["g0 AS MATERIALIZED (SELECT image_id FROM images WHERE labeled)"]
    for i in range(1, rounds + 1):
        parts += [
            f"c{i} AS MATERIALIZED (SELECT cls, count(*) AS c FROM boxes JOIN g{i - 1} USING (image_id) GROUP BY 1)",
            f"t{i} AS MATERIALIZED (SELECT count(*) AS total, coalesce(sum(w*h), 0) / greatest(1, count(*)) AS avg_area FROM boxes JOIN g{i - 1} USING (image_id))",
            f"u{i} AS (SELECT image_id, {FORMS['o04_combined'][1]} AS score FROM (SELECT b.image_id, b.cls, b.w*b.h AS a, 1/(coalesce(c, 0)/greatest(1, total)+0.01) AS r2, avg_area FROM boxes b LEFT JOIN c{i} USING (cls), t{i}) GROUP BY 1)",
            f"h{i} AS (SELECT image_id FROM images LEFT JOIN u{i} USING (image_id) WHERE NOT labeled AND image_id NOT IN (SELECT image_id FROM g{i - 1}) ORDER BY coalesce(score, 0) DESC, image_id LIMIT {step})",
            f"g{i} AS MATERIALIZED (SELECT image_id FROM g{i - 1} UNION ALL SELECT image_id FROM h{i})",
        ]
    return f"WITH {', '.join(parts)} SELECT image_id FROM g{rounds} WHERE image_id NOT IN (SELECT image_id FROM g0)"


@query("o09_greedy", _greedy(10, 2))
def _(t):
    return oracles.greedy_batches(select.unlabeled(t.images, t.labeled), t.boxes, t.labeled, 20)


MEASURES = "max(d64) AS dist_max, avg(d64) AS dist, sum(d64) AS dist_sum, avg(d64) * sqrt(count(*)) AS dist_crop_weighted, avg(v) AS var, avg(d32) AS prefix_div2, avg(d16) AS prefix_div4, count(*) AS n"
HYBRID = f"WITH {PREFIX}, m AS MATERIALIZED (SELECT image_id, {MEASURES} FROM var GROUP BY 1), q AS (SELECT image_id, " + ", ".join(f"(row_number() OVER (ORDER BY {c}, image_id) - 1) / greatest(count(*) OVER () - 1, 1) AS p_{c}" for c in ("dist", "var", "n")) + " FROM m)"
ALPHAS, WEIGHINGS = (0.3, 0.5, 1.0, 2.0), (0.3, 0.5, 1.0)
SCORERS = {"dist_max": "dist_max", "dist_mean": "dist", "dist_sum": "dist_sum", "dist_crop_weighted": "dist_crop_weighted", "variance": "var", "prefix_div2": "prefix_div2", "prefix_div4": "prefix_div4", "crop_count": "n"}


def _measures(t: Tables) -> DataFrame:
    rows, names = select.prefix_distances(t.crops, t.labeled_crops, WIDTHS)
    n = F.count(F.lit(1))
    return rows.groupBy("image_id").agg(
        F.max("d64").alias("dist_max"), F.avg("d64").alias("dist"), F.sum("d64").alias("dist_sum"), (F.avg("d64") * F.sqrt(n)).alias("dist_crop_weighted"),
        F.avg(V.variance([F.col(x) for x in names])).alias("var"), F.avg("d32").alias("prefix_div2"), F.avg("d16").alias("prefix_div4"), n.alias("n"),
    )


@query("o10_hybrid", f"{HYBRID} SELECT alpha, weight, image_id, round(p_dist * pow(p_var, alpha) * pow(p_n, weight), 6) AS score FROM q, (VALUES (CAST(0.3 AS DOUBLE)), (0.5), (1), (2)) a(alpha), (VALUES (CAST(0.3 AS DOUBLE)), (0.5), (1)) b(weight)")
def _(t):
    return oracles.hybrid_grid(_measures(t), list(ALPHAS), list(WEIGHINGS))


_scorers = " UNION ALL ".join(f"SELECT '{name}' AS method, image_id, CAST({c} AS DOUBLE) AS score FROM m" for name, c in SCORERS.items())
_hybrids = " UNION ALL ".join(f"SELECT 'hybrid_{a}_{w}', image_id, p_dist * pow(p_var, CAST({a} AS DOUBLE)) * pow(p_n, CAST({w} AS DOUBLE)) FROM q" for a in ALPHAS for w in WEIGHINGS)
METHODS = f"{HYBRID}, sc AS MATERIALIZED ({_scorers} UNION ALL {_hybrids})"


def _methods(t: Tables) -> DataFrame:
    """method, image_id, score of the eight scorers and the hybrids for every exponent and weight."""
    m = staged(_measures(t), "measures")
    named = F.array(*[F.struct(F.lit(name).alias("method"), F.col(c).cast("double").alias("score")) for name, c in SCORERS.items()])
    label = F.concat(F.lit("hybrid_"), F.format_string("%.1f", "alpha"), F.lit("_"), F.format_string("%.1f", "weight"))
    hybrids = oracles.hybrid_grid(m, list(ALPHAS), list(WEIGHINGS)).select(label.alias("method"), "image_id", "score")
    return m.select("image_id", F.inline(named)).select("method", "image_id", "score").unionByName(hybrids)


@query("e2_method_report", f"{METHODS}, {POOL}, tr AS (SELECT image_id, {FORMS['o04_combined'][1]} AS t FROM ub GROUP BY 1), j AS (SELECT method, image_id, score, t FROM sc JOIN tr USING (image_id)), rk AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2 AS rs, rank() OVER (PARTITION BY method ORDER BY t) + (count(*) OVER (PARTITION BY method, t) - 1) / 2 AS rt FROM j), best AS (SELECT image_id FROM (SELECT image_id, t FROM tr WHERE image_id IN (SELECT image_id FROM m)) ORDER BY t DESC, image_id LIMIT {K}), hit AS (SELECT method, count(*) AS c FROM (SELECT method, image_id, row_number() OVER (PARTITION BY method ORDER BY score DESC, image_id) AS r FROM sc) WHERE r <= {K} AND image_id IN (SELECT image_id FROM best) GROUP BY 1) SELECT method, {R('rho')} AS rho, coalesce(c, 0) / {K} AS overlap FROM (SELECT method, corr(rs, rt) AS rho FROM rk GROUP BY 1) LEFT JOIN hit USING (method)")
def _(t):
    ids = t.crop_images.where("not labeled").select("image_id")
    truth = oracles.oracle("combined", t.boxes.select("image_id").distinct(), t.boxes, t.labeled).join(ids, "image_id", "left_semi")
    return ranking.method_report(_methods(t), truth, K)


@query("m07_spearman_matrix", f"{METHODS}, p AS (SELECT x.method AS a, y.method AS b, x.score AS sa, y.score AS sb FROM sc x JOIN sc y ON x.image_id = y.image_id AND x.method < y.method), rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY sa) + (count(*) OVER (PARTITION BY a, b, sa) - 1) / 2 AS ra, rank() OVER (PARTITION BY a, b ORDER BY sb) + (count(*) OVER (PARTITION BY a, b, sb) - 1) / 2 AS rb FROM p) SELECT a, b, {R('corr(ra, rb)')} AS rho, count(*) AS n FROM rk GROUP BY a, b")
def _(t):
    return ranking.spearman_matrix(_methods(t))


@query("a01_class_hist", "SELECT strategy, pct, cls, count(*) AS n FROM splits JOIN boxes USING (image_id) GROUP BY ALL")
def _(t):
    return pool.class_histogram(t.splits.join(t.boxes, "image_id"), "strategy", "pct")


@query("a02_pool_stats", f"WITH {POOL} SELECT (SELECT count(*) FROM lim) AS num_images, count(*) AS total_boxes, count(DISTINCT cls) AS classes_covered, {R('sum(w*h)/greatest(1,count(*))')} AS avg_area FROM pb")
def _(t):
    return pool.pool_stats(t.labeled, t.boxes)


@query("a03_class_weights", f"WITH {LAB}{WEIGHTS} SELECT cls, {R('weight')} AS weight FROM wt")
def _(t):
    return pool.class_weights(select.split_crops(t.crops, t.labeled_crops)[0])


@query("a05_proxy_features", f"WITH {NEAR.format(w=64)}, g AS (SELECT image_id, count(*) AS n_crops, max(score) AS max_dist, min(score) AS min_dist, avg(score) AS mean_dist, stddev_pop(score) AS std_dist, sum(score) AS sum_dist, median(score) AS median_dist FROM d GROUP BY 1), x AS (SELECT image_id, crop_id, generate_subscripts(e, 1) AS i, unnest(e) AS v FROM unl), y AS (SELECT image_id, i, avg(v) AS mv, stddev_pop(v) AS sv FROM x GROUP BY 1, 2), z AS (SELECT image_id, sqrt(sum(mv*mv)) AS mean_vec_norm, avg(sv) AS mean_dim_std FROM y GROUP BY 1), pr AS (SELECT a.image_id, avg(1 - list_cosine_similarity(a.e, b.e)) AS intra FROM unl a JOIN unl b ON a.image_id = b.image_id AND a.crop_id < b.crop_id GROUP BY 1) SELECT image_id, n_crops, " + ", ".join(f"round({c}, 6) AS {c}" for c in "max_dist min_dist mean_dist std_dist sum_dist median_dist mean_vec_norm mean_dim_std".split()) + ", round(coalesce(intra, 0), 6) AS intra_dist FROM g JOIN z USING (image_id) LEFT JOIN pr USING (image_id)")
def _(t):
    rest = select.split_crops(t.crops, t.labeled_crops)[1]
    return aggregate.proxy_features(select.distance_scores(t.crops, t.labeled_crops), rest)


_stat = ", ".join(f"round(max({n}),6) AS max_{n}, round(avg({n}),6) AS mean_{n}, round(sum({n}),6) AS sum_{n}, round(stddev_pop({n}),6) AS std_{n}" for n in ("d8", "d16", "d32", "d64"))
_diff = ", ".join(f"round(avg({b}-{a}),6) AS diff_mean_{a}_{b}, round(stddev_pop({b}-{a}),6) AS diff_std_{a}_{b}" for a, b in (("d8", "d16"), ("d16", "d32"), ("d32", "d64")))
_var = "round(avg(v),6) AS var_mean, round(max(v),6) AS var_max, round(sum(v),6) AS var_sum"


@query("a06_prefix_features", f"WITH {PREFIX}, rk AS (SELECT *, rank() OVER (PARTITION BY image_id ORDER BY d8) AS r0, rank() OVER (PARTITION BY image_id ORDER BY d64) AS r1 FROM var) SELECT image_id, count(*) AS n_crops, {_stat}, {_diff}, {_var}, round(CASE WHEN count(*) > 2 THEN coalesce(corr(r0, r1), 0) ELSE 0 END, 6) + 0 AS scale_consistency FROM rk GROUP BY 1")
def _(t):
    return aggregate.prefix_features(*select.prefix_distances(t.crops, t.labeled_crops, WIDTHS))


@query("a07_model_features", f"WITH {PREFIX} SELECT image_id, count(*) AS n_crops, {_stat}, {_var}, CAST(0.2 AS DOUBLE) AS from_frac, CAST(0.3 AS DOUBLE) AS to_frac, round((SELECT count(*) FROM crop_images WHERE labeled) / 16551, 6) AS pool_ratio FROM var GROUP BY 1")
def _(t):
    rows, names = select.prefix_distances(t.crops, t.labeled_crops, WIDTHS)
    return aggregate.model_features(rows, names, t.labeled_crops.count(), 0.2, 0.3)


def _utility(t: Tables) -> tuple[DataFrame, list[str]]:
    features = aggregate.prefix_features(*select.prefix_distances(t.crops, t.labeled_crops, WIDTHS))
    truth = oracles.oracle("balanced", features.select("image_id"), t.boxes, t.labeled).withColumnRenamed("score", "utility")
    return staged(features.join(truth, "image_id"), "utility"), [c for c in features.columns if c != "image_id"]


@query("s04_gbm_oracle")
def _(t):
    data, cols = _utility(t)
    half = sampling.bucket(F.col("image_id"), 1, 2)  # learnt on one half of the images, applied to the other
    model = ml.fit_utility(data.where(half == 0), cols, "utility")
    return select.ranked(ml.predict_utility(model, data.where(half == 1), cols), K)


@query("m06_cross_validation")
def _(t):
    data, cols = _utility(t)
    return ml.cross_validate(data, cols, "utility").select("fold", "n", "rho", "rounds", F.explode("gains").alias("g")).select("fold", "n", "rho", "rounds", "g.name", "g.gain")


_quality = "WITH im AS (SELECT s.strategy, s.pct, s.image_id, count(cls) AS n, count(DISTINCT cls) AS u, coalesce(sum(w*h), 0) AS a FROM splits s LEFT JOIN boxes b USING (image_id) GROUP BY ALL), pc AS (SELECT strategy, pct, cls, count(*) AS c FROM splits JOIN boxes USING (image_id) GROUP BY ALL), pp AS (SELECT *, c / sum(c) OVER (PARTITION BY strategy, pct) AS p FROM pc), sp AS (SELECT strategy, pct, count(*) AS classes, -sum(p * ln(p + 1e-10)) AS entropy, max(p) AS top_share FROM pp GROUP BY 1, 2)"


@query("a08_quality", _quality + " SELECT strategy, pct, count(*) AS images, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(sum(n) AS BIGINT) AS boxes, round(sum(n)/count(*), 6) AS boxes_per_image, round(sum(a)/greatest(1, sum(n)), 6) AS avg_area, round(avg(u), 6) AS avg_unique, any_value(classes) AS classes, round(any_value(entropy), 6) AS entropy, round(any_value(top_share), 6) AS top_share FROM im JOIN sp USING (strategy, pct) GROUP BY 1, 2")
def _(t):
    return pool.selection_quality(t.splits, t.boxes, "strategy", "pct")


@query("a09_area", f"SELECT cls, {R('avg(w*h)')} AS mean_area, {R('median(w*h)')} AS median_area, count(*) AS n FROM boxes GROUP BY 1")
def _(t):
    return pool.area_stats(t.boxes, "cls")


STEPS = "mem AS (SELECT DISTINCT strategy, pct, image_id FROM splits), ch AS (SELECT coalesce(n.strategy, o.strategy) AS strategy, coalesce(n.pct, o.pct + 10) AS pct, coalesce(n.image_id, o.image_id) AS image_id, CASE WHEN o.image_id IS NULL THEN 'added' WHEN n.image_id IS NULL THEN 'dropped' ELSE 'kept' END AS change FROM (SELECT * FROM mem WHERE pct > 20) n FULL JOIN (SELECT * FROM mem WHERE pct < 40) o ON n.strategy = o.strategy AND n.pct = o.pct + 10 AND n.image_id = o.image_id)"
BIAS = STEPS + ", pl AS (SELECT cls, count(*) / sum(count(*)) OVER () AS p FROM boxes GROUP BY 1), st AS (SELECT strategy, pct, cls, count(*) AS c FROM ch JOIN boxes USING (image_id) WHERE change = 'added' GROUP BY ALL), sh AS (SELECT *, c / sum(c) OVER (PARTITION BY strategy, pct) AS s FROM st), bias AS (SELECT strategy, cls, avg(coalesce(s, 0) / p) AS bias FROM (SELECT DISTINCT strategy, pct FROM st) CROSS JOIN pl LEFT JOIN sh USING (strategy, pct, cls) GROUP BY ALL)"


@query("a10_bias_pivot", f"WITH {BIAS} SELECT strategy, " + ", ".join(f"round(max(CASE WHEN cls = {i} THEN bias END), 6) AS \"{i}\"" for i in range(20)) + " FROM bias GROUP BY 1")
def _(t):
    return chains.bias_pivot(t.splits, t.boxes, list(range(20)))


@query("w07_bias_shift", f"WITH {BIAS} SELECT cls, round(sum(CASE strategy WHEN 'random' THEN bias WHEN 'reselect' THEN -bias END), 6) AS shift FROM bias GROUP BY 1 HAVING abs(sum(CASE strategy WHEN 'random' THEN bias WHEN 'reselect' THEN -bias END)) > 0.001")
def _(t):
    return chains.shift(chains.class_bias(t.splits, t.boxes), "random", "reselect", 0.001)


@query("j13_jaccard", "WITH mem AS (SELECT DISTINCT strategy, pct, image_id FROM splits), z AS (SELECT strategy, pct, count(*) AS n FROM mem GROUP BY ALL), i AS (SELECT x.pct, x.strategy AS a, y.strategy AS b, count(*) AS i FROM mem x JOIN mem y USING (pct, image_id) GROUP BY ALL) SELECT x.pct, x.strategy AS a, y.strategy AS b, round(coalesce(i, 0) / (x.n + y.n - coalesce(i, 0)), 6) AS jaccard FROM z x JOIN z y ON x.pct = y.pct LEFT JOIN i ON i.pct = x.pct AND a = x.strategy AND b = y.strategy")
def _(t):
    return chains.jaccard(t.splits)


@query("st01_changes", f"WITH {STEPS} SELECT strategy, pct, change, count(*) AS n FROM ch GROUP BY ALL")
def _(t):
    return chains.changes(t.splits).groupBy("strategy", "pct", "change").agg(F.count(F.lit(1)).alias("n"))


@query("st04_monotonicity", f"WITH {STEPS} SELECT strategy, pct, count(*) FILTER (change <> 'added') AS size_prev, count(*) FILTER (change <> 'dropped') AS size, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'dropped') AS dropped, count(*) FILTER (change = 'dropped') = 0 AS monotonic FROM ch GROUP BY ALL")
def _(t):
    return chains.monotonicity(t.splits)


@query("st05_unique", f"WITH {STEPS}, ad AS (SELECT DISTINCT strategy, image_id FROM ch WHERE change = 'added' AND strategy IN ('random', 'distance')), ow AS (SELECT image_id, CASE WHEN count(*) = 2 THEN 'shared' ELSE min(strategy) END AS owner FROM ad GROUP BY 1) SELECT owner, count(*) AS n FROM ow GROUP BY 1")
def _(t):
    return chains.unique_picks(t.splits, "random", "distance")


@query("a11_bg_ratio", "SELECT strategy, pct, round(count(*) FILTER (h IS NULL) / count(*), 6) AS ratio FROM splits LEFT JOIN (SELECT DISTINCT image_id, 1 AS h FROM boxes) USING (image_id) GROUP BY ALL")
def _(t):
    return chains.background_ratio(t.splits, t.boxes)


@query("a12_sizes", f"WITH {STEPS}, n AS (SELECT strategy, pct, count(*) AS n FROM mem GROUP BY ALL), a AS (SELECT strategy, pct, count(*) AS a FROM ch WHERE change = 'added' GROUP BY ALL) SELECT strategy, pct, n, CASE WHEN pct = 20 THEN n ELSE coalesce(a, 0) END AS added FROM n LEFT JOIN a USING (strategy, pct)")
def _(t):
    return chains.sizes(t.splits)


@query("a13_summary", "SELECT strategy, pct, count(DISTINCT image_id) AS images, count(cls) AS boxes, count(DISTINCT cls) AS classes, count(*) FILTER (cls IS NULL) AS backgrounds, round(avg(w*h), 6) AS mean_area, round(median(w*h), 6) AS median_area FROM splits LEFT JOIN boxes USING (image_id) GROUP BY ALL")
def _(t):
    return chains.summary(t.splits, t.boxes)


@query("a14_histogram", "WITH v AS (SELECT w*h AS a FROM boxes), b AS (SELECT CAST(least(floor((a - 0.0) / ((0.35 - 0.0) / 40)), 39) AS INTEGER) AS bin, count(*) AS n FROM v WHERE a BETWEEN 0 AND 0.35 GROUP BY 1) SELECT bin, n, round(n / (sum(n) OVER () * (0.35 / 40)), 6) AS density FROM b")
def _(t):
    return pool.density_histogram(t.boxes.select((F.col("w") * F.col("h")).alias("a")), "a", 0.0, 0.35, 40)


@query("a14_quartiles", "SELECT cls, " + ", ".join(f"round(quantile_cont(w*h, {q}), 6) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75)) + " FROM boxes GROUP BY 1")
def _(t):
    return pool.quartiles(t.boxes.withColumn("a", F.col("w") * F.col("h")), "a", "cls")


@query("a15_loss_stats", "SELECT im_file, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, round(max(x), 6) AS max, round(min(x), 6) AS min, round(first(x ORDER BY epoch, event_id), 6) AS first, round(last(x ORDER BY epoch, event_id), 6) AS last, count(x) AS n, round(first(x ORDER BY epoch, event_id) - last(x ORDER BY epoch, event_id), 6) AS drop FROM (SELECT *, loss_iou AS x FROM per_sample_loss) GROUP BY 1")
def _(t):
    return metrics.loss_stats(t.per_sample_loss)


@query("t03_hardest", "SELECT im_file, round(avg(loss_iou), 6) AS mean FROM per_sample_loss GROUP BY 1 ORDER BY avg(loss_iou) DESC, im_file LIMIT 20")
def _(t):
    return metrics.hardest(metrics.loss_stats(t.per_sample_loss), 20).select("im_file", "mean")


@query("a16_best_metric", "SELECT run, round(max(try_cast(trim(map_raw) AS DOUBLE)), 6) AS best FROM results GROUP BY 1")
def _(t):
    return metrics.best_metric(t.results, "map_raw")


@query("a16_best_fscore", "SELECT run, round(max(CASE WHEN p + r > 0 THEN 2*p*r/(p+r) END), 6) AS best FROM results GROUP BY 1")
def _(t):
    return metrics.best_f_score(t.results, "p", "r")


CHAIN = "WITH mt AS (SELECT run AS chain, (epoch % 5 + 2) * 10 AS pct, max(p) AS value FROM results WHERE epoch % 5 < 3 AND NOT (run <> 'view' AND epoch % 5 = 0) GROUP BY ALL), ct AS (SELECT chain, pct, coalesce(value, CASE WHEN pct = 20 THEN v0 END) AS value FROM (SELECT DISTINCT chain FROM mt) CROSS JOIN (VALUES (20), (30), (40), (50)) f(pct) LEFT JOIN mt USING (chain, pct) LEFT JOIN (SELECT value AS v0 FROM mt WHERE chain = 'view' AND pct = 20) ON true)"


def _chain_table(t: Tables) -> DataFrame:
    rows = t.results.where("epoch % 5 < 3 and not (run <> 'view' and epoch % 5 = 0)").groupBy(F.col("run").alias("chain"), ((F.col("epoch") % 5 + 2) * 10).alias("pct")).agg(F.max("p").alias("value"))
    return metrics.chain_table(rows, t.spark.createDataFrame([(20,), (30,), (40,), (50,)], "pct int"), "view")


@query("j16_chain_table", f"{CHAIN} SELECT chain, pct, {R('value')} AS value FROM ct")
def _(t):
    return _chain_table(t)


@query("a21_metric_frame", f"{CHAIN} SELECT chain, " + ", ".join(f"round(max(CASE WHEN pct = {p} THEN value END), 4) AS \"{p}\"" for p in (20, 30, 40, 50)) + f", {R('avg(value)')} AS mean FROM ct GROUP BY 1")
def _(t):
    return metrics.metric_frame(_chain_table(t), [20, 30, 40, 50])


@query("a19_class_shares", f"WITH {STEPS}, tot AS (SELECT strategy, pct, cls, 100 * count(*) / sum(count(*)) OVER (PARTITION BY strategy, pct) AS x FROM mem JOIN boxes USING (image_id) GROUP BY 1, 2, 3), nw AS (SELECT strategy, pct, image_id FROM mem WHERE pct = 20 UNION ALL SELECT strategy, pct, image_id FROM ch WHERE change = 'added'), nn AS (SELECT strategy, pct, cls, 100 * count(*) / sum(count(*)) OVER (PARTITION BY strategy, pct) AS y FROM nw JOIN boxes USING (image_id) GROUP BY 1, 2, 3) SELECT strategy, pct, cls, round(coalesce(x, 0), 6) AS total_pct, round(coalesce(y, 0), 6) AS new_pct FROM tot FULL JOIN nn USING (strategy, pct, cls)")
def _(t):
    return chains.class_shares(t.splits, t.boxes)


# Predicted and true boxes.
IOU = "coalesce(greatest(least(g.xc+g.w/2, p.xc+p.w/2) - greatest(g.xc-g.w/2, p.xc-p.w/2), 0) * greatest(least(g.yc+g.h/2, p.yc+p.h/2) - greatest(g.yc-g.h/2, p.yc-p.h/2), 0) / nullif(((g.xc+g.w/2)-(g.xc-g.w/2))*((g.yc+g.h/2)-(g.yc-g.h/2)) + ((p.xc+p.w/2)-(p.xc-p.w/2))*((p.yc+p.h/2)-(p.yc-p.h/2)) - greatest(least(g.xc+g.w/2, p.xc+p.w/2) - greatest(g.xc-g.w/2, p.xc-p.w/2), 0) * greatest(least(g.yc+g.h/2, p.yc+p.h/2) - greatest(g.yc-g.h/2, p.yc-p.h/2), 0), 0), 0)"


@query("j11_tp_fp", f"SELECT p.cls, EXISTS (SELECT 1 FROM boxes g WHERE g.image_id = p.image_id AND g.cls = p.cls AND {IOU} >= 0.4) AS tp, count(*) AS n FROM preds p GROUP BY ALL")
def _(t):
    part = lambda df, tp: df.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).select("cls", F.lit(tp).alias("tp"), "n")
    return part(matching.true_positives(t.preds, t.boxes), True).unionByName(part(matching.false_positives(t.preds, t.boxes), False))


@query("fl03_real_fp", f"SELECT image_id, box_seq, {R('conf')} AS conf FROM preds p WHERE conf >= 0.47 AND cls = 1 AND NOT EXISTS (SELECT 1 FROM boxes g WHERE g.image_id = p.image_id AND g.cls = p.cls AND {IOU} > 0.4)")
def _(t):
    return matching.real_false_positives(t.preds, t.boxes).select("image_id", "box_seq", "conf")


BEST = f"bi AS (SELECT g.image_id, g.box_seq, g.cls, coalesce(max({IOU}), 0) AS best_iou FROM boxes g LEFT JOIN preds p USING (image_id, cls) GROUP BY ALL)"


@query("j12_best_iou", f"WITH {BEST} SELECT image_id, box_seq, cls, {R('best_iou')} AS best_iou FROM bi")
def _(t):
    return matching.best_iou(t.boxes, t.preds)


_missed = " + ".join(f"(best_iou < CAST({x!r} AS DOUBLE))::INT" for x in matching.LEVELS)


@query("s08_miss_score", f"WITH {BEST}, {POOL}, mc AS (SELECT image_id, cls, sum(({_missed}) / 10) AS m FROM bi GROUP BY 1, 2), u AS (SELECT image_id, sum(ln(1 + m) / sqrt(coalesce(c, 0) + 1)) AS score FROM mc LEFT JOIN pc USING (cls) GROUP BY 1), s AS (SELECT image_id, coalesce(score, 0) AS score FROM images LEFT JOIN u USING (image_id) WHERE NOT labeled) {TOP.format(o='DESC', k=100)}")
def _(t):
    return select.ranked(matching.miss_scores(select.unlabeled(t.images, t.labeled), t.boxes, t.preds, t.labeled).select("image_id", "score"), 100)


def _iou_of(a: str, b: str, eps: str = "") -> str:
    """Overlap of two boxes given by SQL expressions; eps: added to the union, else an empty union gives 0."""
    side = lambda c, w: f"greatest(least({a}.{c}+{a}.{w}/2, {b}.{c}+{b}.{w}/2) - greatest({a}.{c}-{a}.{w}/2, {b}.{c}-{b}.{w}/2), 0)"
    area = lambda x: f"(({x}.xc+{x}.w/2)-({x}.xc-{x}.w/2))*(({x}.yc+{x}.h/2)-({x}.yc-{x}.h/2))"
    inter = f"{side('xc', 'w')} * {side('yc', 'h')}"
    union = f"{area(a)} + {area(b)} - {inter}"
    return f"({inter} / ({union} + {eps}))" if eps else f"coalesce({inter} / nullif({union}, 0), 0)"


_box = "{'box_seq': box_seq, 'cls': cls, 'xc': xc, 'yc': yc, 'w': w, 'h': h}"
_fits = f"list_filter(s.rem, lambda b: b.cls = q.rem[1].cls AND {_iou_of('b', 'q.rem[1]', '1e-12')} > 0.7)"
SOFT = f"""gl AS (SELECT image_id, list({_box} ORDER BY box_seq) AS gts FROM boxes GROUP BY 1),
pl AS (SELECT image_id, list({{'rem': [{_box}], 'tp': conf, 'fp': CAST(0 AS DOUBLE)}} ORDER BY box_seq) AS ps FROM preds GROUP BY 1),
fo AS (SELECT image_id, ps IS NULL AS none, list_reduce(list_prepend({{'rem': coalesce(gts, []), 'tp': CAST(0 AS DOUBLE), 'fp': CAST(0 AS DOUBLE)}}, coalesce(ps, [])),
  lambda s, q: CASE WHEN len({_fits}) > 0 THEN {{'rem': list_filter(s.rem, lambda o: o.box_seq <> {_fits}[1].box_seq), 'tp': s.tp + q.tp, 'fp': s.fp}} ELSE {{'rem': s.rem, 'tp': s.tp, 'fp': s.fp + q.tp}} END) AS f
  FROM images LEFT JOIN gl USING (image_id) LEFT JOIN pl USING (image_id) WHERE NOT labeled),
s AS (SELECT image_id, CASE WHEN none THEN 'bg' ELSE 'frg' END AS status, (2*f.tp+1e-6) / (2*f.tp+f.fp+len(f.rem)+1e-6) AS score FROM fo),
k AS (SELECT image_id, status, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY status ORDER BY round(score, 9), image_id) AS INTEGER) AS rank FROM s)"""


@query("s09_soft_f1", f"WITH {SOFT} SELECT image_id, status, {R('score')} AS score, rank FROM k WHERE rank <= CASE status WHEN 'bg' THEN 20 ELSE 300 END")
def _(t):
    images = select.unlabeled(t.images, t.labeled)
    return select.two_budgets(matching.soft_f1(images, t.boxes, t.preds).withColumn("score", F.round("score", 9)), 300, 20)


@query("s09_mean_conf", f"WITH m AS (SELECT image_id, avg(conf) AS m FROM preds GROUP BY 1), s AS (SELECT image_id, CASE WHEN m IS NULL THEN 'bg' ELSE 'frg' END AS status, coalesce(m, 1) AS score FROM images LEFT JOIN m USING (image_id) WHERE NOT labeled), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY status ORDER BY round(score, 9), image_id) AS INTEGER) AS rank FROM s) SELECT image_id, status, {R('score')} AS score, rank FROM k WHERE rank <= CASE status WHEN 'bg' THEN 20 ELSE 300 END")
def _(t):
    scores = matching.mean_confidence(select.unlabeled(t.images, t.labeled), t.preds).withColumn("score", F.round("score", 9))
    return select.two_budgets(scores, 300, 20)


_kept = _iou_of("o", "x[1]")


@query("m08_nms", f"""WITH l AS (SELECT image_id, cls, list([{{'box_seq': box_seq, 'xc': xc, 'yc': yc, 'w': w, 'h': h, 'conf': conf}}] ORDER BY conf DESC, box_seq) AS l FROM preds WHERE conf > 0.25 GROUP BY ALL),
k AS (SELECT image_id, cls, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda o: {_kept} > 0.4)) > 0 THEN a ELSE list_concat(a, x) END)) AS b FROM l)
SELECT image_id, cls, b.box_seq AS box_seq, {", ".join(f"round(b.{c}, 6) AS {c}" for c in ("xc", "yc", "w", "h", "conf"))} FROM k QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY b.conf DESC, b.box_seq) <= 300""")
def _(t):
    return matching.suppress(t.preds, 0.4)


@query("pj_geometry", "SELECT image_id, box_seq, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in {"x1": "xc-w/2", "y1": "yc-h/2", "x2": "xc+w/2", "y2": "yc+h/2", "area": "w*h", "px": "xc*640", "ph": "h*480"}.items()) + ", CAST(trunc((xc-w/2)*640) AS INTEGER) AS left_px, least(greatest(CAST(trunc((xc+w/2)*640) AS INTEGER), 0), 640) AS right_px FROM preds")
def _(t):
    box = tuple(F.col(c) for c in ("xc", "yc", "w", "h"))
    x1, y1, x2, y2 = G.corners(*box)
    absolute = (x1 * 640, y1 * 480, x2 * 640, y2 * 480)
    px = G.to_absolute(box, F.lit(640), F.lit(480))
    right = G.clipped(tuple(c.cast("int") for c in absolute), F.lit(640), F.lit(480))[2]
    return t.preds.select("image_id", "box_seq", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), G.area(box[2], box[3]).alias("area"), px[0].alias("px"), px[3].alias("ph"), absolute[0].cast("int").alias("left_px"), right.alias("right_px"))


@query("j15_intra_distance", f"WITH {LAB} SELECT a.image_id, {R('avg(1 - list_cosine_similarity(a.e, b.e))')} AS intra_dist FROM unl a JOIN unl b ON a.image_id = b.image_id AND a.crop_id < b.crop_id GROUP BY 1")
def _(t):
    rest = select.split_crops(t.crops, t.labeled_crops)[1]
    return aggregate.vector_features(rest).where("intra_dist <> 0").select("image_id", "intra_dist")


FPS = "fp AS (SELECT crop_id AS fp_id, CAST(embedding AS DOUBLE[]) AS e FROM crops WHERE cls = 1), al AS (SELECT crop_id, image_id, CAST(embedding AS DOUBLE[]) AS e FROM crops WHERE cls <> 1)"


@query("j10_topn_per_fp", f"WITH {FPS}, p AS (SELECT fp_id, crop_id, list_cosine_similarity(fp.e, al.e) AS sim FROM fp, al), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY fp_id ORDER BY sim DESC, crop_id) AS INTEGER) AS rank FROM p) SELECT fp_id, crop_id, {R('sim')} AS sim, rank FROM r WHERE rank <= 5")
def _(t):
    return knn.top_similar(t.crops.where("cls <> 1"), t.crops.where("cls = 1"), 5)


@query("j09_similarity_sum", f"WITH {FPS} SELECT crop_id, image_id, {R('sum(list_cosine_similarity(fp.e, al.e))')} AS similarity FROM fp, al GROUP BY ALL")
def _(t):
    return knn.similarity_sum(t.crops.where("cls <> 1"), t.crops.where("cls = 1"))


@query("s12_fp_removal", f"WITH {FPS}, c AS (SELECT crop_id, image_id, sum(list_cosine_similarity(fp.e, al.e)) AS x FROM fp, al GROUP BY ALL), s AS (SELECT image_id, max(x) AS score FROM c GROUP BY 1) SELECT image_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, image_id) AS INTEGER) AS rank FROM s QUALIFY rank <= greatest(1, (SELECT count(*) FROM s) * 3 // 100)")
def _(t):
    return select.removal_candidates(t.crops.where("cls <> 1"), t.crops.where("cls = 1"))


@query("s10_modular_fraction", "SELECT image_id FROM images WHERE image_id % 100 <= 30")
def _(t):
    return select.modular_sample(t.images.select("image_id"), F.col("image_id"), 30)


@query("s10_nested_sample", "SELECT image_id FROM images QUALIFY row_number() OVER (ORDER BY md5(image_id || ':7'), image_id) <= round(0.3 * (SELECT count(*) FROM images))")
def _(t):
    return select.nested_sample(t.images.select("image_id"), t.images.count(), 0.3, 7)


@query("t08_pool_order", "SELECT image_id, row_number() OVER (ORDER BY (image_id * 7) % 1009, image_id) - 1 AS place FROM (SELECT image_id FROM images QUALIFY row_number() OVER (ORDER BY md5(image_id || ':3'), image_id) <= round(0.1 * (SELECT count(*) FROM images)))")
def _(t):
    pool = t.images.select("image_id", ((F.col("image_id") * 7) % 1009).alias("pos"))
    return select.in_pool_order(pool, t.images.count(), 0.1, 3).select("image_id", "place")


BACKGROUNDS = "bg AS (SELECT image_id FROM images WHERE NOT labeled AND image_id NOT IN (SELECT image_id FROM boxes) ORDER BY md5(image_id || ':7'), image_id LIMIT 20)"


@query("s11_background", f"WITH {BACKGROUNDS} SELECT image_id FROM bg")
def _(t):
    return select.add_backgrounds(t.images, t.boxes, t.labeled, 20, 7)


@query("fl02_background", "SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM boxes)")
def _(t):
    return pool.background(t.images, t.boxes).select("image_id")


@query("j01_partition", "SELECT labeled, count(*) AS crops, count(DISTINCT image_id) AS images FROM crops JOIN crop_images USING (image_id) GROUP BY 1")
def _(t):
    known, rest = select.split_crops(t.crops, t.labeled_crops)
    n = lambda df, x: df.agg(F.count(F.lit(1)).alias("crops"), F.count_distinct("image_id").alias("images")).select(F.lit(x).alias("labeled"), "crops", "images")
    return n(known, True).unionByName(n(rest, False))


@query("a18_crop_counts", "WITH n AS (SELECT image_id, count(*) AS n FROM crops GROUP BY 1) SELECT round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median, max(n) AS max, CAST(3 * sum(n) AS BIGINT) AS expected FROM n")
def _(t):
    return pool.crop_counts(t.crops, 3)


@query("sk01_ordered_split", f"WITH {BACKGROUNDS}, {POOL}, u AS (SELECT image_id, {FORMS['o04_combined'][1]} AS score FROM ub GROUP BY 1), s AS (SELECT image_id, coalesce(score, 0) AS score FROM images LEFT JOIN u USING (image_id) WHERE NOT labeled), se AS (SELECT image_id, row_number() OVER (ORDER BY score DESC, image_id) AS pos FROM s QUALIFY pos <= 100) SELECT 0 AS section, image_id AS pos, image_id FROM images WHERE labeled UNION ALL SELECT 1, pos, image_id FROM se UNION ALL SELECT 2, image_id, image_id FROM bg")
def _(t):
    own = lambda df: df.select(F.col("image_id").alias("pos"), "image_id")
    chosen = select.ranked(oracles.oracle("combined", select.unlabeled(t.images, t.labeled), t.boxes, t.labeled), 100)
    return select.ordered_split(own(t.labeled), chosen.select(F.col("rank").alias("pos"), "image_id"), own(select.add_backgrounds(t.images, t.boxes, t.labeled, 20, 7)))


@query("pj04_fraction_text", "SELECT DISTINCT p, regexp_replace(regexp_replace(printf('%.4f', p), '0+$', ''), '[.]$', '') AS tag FROM (SELECT l_quantity / 100.0 AS q, CAST(l_quantity AS DOUBLE) / 100 AS p FROM lineitem)")
def _(t):
    rows = t.boxes0.select((F.col("q").cast("double") / 100).alias("p")).distinct()
    return rows.select("p", N.fraction_text(F.col("p")).alias("tag"))


@query("pj22_interleave", "SELECT crop_id, e[1:4] || e[17:20] || e[33:40] || e[5:8] || e[21:24] || e[41:48] || e[9:12] || e[25:28] || e[49:56] || e[13:16] || e[29:32] || e[57:64] AS v FROM (SELECT crop_id, embedding AS e FROM crops)")
def _(t):
    maps = [F.slice("embedding", 1, 16), F.slice("embedding", 17, 16), F.slice("embedding", 33, 32)]
    return t.crops.select("crop_id", V.interleave(maps, [16, 16, 32], 4).alias("v"))


_seen = "x AS (SELECT crop_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM crops), z AS (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM x WHERE CAST('0x' || substr(md5(crop_id || ':42'), 1, 15) AS BIGINT) % 5 = 0 GROUP BY 1)"


def _length(scale: bool, by: str) -> None:
    """All components together keep a row's length, which checks the sample, the centre and the scale; single components are tested against numpy."""
    name = "m02_scaled_pca" if scale else "m01_pca"
    query(name, f"WITH {_seen} SELECT crop_id, round(sqrt(sum(((v - m) / {by}) * ((v - m) / {by}))), 4) AS length FROM x JOIN z USING (i) GROUP BY 1")(
        lambda t: ml.transform_pca(ml.fit_pca(t.crops, 64, scale), t.crops).select("crop_id", F.round(V.norm(F.col("embedding")), 4).alias("length"))
    )


_length(False, "1")
_length(True, "s")


def _entries(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("embedding").alias("at", "x"))


@query("m03_l2", "SELECT crop_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS at, round(unnest(v) / (n + 1e-5), 6) AS x FROM (SELECT crop_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum([x*x FOR x IN CAST(embedding AS DOUBLE[])])) AS n FROM crops)")
def _(t):
    return _entries(ml.l2(t.crops), "crop_id")


@query("m04_batch_standard", "WITH x AS (SELECT crop_id, crop_id % 7 AS b, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM crops), z AS (SELECT b, i, avg(v) AS m, stddev_samp(v) AS s FROM x GROUP BY ALL) SELECT crop_id, CAST(i - 1 AS INTEGER) AS at, round((v - m) / (s + 1e-5), 6) AS x FROM x JOIN z USING (b, i)")
def _(t):
    return _entries(ml.standardise_batches(t.crops.withColumn("batch_id", F.col("crop_id") % 7)), "crop_id")


from tessella.plans import catalog_more  # noqa: E402, F401  registers the rest
