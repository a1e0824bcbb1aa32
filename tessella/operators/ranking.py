"""Ranks, correlations and overlaps of score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources.staging import staged


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation; null where a column is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def places(df: DataFrame, *order: str, weight: str | None = None) -> DataFrame:
    """df with __below: the rows (or the sum of their weights) before each in the order, and __total: those of all.

    Ranges of the order are sorted each on its own; a range adds what the
    ranges before it hold. No task holds more than its range. Rows that tie on
    the whole order have different places.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = staged(ranges.select("*", F.spark_partition_id().alias("__part"), own.alias("__own")), "places")
    if weight is not None:
        before = W.partitionBy("__part").orderBy("__own").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("__own", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    sizes = rows.groupBy("__part").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"), F.sum("__n").over(W.partitionBy()).alias("__total"))
    # bounded: one row for each range
    return rows.join(F.broadcast(starts), "__part").withColumn("__below", F.col("__start") + F.col("__own")).drop("__part", "__own", "__start")


def ordinal_percentile(scores: DataFrame, column: str, out: str) -> DataFrame:
    """Place over (n - 1), ties in order of image_id."""
    return places(scores, column, "image_id").withColumn(out, F.col("__below") / F.greatest(F.col("__total") - 1, F.lit(1))).drop("__below", "__total")


def average_rank(df: DataFrame, column: str, out: str, *by: str) -> DataFrame:
    """Ties share the mean of their places. For groups that fit in a task; see average_place."""
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, column))
    return df.withColumn(out, F.rank().over(W.partitionBy(*by).orderBy(column)) + (ties - 1) / 2)


def average_place(df: DataFrame, column: str, out: str, *by: str) -> DataFrame:
    """W03 for groups of any size: values are counted before they are ordered, so that a common one is one row."""
    keys = [*by, column]
    values = places(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")), *keys, weight="__c").drop("__total")
    if by:
        starts = values.groupBy(*by).agg(F.min("__below").alias("__first"))
        values = _same(values, starts, list(by)).withColumn("__below", F.col("__below") - F.col("__first")).drop("__first")
    ranks = values.select(*keys, (F.col("__below") + (F.col("__c") + 1) / 2).alias(out))
    return _same(df, ranks, keys)


def percentiles_of(df: DataFrame, value: Column, qs: dict[str, float], *by: str, count: str | None = None) -> DataFrame:
    """by and, for each name of qs, the exact percentile of the group's values that are not null, interpolated; count: how often a row counts.

    Values are counted before they are put in order by ranges, so that no task
    holds a group, however large. A group without values has no row.
    """
    times = F.lit(1) if count is None else F.col(count)
    counted = df.select(*by, value.alias("__v"), times.alias("__times")).where("__v is not null").groupBy(*by, "__v").agg(F.sum("__times").alias("__c"))
    placed = places(counted, *by, "__v", weight="__c").drop("__total")
    sizes = placed.groupBy(*by).agg(F.min("__below").alias("__first"), F.sum("__c").alias("__n"))
    rows = _same(placed, sizes, list(by)) if by else placed.join(F.broadcast(sizes))  # one row
    start = F.col("__below") - F.col("__first")
    at = lambda place: F.max(F.when((start <= place) & (place < start + F.col("__c")), F.col("__v")))
    aggs = []
    for name, q in qs.items():
        place = (F.col("__n") - 1) * F.lit(float(q))
        aggs += [at(F.floor(place)).alias(f"__low_{name}"), at(F.ceil(place)).alias(f"__high_{name}"), F.first(place - F.floor(place)).alias(f"__part_{name}")]
    between = lambda n: F.col(f"__low_{n}") + (F.col(f"__high_{n}") - F.col(f"__low_{n}")) * F.col(f"__part_{n}")
    return rows.groupBy(*by).agg(*aggs).select(*by, *[between(n).alias(n) for n in qs])


def with_columns_of(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left with the other columns of right, null where right has no row of the same keys (nulls are the same); without keys both are one row."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), "left")
    named = right.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    on = [left[k].eqNullSafe(named[f"__k{i}"]) for i, k in enumerate(keys)]
    return left.join(named, on, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, where the keys are the same; nulls are."""
    named = right.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    on = [left[k].eqNullSafe(named[f"__k{i}"]) for i, k in enumerate(keys)]
    return left.join(named, on).drop(*(f"__k{i}" for i in range(len(keys))))


def spearman(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Rho over rows that have both."""
    both = average_place(average_place(scores.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "__a"), b, "__b")
    return both.agg(correlation("__a", "__b").alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_matrix(scores: DataFrame) -> DataFrame:
    """A, b, rho, n of every two methods of scores (method, image_id, score), over images that both score."""
    x, y = scores.toDF("a", "image_id", "sa"), scores.toDF("b", "image_id", "sb")
    both = average_place(average_place(x.join(y, "image_id").where("a < b"), "sa", "ra", "a", "b"), "sb", "rb", "a", "b")
    return both.groupBy("a", "b").agg(correlation("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def top_k(scores: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The best k by score, ties to the smaller image_id."""
    return scores.orderBy(F.asc("score") if ascending else F.desc("score"), "image_id").limit(k)


def top_k_per(scores: DataFrame, k: int, *by: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc("score"), "image_id")
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)  # the limit reaches the window in this form
    return best.withColumn("rank", F.col("rank") - 1)


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """ST03: common images of two selections and their share of k."""
    return a.select("image_id").distinct().join(b.select("image_id").distinct(), "image_id").agg(F.count(F.lit(1)).alias("common")).withColumn("share", F.col("common") / max(1, k))


def method_report(scores: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Method, rho, overlap of each method of scores (method, image_id, score) with the truth (image_id, score)."""
    t = truth.select("image_id", F.col("score").alias("t"))
    both = average_place(average_place(scores.join(t, "image_id"), "score", "rs", "method"), "t", "rt", "method")
    rho = both.groupBy("method").agg(correlation("rs", "rt").alias("rho"))
    best = top_k(truth, k).select("image_id")
    hit = top_k_per(scores, k, "method").join(best, "image_id", "left_semi").groupBy("method").agg(F.count(F.lit(1)).alias("c"))
    return rho.join(hit, "method", "left").select("method", "rho", (F.coalesce("c", F.lit(0)) / max(1, k)).alias("overlap"))
