"""Chains of growing splits (strategy, pct, image_id): overlaps, additions, bias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import ranking
from tessella.sources.staging import staged


def jaccard_of(inter: Column, a: Column, b: Column, empty: float = 1.0) -> Column:
    """ST02: `empty` is the value for two empty sets (0 in the other convention)."""
    return F.coalesce(F.try_divide(inter, a + b - inter), F.lit(empty))


def jaccard(splits: DataFrame, empty: float = 1.0) -> DataFrame:
    """Pct, a, b, jaccard of every two strategies at each step, itself included. Pairs are counted by image, not built as sets."""
    members = splits.select("strategy", "pct", "image_id").distinct()
    sizes = members.groupBy("pct", "strategy").agg(F.count(F.lit(1)).alias("n"))
    inter = members.toDF("a", "pct", "image_id").join(members.toDF("b", "pct", "image_id"), ["pct", "image_id"]).groupBy("pct", "a", "b").agg(F.count(F.lit(1)).alias("i"))
    grid = sizes.toDF("pct", "a", "na").join(sizes.toDF("pct", "b", "nb"), "pct")
    return grid.join(inter, ["pct", "a", "b"], "left").select("pct", "a", "b", jaccard_of(F.coalesce("i", F.lit(0)), F.col("na"), F.col("nb"), empty).alias("jaccard"))


def steps(splits: DataFrame) -> DataFrame:
    """Strategy, pct and the step before (null for the first)."""
    return splits.select("strategy", "pct").distinct().withColumn("prev_pct", F.lag("pct").over(W.partitionBy("strategy").orderBy("pct")))


def changes(splits: DataFrame) -> DataFrame:
    """J14, ST01: strategy, pct, image_id, change (added, kept, dropped) of each step but the first."""
    members = splits.select("strategy", "pct", "image_id").distinct()
    pairs = steps(splits).where("prev_pct is not null")
    now = members.join(F.broadcast(pairs), ["strategy", "pct"]).select("strategy", "pct", "image_id", F.lit(1).alias("now"))  # a row for each step
    before = members.withColumnRenamed("pct", "prev_pct").join(F.broadcast(pairs), ["strategy", "prev_pct"]).select("strategy", "pct", "image_id", F.lit(1).alias("before"))
    both = now.join(before, ["strategy", "pct", "image_id"], "full_outer")
    return both.select("strategy", "pct", "image_id", F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "dropped").otherwise("kept").alias("change"))


def monotonicity(splits: DataFrame) -> DataFrame:
    """ST04: sizes, added, dropped and whether each step holds the one before."""
    n = lambda what: F.count_if(F.col("change").isin(*what))
    out = changes(splits).groupBy("strategy", "pct").agg(n(["kept", "dropped"]).alias("size_prev"), n(["kept", "added"]).alias("size"), n(["added"]).alias("added"), n(["dropped"]).alias("dropped"))
    return out.withColumn("monotonic", F.col("dropped") == 0)


def sizes(splits: DataFrame) -> DataFrame:
    """Size of each split and images added to the one before (all for the first)."""
    n = splits.select("strategy", "pct", "image_id").distinct().groupBy("strategy", "pct").agg(F.count(F.lit(1)).alias("n"))
    added = changes(splits).where("change = 'added'").groupBy("strategy", "pct").agg(F.count(F.lit(1)).alias("a"))
    first = F.row_number().over(W.partitionBy("strategy").orderBy("pct")) == 1
    return n.join(added, ["strategy", "pct"], "left").select("strategy", "pct", "n", F.when(first, F.col("n")).otherwise(F.coalesce("a", F.lit(0))).alias("added"))


def class_bias(splits: DataFrame, boxes: DataFrame) -> DataFrame:
    """A10: strategy, cls, bias: a class's share in each step's additions over its share in the pool, mean over steps; absent counts 1e-9 in the pool and 0 in the step."""
    pool = boxes.groupBy("cls").agg(F.count(F.lit(1)).alias("c")).select("cls", (F.col("c") / F.sum("c").over(W.partitionBy())).alias("p"))
    added = changes(splits).where("change = 'added'").join(boxes, "image_id")
    step = added.groupBy("strategy", "pct", "cls").agg(F.count(F.lit(1)).alias("c")).withColumn("s", F.col("c") / F.sum("c").over(W.partitionBy("strategy", "pct")))
    grid = step.select("strategy", "pct").distinct().join(F.broadcast(pool))  # steps by classes
    rows = grid.join(step.select("strategy", "pct", "cls", "s"), ["strategy", "pct", "cls"], "left")
    return rows.groupBy("strategy", "cls").agg(F.avg(F.coalesce("s", F.lit(0.0)) / F.coalesce("p", F.lit(1e-9))).alias("bias"))


def bias_pivot(splits: DataFrame, boxes: DataFrame, classes: list[int]) -> DataFrame:
    """A10: a row for each strategy, a column for each class."""
    return class_bias(splits, boxes).groupBy("strategy").pivot("cls", classes).agg(F.first("bias"))


def shift(bias: DataFrame, a: str, b: str, least: float = 0.2) -> DataFrame:
    """W07, FL08: classes whose bias differs between two strategies by more than `least`."""
    wide = bias.groupBy("cls").pivot("strategy", [a, b]).agg(F.first("bias"))
    return wide.select("cls", (F.col(a) - F.col(b)).alias("shift")).where(F.abs("shift") > least)


def class_difference(a: DataFrame, b: DataFrame, boxes: DataFrame, least: int = 3) -> DataFrame:
    """FL08: cls, a, b, diff: classes whose boxes in two selections differ in number by more than `least`."""
    n = lambda df, out: df.select("image_id").distinct().join(boxes, "image_id").groupBy("cls").agg(F.count(F.lit(1)).alias(out))
    both = n(a, "a").join(n(b, "b"), "cls", "full_outer").na.fill(0, ["a", "b"])
    return both.withColumn("diff", F.col("a") - F.col("b")).where(F.abs("diff") > least)


def unique_picks(splits: DataFrame, a: str, b: str) -> DataFrame:
    """ST05: owner (a, b or shared) and number of the images that the steps of two strategies add."""
    added = changes(splits).where("change = 'added'").where(F.col("strategy").isin(a, b)).select("strategy", "image_id").distinct()
    owner = added.groupBy("image_id").agg(F.when(F.count(F.lit(1)) == 2, "shared").otherwise(F.first("strategy")).alias("owner"))
    return owner.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


def background_ratio(splits: DataFrame, boxes: DataFrame) -> DataFrame:
    """A11."""
    rows = splits.select("strategy", "pct", "image_id").distinct().join(boxes.select("image_id").distinct().withColumn("has", F.lit(1)), "image_id", "left")
    return rows.groupBy("strategy", "pct").agg((F.count_if(F.col("has").isNull()) / F.count(F.lit(1))).alias("ratio"))


def summary(splits: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images, boxes, classes, backgrounds, mean and median area of each split.

    Boxes are first counted by split, class and area, so that what follows is
    small; medians go by ranges of areas, not by split.
    """
    keys = ["strategy", "pct"]
    members = splits.select(*keys, "image_id").distinct()
    filled = boxes.select("image_id").distinct().withColumn("__has", F.lit(1))
    whole = members.join(filled, "image_id", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("__has").isNull()).alias("__none"))
    joined = members.join(boxes.select("image_id", "cls", (F.col("w") * F.col("h")).alias("__a")), "image_id")
    counted = staged(joined.groupBy(*keys, "cls", "__a").agg(F.count(F.lit(1)).alias("__c")), "areas")
    per = counted.groupBy(*keys, "cls").agg(F.sum("__c").alias("__c"), F.sum(F.col("__a") * F.col("__c")).alias("__s"), F.sum(F.when(F.col("__a").isNotNull(), F.col("__c"))).alias("__n"))
    known = F.col("cls").isNotNull()
    stats = per.groupBy(*keys).agg(F.sum(F.when(known, F.col("__c"))).alias("boxes"), F.count_if(known).alias("classes"), F.sum(F.when(~known, F.col("__c"))).alias("__odd"), (F.sum("__s") / F.sum("__n")).alias("mean_area"))
    median = ranking.percentiles_of(counted, F.col("__a"), {"median_area": 0.5}, *keys, count="__c")
    found = ranking.with_columns_of(ranking.with_columns_of(whole, stats, *keys), median, *keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.select(*keys, "images", zero("boxes").alias("boxes"), zero("classes").alias("classes"), (F.col("__none") + zero("__odd")).alias("backgrounds"), "mean_area", "median_area")


def class_shares(splits: DataFrame, boxes: DataFrame) -> DataFrame:
    """Strategy, pct, cls with its percentage of all boxes and of the newly added ones."""
    share = lambda df, out: df.join(boxes, "image_id").groupBy("strategy", "pct", "cls").agg(F.count(F.lit(1)).alias("c")).select("strategy", "pct", "cls", (100 * F.col("c") / F.sum("c").over(W.partitionBy("strategy", "pct"))).alias(out))
    members = splits.select("strategy", "pct", "image_id").distinct()
    first = members.join(F.broadcast(steps(splits).where("prev_pct is null").select("strategy", "pct")), ["strategy", "pct"])
    new = first.select("strategy", "pct", "image_id").unionByName(changes(splits).where("change = 'added'").select("strategy", "pct", "image_id"))
    return share(members, "total_pct").join(share(new, "new_pct"), ["strategy", "pct", "cls"], "full_outer").na.fill(0.0, ["total_pct", "new_pct"])


def resolve(splits: DataFrame, base: str, base_pct: int) -> DataFrame:
    """At or below the base step every strategy uses the base strategy's splits."""
    own = splits.where(F.col("pct") > base_pct)
    shared = splits.where((F.col("strategy") == base) & (F.col("pct") <= base_pct)).drop("strategy")
    names = splits.select("strategy").distinct()
    return own.unionByName(shared.join(F.broadcast(names)).select(own.columns))
