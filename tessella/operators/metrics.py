"""Training logs: losses of samples, best metrics of runs, tables over fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry as G


def clean_number(c: Column) -> Column:
    """SC14: a padded cell that may hold NUL bytes; null if it is no number."""
    return F.trim(F.replace(c, F.lit("\0"), F.lit(""))).try_cast("double")


def loss_stats(log: DataFrame, loss: str = "loss_iou") -> DataFrame:
    """Statistics of each file's losses; first, last and drop go by (epoch, event_id) where there is such a column."""
    x = F.col(loss)
    order = F.struct("epoch", *(["event_id"] if "event_id" in log.columns else []))
    return log.groupBy("im_file").agg(
        F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.max(x).alias("max"), F.min(x).alias("min"),
        F.min_by(x, order).alias("first"), F.max_by(x, order).alias("last"), F.count(x).alias("n"),
    ).withColumn("drop", F.col("first") - F.col("last"))


def hardest(stats: DataFrame, k: int, column: str = "mean", ascending: bool = False) -> DataFrame:
    """T03."""
    return stats.orderBy(F.asc(column) if ascending else F.desc(column), "im_file").limit(k)


def best_metric(results: DataFrame, column: str) -> DataFrame:
    """The greatest value of each run; null if no cell is a number."""
    return results.groupBy("run").agg(F.max(clean_number(F.col(column))).alias("best"))


def best_f_score(results: DataFrame, precision: str, recall: str) -> DataFrame:
    """A16, PJ18: the greatest F of each run; rows with P + R = 0 don't count."""
    return results.groupBy("run").agg(F.max(G.f_score_of(F.col(precision), F.col(recall))).alias("best"))


def chain_table(metrics: DataFrame, fractions: DataFrame, base: str, base_pct: int = 20) -> DataFrame:
    """Chain, pct, value for every chain and fraction, missing ones null; at the base fraction a chain without a value takes the base chain's. metrics: chain, pct, value."""
    grid = metrics.select("chain").distinct().join(F.broadcast(fractions.select("pct")))  # chains by fractions
    start = metrics.where((F.col("chain") == base) & (F.col("pct") == base_pct)).select("pct", F.col("value").alias("v0"))
    rows = grid.join(metrics, ["chain", "pct"], "left").join(F.broadcast(start), "pct", "left")
    return rows.select("chain", "pct", F.coalesce("value", F.when(F.col("pct") == base_pct, F.col("v0"))).alias("value"))


def metric_frame(table: DataFrame, pcts: list[int]) -> DataFrame:
    """A21, SK10: a row for each chain with its values rounded to four places, and their mean."""
    wide = table.groupBy("chain").pivot("pct", pcts).agg(F.round(F.first("value"), 4))
    mean = table.groupBy("chain").agg(F.avg("value").alias("mean"))
    return wide.join(mean, "chain")


def display(value: Column) -> Column:
    """SK10: four decimals, or a dash."""
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.4f", value))
