"""Threshold studies: sweeps, operating points, Pareto frontiers.

Sweeps count rows per cell of the rounded score and accumulate over the cells, so the cost isn't rows times thresholds, and a window without
partition sees no more rows than the rounded score has values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_sweep(rows: DataFrame, score: str, answerable: str, digits: int = 2) -> DataFrame:
    """threshold, false_refusal, false_confidence, youden_j for each distinct rounded score: accepted is what scores at least the threshold."""
    a, grid = F.col(answerable), float(10**digits)
    k = F.round(F.col(score) * grid).cast("bigint")
    cell = F.when(F.col(score) >= k / grid, k).otherwise(k - 1)  # the highest threshold that accepts the row
    by = rows.groupBy(cell.alias("k")).agg(F.count_if(a).alias("yes"), F.count_if(~a).alias("no"))
    th = rows.groupBy(k.alias("k")).agg(F.lit(1).alias("is_threshold"))
    line = by.join(th, "k", "full_outer").fillna(0, ["yes", "no"])
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    x = line.select("is_threshold", (F.col("k") / grid).alias("threshold"), zero(F.sum("yes").over(w)).alias("below_yes"), zero(F.sum("no").over(w)).alias("below_no"), F.sum("yes").over(every).alias("yes"), F.sum("no").over(every).alias("no")).filter("is_threshold = 1")
    fr = F.col("below_yes") / F.greatest(F.col("yes"), F.lit(1))
    fc = (F.col("no") - F.col("below_no")) / F.greatest(F.col("no"), F.lit(1))
    return x.select("threshold", F.round(fr, 6).alias("false_refusal"), F.round(fc, 6).alias("false_confidence"), F.round(1 - fr - fc, 6).alias("youden_j"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of the highest J; the lowest of equals."""
    return sweep.orderBy(F.desc("youden_j"), "threshold").limit(1)


def capped_minimum(sweep: DataFrame, cap: float = 0.04) -> DataFrame:
    """The lowest false confidence whose false refusal is within the cap; the lowest threshold of equals. No row if none is."""
    return sweep.filter(F.col("false_refusal") <= cap).orderBy("false_confidence", "threshold").limit(1)


def confusion(rows: DataFrame, accepted: Column, answerable: str) -> DataFrame:
    a = F.col(answerable)
    return rows.agg(F.count_if(a & accepted).alias("tp"), F.count_if(a & ~accepted).alias("fn"), F.count_if(~a & accepted).alias("fp"), F.count_if(~a & ~accepted).alias("tn"))


def skyline(points: DataFrame, x: str, y: str, tie: list[str]) -> DataFrame:
    """Pareto frontier: in order of x, then y, the points whose y is lower than all before."""
    w = Window.orderBy(x, y, *tie).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_low", F.min(y).over(w)).filter(F.col("_low").isNull() | (F.col(y) < F.col("_low"))).drop("_low")


def grid_sweep(rows: DataFrame, first: str, second: str, answerable: str, digits: int = 1) -> DataFrame:
    """false_refusal and false_confidence of each pair of thresholds (first >= a and second >= b). The grid is that of the rounded values; rows are pre-counted on it, so it is small next to the data."""
    a = F.col(answerable)
    cell = rows.groupBy(F.round(first, digits).alias("a"), F.round(second, digits).alias("b")).agg(F.count_if(a).alias("yes"), F.count_if(~a).alias("no"))
    cell = cell.filter("a is not null and b is not null")
    every = cell.select("a").distinct().join(cell.select("b").distinct(), F.lit(True)).join(cell, ["a", "b"], "left").fillna(0, ["yes", "no"])  # the result has as many rows
    # sums over all cells at or above a, then at or above b
    down = lambda by, order: Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    for by, order in (("b", "a"), ("a", "b")):
        every = every.withColumns({c: F.sum(c).over(down(by, order)) for c in ("yes", "no")})
    total = rows.agg(F.count_if(a).alias("all_yes"), F.count_if(~a).alias("all_no"))
    x = every.withColumnsRenamed({"a": "least_first", "b": "least_second"}).join(F.broadcast(total), F.lit(True))
    return x.select("least_first", "least_second", F.round(1 - F.col("yes") / F.greatest("all_yes", F.lit(1)), 6).alias("false_refusal"), F.round(F.col("no") / F.greatest("all_no", F.lit(1)), 6).alias("false_confidence"))


def percent_declined(rows: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """Share of scores below each fixed threshold."""
    n = F.greatest(F.count(score), F.lit(1))
    cols = [F.struct(F.lit(t).alias("threshold"), F.round(F.count_if(F.col(score) < t) / n, 6).alias("declined")) for t in thresholds]
    return rows.agg(F.array(*cols).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def margins(scored: DataFrame, query: str, score: str) -> DataFrame:
    """Highest score, second highest and their difference per query; one candidate alone has no margin. Two maxima are kept per group before the shuffle."""
    two = scored.groupBy(query).agg(F.max(score).alias("top1"), F.count("*").alias("n"))
    runner = scored.join(two, query).groupBy(query, "top1", "n").agg(F.max(F.when(F.col(score) < F.col("top1"), F.col(score))).alias("_less"), F.count_if(F.col(score) == F.col("top1")).alias("_same"))
    top2 = F.when(F.col("_same") > 1, F.col("top1")).otherwise(F.col("_less"))
    return runner.select(query, "top1", top2.alias("top2"), F.round(F.col("top1") - top2, 6).alias("margin"))
