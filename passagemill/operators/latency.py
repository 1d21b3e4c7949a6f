"""Exact percentile families over any number of values.

An order statistic is found without gathering a group: values are counted per distinct value (partly before the shuffle), a
mergeable sketch brackets each wanted rank, and only the distinct values inside the brackets are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _counted(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    return rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("c"))


def order_statistics(rows: DataFrame, group: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """group, n, and one column per name: the value at the zero-based rank that the name's column gives of n. Null and NaN are no values."""
    c = _counted(rows, group, value)
    names = list(ranks)
    n = c.groupBy(*group).agg(F.sum("c").alias("n"))
    wanted = n.select(*group, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), ranks[k].cast("bigint").alias("r")) for k in names])).alias("x")).select(*group, "n", "x.*")
    # brackets from a sketch of the values; what lies below a bracket is only counted
    qs = sorted({min(1.0, max(0.0, i / 64)) for i in range(65)} | {0.001, 0.002, 0.005, 0.98, 0.99, 0.995, 0.998, 0.999})
    sketch = rows.groupBy(*group).agg(F.percentile_approx(value, [float(q) for q in qs], 1000).alias("cuts"))
    cut = _join(c, sketch, group).select(*group, "v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("cell"))
    cells = cut.groupBy(*group, "cell").agg(F.sum("c").alias("in_cell"))
    w = Window.partitionBy(*group).orderBy("cell")
    cells = cells.select(*group, "cell", (F.sum("in_cell").over(w) - F.col("in_cell")).alias("before"), "in_cell")
    hit = _join(wanted, cells, group).filter((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("in_cell"))).select(*group, "name", "r", "cell")
    few = _join(cells, hit.select(*group, "cell").distinct(), [*group, "cell"]).select(*group, "cell", "before")
    inside = _join(cut, few, [*group, "cell"])
    run = Window.partitionBy(*group, "cell").orderBy("v")
    ranked = inside.select(*group, "cell", "v", (F.col("before") + F.sum("c").over(run)).alias("upto"), "c")
    got = _join(hit, ranked, [*group, "cell"]).filter((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("c")))
    got = got.groupBy(*group).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in names])
    return _join(n, got, group).select(*group, "n", *names)


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys equal each other; the keys come once."""
    other = b.select(*[F.col(k).alias(f"_other_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_other_{k}"))
    return a.join(other, on).drop(*[f"_other_{k}" for k in keys])


def nearest_rank(rows: DataFrame, group: list[str], value: str, percents: tuple[int, ...] = (50, 70, 95, 99)) -> DataFrame:
    """Value at index floor(p / 100 * n), at most n - 1; with p100, mean and count."""
    n = F.col("n")
    ranks = {f"p{p}": F.least(F.floor(F.lit(p) / 100 * n), n - 1) for p in percents} | {"p100": n - 1}
    x = order_statistics(rows, group, value, ranks)
    m = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*group).agg(F.round(F.avg(value), 4).alias("mean"))
    return _join(x, m, group).select(*group, F.col("n").alias("count"), *ranks, "mean")


def linear(rows: DataFrame, group: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99), budget: float | None = None) -> DataFrame:
    """Percentiles with linear interpolation between order statistics, average, and whether the p95 keeps a budget."""
    n = F.col("n")
    at = {p: F.lit(p) / 100 * (n - 1) for p in percents}
    ranks = {f"l{p}": F.floor(at[p]) for p in percents} | {f"h{p}": F.ceil(at[p]) for p in percents}
    x = order_statistics(rows, group, value, ranks)
    m = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*group).agg(F.round(F.avg(value), 2).alias("avg"))
    cols = [F.round(F.col(f"l{p}") + (F.col(f"h{p}") - F.col(f"l{p}")) * (at[p] - F.floor(at[p])), 2).alias(f"p{p}") for p in percents]
    y = _join(x, m, group).select(*group, n.alias("n"), "avg", *cols)
    return y if budget is None else y.withColumn("within_budget", F.col(f"p{percents[1]}") <= budget)
