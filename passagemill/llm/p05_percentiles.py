"""Problem 5: percentiles of latencies per language and decision, from digests that merge.

Method: merging centroid digests. Sorted values are clustered so that a cluster spans at most one unit of
k(q) = delta / (2 pi) asin(2q - 1): clusters are narrow at the ends of the distribution. Digests merge by clustering their
centroids again, so days, arrival classes or partitions combine in any order. A second pass over the data counts how many
values lie below and at each estimate and so certifies its rank error; the stated bound is BOUND.

A request delivered twice (same request_id) is one sample, that with the lowest received_at. Null, NaN and infinite values
are no samples; a null language or decision is a group of its own; a missing stage gives no value. A request without id is a
sample of its own. Groups of a few values keep every value, and their percentiles are values of the group.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written

DELTA = 400
BOUND = 0.01
QUANTILES = (0.5, 0.9, 0.95, 0.99)
KEYS = ["metric", "language", "decision"]
#: Values a task buffers before it turns them into digests.
BUFFER = 1_000_000


def cluster(means: np.ndarray, weights: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of sorted-by-mean merging: each cluster spans at most one unit of the scale function."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    if len(means) <= delta // 4:
        return means, weights
    mid = (np.cumsum(weights) - weights / 2) / total
    k = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * mid - 1, -1, 1))).astype(np.int64)
    head = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
    w = np.add.reduceat(weights, head)
    return np.add.reduceat(means * weights, head) / w, w


def estimate(means: np.ndarray, weights: np.ndarray, low: float, high: float, qs=QUANTILES) -> list[float]:
    """Quantiles of a digest: a value of the group where every centroid is one value, else between the centroids around the rank."""
    total = weights.sum()
    if (weights == 1).all():
        return [float(means[min(len(means) - 1, max(0, int(np.ceil(q * total - 1e-9)) - 1))]) for q in qs]
    mid = np.cumsum(weights) - weights / 2
    return [float(x) for x in np.clip(np.interp([q * total for q in qs], np.concatenate([[0], mid, [total]]), np.concatenate([[low], means, [high]])), low, high)]


def samples(rows: DataFrame) -> DataFrame:
    """metric, language, decision, day, arrival, value of each distinct sample."""
    cut = rows.select("request_id", "language", "decision", F.col("total_backend_ms").alias("total"), F.col("stages_ms")["rerank"].alias("rerank"), "sampled_at", "received_at")
    ids = cut.filter("request_id is not null").groupBy("request_id").agg(F.min_by(F.struct("language", "decision", "total", "rerank", "sampled_at", "received_at"), F.struct(F.coalesce("received_at", F.lit("9999-01-01").cast("timestamp_ntz")), F.coalesce("total", F.lit(-1.0)), F.coalesce("rerank", F.lit(-1.0)))).alias("x")).select("x.*")
    one = ids.unionByName(cut.filter("request_id is null").drop("request_id"))
    long = one.select(
        "language", "decision", F.to_date("sampled_at").alias("day"), F.when(F.col("received_at") >= F.col("sampled_at") + F.expr("interval 1 day"), "late").otherwise("on time").alias("arrival"),
        F.explode(F.array(F.struct(F.lit("total_backend_ms").alias("metric"), F.col("total").alias("value")), F.struct(F.lit("rerank").alias("metric"), F.col("rerank").alias("value")))).alias("m"),
    )
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return long.select("m.metric", "language", "decision", "day", "arrival", "m.value").filter(finite)


DIGEST = "n bigint, low double, high double, means array<double>, weights array<double>"


def partial_digests(values: DataFrame, keys: list[str]) -> DataFrame:
    """A digest per group and task."""
    types = {f.name: f.dataType.simpleString() for f in values.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = defaultdict(list)
        size = 0

        def flush() -> pd.DataFrame:
            out = []
            for key, parts in held.items():
                v = np.concatenate(parts)
                m, w = cluster(v, np.ones(len(v)))
                out.append((*key, len(v), v.min(), v.max(), m, w))
            held.clear()
            return pd.DataFrame(out, columns=[*keys, "n", "low", "high", "means", "weights"])

        for b in batches:
            codes = [pd.factorize(b[k], use_na_sentinel=False) for k in keys]
            flat = np.zeros(len(b), dtype=np.int64)
            for c, u in codes:
                flat = flat * len(u) + c
            order = np.argsort(flat, kind="stable")
            v, g = b["value"].to_numpy()[order], flat[order]
            heads = np.flatnonzero(np.diff(g, prepend=-1))
            for x, y in zip(heads, [*heads[1:], len(g)]):
                at = order[x]
                held[tuple(None if pd.isna(u[c[at]]) else u[c[at]] for c, u in codes)].append(v[x:y])
            size += len(b)
            if size >= BUFFER:
                yield flush()
                size = 0
        yield flush()

    return values.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + DIGEST)


def merge_digests(digests: DataFrame, keys: list[str]) -> DataFrame:
    """One digest per group of keys: the centroids of all its digests clustered again. Each task merges its groups as they come, never a whole group at once."""
    types = {f.name: f.dataType.simpleString() for f in digests.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for b in batches:
            for *key, n, low, high, means, weights in b[[*keys, "n", "low", "high", "means", "weights"]].itertuples(index=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                h = held.get(key)
                if h is None:
                    held[key] = [n, low, high, [means], [weights], len(means)]
                    continue
                h[0], h[1], h[2] = h[0] + n, min(h[1], low), max(h[2], high)
                h[3].append(means)
                h[4].append(weights)
                h[5] += len(means)
                if h[5] > 20 * DELTA:
                    m, w = cluster(np.concatenate(h[3]), np.concatenate(h[4]))
                    h[3:] = [m], [w], len(m)
        out = []
        for key, (n, low, high, ms, ws, _) in held.items():
            m, w = cluster(np.concatenate(ms), np.concatenate(ws))
            out.append((*key, n, low, high, m, w))
        yield pd.DataFrame(out, columns=[*keys, "n", "low", "high", "means", "weights"])

    return digests.repartition(*[F.col(k) for k in keys]).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + DIGEST)


def day_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that can be combined: a digest per metric, language, decision, day and arrival (on time or late)."""
    keys = [*KEYS, "day", "arrival"]
    return merge_digests(partial_digests(samples(table(spark, sf_dir, "latency_sample")), keys), keys)


def certified(values: DataFrame, digests: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The digests with their percentiles and the rank error that the counting pass finds; the estimates, one row per group, are broadcast only if they are few."""
    names = [f"p{round(q * 100)}" for q in QUANTILES]
    types = {f.name: f.dataType.simpleString() for f in digests.schema.fields}

    def quantiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e = np.array([estimate(m, w, lo, hi) for m, w, lo, hi in zip(b["means"], b["weights"], b["low"], b["high"])]).reshape(-1, len(names))
            yield b.assign(**{x: e[:, i] for i, x in enumerate(names)})

    est = written(digests.mapInPandas(quantiles, ", ".join(f"`{k}` {types[k]}" for k in digests.columns) + ", " + ", ".join(f"{x} double" for x in names)), "p5-estimates")
    few = est.count() <= 50_000
    side = est.select(*[F.col(k).alias("e_" + k) for k in keys], *names)
    on = [F.col(k).eqNullSafe(F.col("e_" + k)) for k in keys]
    met = values.join(F.broadcast(side) if few else side, on)
    counts = met.groupBy(*keys).agg(*[F.count_if(F.col("value") < F.col(x)).alias("b_" + x) for x in names], *[F.count_if(F.col("value") <= F.col(x)).alias("u_" + x) for x in names])
    counts = counts.select(*[F.col(k).alias("e_" + k) for k in keys], *["b_" + x for x in names], *["u_" + x for x in names])
    out = est.join(counts, on)
    err = [F.greatest(F.lit(0.0), F.col("b_" + x) - F.col("n") * q, F.col("n") * q - F.col("u_" + x)) / F.col("n") for x, q in zip(names, QUANTILES)]
    out = out.withColumn("rank_error", F.greatest(*err))
    return out.select(*keys, "n", *names, "rank_error", F.lit(BOUND).alias("rank_error_bound"), (F.col("rank_error") <= BOUND).alias("within_bound"), "low", "high", "means", "weights")


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p50, p90, p95 and p99 of total_backend_ms and stages_ms.rerank per language and decision: of all samples (grain all), per arrival class and per day and arrival class.

    The digests of the finer grains are the form in which results combine: those of the coarser grains are merged from them. Each row is certified against the values themselves.
    """
    values = written(samples(table(spark, sf_dir, "latency_sample")), "p5-samples")
    leaf = written(merge_digests(partial_digests(values, [*KEYS, "day", "arrival"]), [*KEYS, "day", "arrival"]), "p5-days")
    arrival = written(merge_digests(leaf, [*KEYS, "arrival"]), "p5-arrival")
    none = {"day": F.lit(None).cast("date"), "arrival": F.lit(None).cast("string")}
    parts = []
    for grain, keys, digests in (("day and arrival", [*KEYS, "day", "arrival"], leaf), ("arrival", [*KEYS, "arrival"], arrival), ("all", KEYS, merge_digests(arrival, KEYS))):
        c = certified(values, digests, keys)
        parts.append(c.select(F.lit(grain).alias("grain"), *KEYS, *[F.col(k) if k in keys else none[k].alias(k) for k in ("day", "arrival")], *[x for x in c.columns if x not in keys]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per metric, language, decision and arrival, with their extremes (exact)."""
    return samples(table(spark, sf_dir, "latency_sample")).groupBy("metric", "language", "decision", "arrival").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
