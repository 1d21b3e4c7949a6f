"""Sources and sinks: nested Parquet by configuration and split, segments, line files, discovery, resume accounting."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import exists

#: Three-letter file prefixes of the configurations.
PREFIXES = {"as": "asm", "bn": "ben", "gu": "guj", "hi": "hin", "kn": "kan", "ml": "mal", "mr": "mar", "ne": "nep", "or": "ori", "pa": "pan", "sa": "san", "ta": "tam", "te": "tel", "ur": "urd"}
#: Name of a segment directory: language, split, number.
SEGMENT = r"^([a-z]{2})_(train|validation)_segment_(\d+)$"


def file_name(config: str, split: str) -> str:
    """File of a configuration and split: the prefix with train or val."""
    if config not in PREFIXES:
        raise ValueError(f"unknown configuration {config!r}")
    return f"{split}/{PREFIXES[config]}{'train' if split == 'train' else 'val'}.parquet"


def config_of(shard: Column) -> Column:
    """The configuration that a shard's file name belongs to; null for other names."""
    pairs = [F.lit(x) for k, v in PREFIXES.items() for x in (v, k)]
    return F.create_map(*pairs)[F.regexp_extract(shard, r"([a-z]{3})(?:train|val)\.parquet$", 1)]


def read_nested(spark: SparkSession, root: str, config: str, split: str, limit: int | None = None, order: str = "query_id") -> DataFrame:
    """Rows of one file; a limit takes the first in a stated order."""
    df = spark.read.parquet(os.path.join(root, file_name(config, split)))
    return df if limit is None else df.orderBy(order).limit(limit)


def language_queries(rows: DataFrame, n: int) -> DataFrame:
    """Native and English questions, alternating, until n rows: half as many source rows."""
    two = F.array(F.struct(F.lit("native").alias("kind"), F.col("query").alias("text")), F.struct(F.lit("english").alias("kind"), F.col("Eng_Query").alias("text")))
    return rows.filter("query <> '' and Eng_Query <> ''").select("query_id", "query", "Eng_Query").orderBy("query_id").limit(n // 2).select("query_id", F.explode(two).alias("x")).select("query_id", "x.*")


def seeded_sample(rows: DataFrame, group: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group, in the order of a hash of seed and key, so any engine draws the same; ties go by key. Null groups are groups. Only the n first of a map task reach the window."""
    w = Window.partitionBy(*group).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def over_read_sample(rows: DataFrame, key: str, n: int, times: int = 5, seed: int = 42) -> DataFrame:
    """n rows out of the first n * times in key order, by a hash of seed and key."""
    return rows.orderBy(key).limit(n * times).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def discover(spark: SparkSession, root: str, expected: Iterable[str] = tuple(PREFIXES)) -> DataFrame:
    """config, splits, fields, missing: what is there of the expected configurations, read from footers only."""
    rows = []
    for c in expected:
        splits, fields = [], []
        for s in ("train", "validation"):
            path = os.path.join(root, file_name(c, s))
            if exists(spark, path):
                splits.append(s)
                fields = sorted(set(fields) | set(spark.read.parquet(path).schema.fieldNames()))
        rows.append((c, splits, fields, not splits))
    return spark.createDataFrame(rows, "config string, splits array<string>, fields array<string>, missing boolean")


def segments_in_order(names: DataFrame, name: str, most_per_language: int | None = None) -> DataFrame:
    """language, split, segment, position of directory names: training before validation, then by name; optionally the first few per language."""
    part = lambda i: F.regexp_extract(F.col(name), SEGMENT, i)
    x = names.filter(F.col(name).rlike(SEGMENT)).select(name, part(1).alias("language"), part(2).alias("split"), part(3).cast("int").alias("segment"))
    w = Window.partitionBy("language").orderBy((F.col("split") == "validation").cast("int"), name)
    x = x.withColumn("position", F.row_number().over(w))
    return x if most_per_language is None else x.filter(F.col("position") <= most_per_language)


def read_segments(spark: SparkSession, passages: str, tokens: str) -> DataFrame:
    """Line-aligned passages and tokens by (segment, key); raises if one side has rows that the other lacks."""
    p, t = spark.read.json(passages), spark.read.json(tokens)
    joined = p.join(t, ["segment", "key"], "full_outer")
    if not joined.filter("text is null or tokens is null").isEmpty():
        raise ValueError("passages and tokens are not aligned")
    return joined


def fetch(winners: DataFrame, passages: DataFrame, on: list[str]) -> DataFrame:
    """Payloads of the winning keys only: the narrow side is joined last."""
    return winners.join(passages, on)


def completed_rows(spark: SparkSession, manifests: str) -> int:
    """Passages in finished segments; manifests that can't be read count nothing."""
    return spark.read.schema("n_passages bigint, status string").json(manifests, mode="DROPMALFORMED").filter("status = 'complete'").agg(F.coalesce(F.sum("n_passages"), F.lit(0))).first()[0]


def write_segments(passages: DataFrame, path: str) -> None:
    """Partitioned by language, split and segment; the commit protocol makes each write whole or absent."""
    passages.write.mode("overwrite").partitionBy("lang", "split", "segment").parquet(path)


def cached_queries(spark: SparkSession, path: str, build) -> DataFrame:
    """The query set at path, built and written first if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.json(path)
    return spark.read.json(path)


def export_vectors(index: DataFrame, manifest_rows: int, key: str = "key") -> DataFrame:
    """Vectors in key order; raises if their number isn't the manifest's."""
    n = index.count()
    if n != manifest_rows:
        raise ValueError(f"{n} vectors, the manifest has {manifest_rows}")
    return index.orderBy(key)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def markdown(report: DataFrame, title: str) -> str:
    """A report of few rows as a Markdown table."""
    cols = report.columns
    lines = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in report.collect()]
    return "\n".join(lines) + "\n"
