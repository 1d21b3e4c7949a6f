"""First-occurrence-wins deduplication, the persistent seen set, and dense numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order. Partial minima are taken before the shuffle, so a key with very many rows is no group in one task."""
    cols = df.columns
    packed = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in cols if c not in keys and c not in order])).alias("_first"))
    return packed.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in cols])


def not_seen(batch: DataFrame, seen: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a batch whose content_hash is neither in the seen set nor earlier in the batch. Null hashes are never seen before and stay."""
    known = batch.filter("content_hash is not null").join(seen.select("content_hash").distinct(), "content_hash", "left_anti")
    return first_wins(known.select(*batch.columns), ["content_hash"], order).unionByName(batch.filter("content_hash is null"))


def dense_keys(df: DataFrame, order: list[str], name: str = "key") -> DataFrame:
    """Numbers 0..n-1 in a total order, without a sort in one task: range partitions are numbered inside, and offsets are sums of their sizes."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = written(ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "dense")
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    offsets = sizes.withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def merge_segments(passages: DataFrame, segment_order: str, key: str) -> DataFrame:
    """Passages of many segments as one: the first of each (language, content_hash) in segment order, with new dense keys."""
    one = first_wins(passages, ["language", "content_hash"], [segment_order, key])
    return dense_keys(one, [segment_order, key], "new_key")


def duplicate_counters(chunks: DataFrame, group: list[str]) -> DataFrame:
    """Chunks, repeated ids and repeated texts."""
    return chunks.groupBy(*group).agg(F.count("*").alias("chunks"), (F.count("*") - F.count_distinct("chunk_id")).alias("duplicate_ids"), (F.count("*") - F.count_distinct("text_hash")).alias("duplicate_texts"))
