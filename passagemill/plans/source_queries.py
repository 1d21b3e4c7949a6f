"""Queries of sources and sinks over files that they write themselves: nested Parquet, discovery, line files, manifests, exports, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_on_exit, scratch_dir, table
from ..sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Configurations written for discovery; the others are missing there.
WRITTEN = ("bn", "hi", "te")


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def folder(spark: SparkSession, name: str) -> str:
    """A folder of one query's own in the shared scratch folder; it goes when the application ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def source_tree(s: SparkSession, d: str) -> str:
    """The passages of some configurations as one file for each configuration and split that has rows."""
    root = folder(s, "tree")
    o = table(s, d, "passage_occurrence").select("occurrence_id", "config_language", "source_shard", "raw_text")
    for c in WRITTEN:
        for split in ("train", "validation"):
            part = o.filter((F.col("config_language") == c) & F.col("source_shard").startswith(split + "/"))
            if not part.isEmpty():
                part.write.parquet(f"{root}/{readers.file_name(c, split)}")
    return root


add(
    "src02_read_nested", lambda s, d: readers.read_nested(s, source_tree(s, d), "hi", "validation", 50, "occurrence_id").select("occurrence_id", F.sha2("raw_text", 256).alias("h")),
    "SELECT occurrence_id, sha256(raw_text) AS h FROM passage_occurrence WHERE config_language = 'hi' AND starts_with(source_shard, 'validation/') ORDER BY occurrence_id LIMIT 50",
)
_configs = ", ".join(f"('{c}')" for c in readers.PREFIXES)
add(
    "src06_discover", lambda s, d: readers.discover(s, source_tree(s, d)).select("config", F.array_join("splits", ",").alias("splits"), F.array_join("fields", ",").alias("fields"), "missing"),
    f"SELECT config, coalesce(splits, '') AS splits, CASE WHEN splits IS NULL THEN '' ELSE 'config_language,occurrence_id,raw_text,source_shard' END AS fields, splits IS NULL AS missing FROM (VALUES {_configs}) v(config) LEFT JOIN (SELECT config_language AS config, string_agg(DISTINCT split_part(source_shard, '/', 1), ',' ORDER BY split_part(source_shard, '/', 1)) AS splits FROM passage_occurrence WHERE config_language IN ('bn', 'hi', 'te') GROUP BY 1) USING (config)",
)


def _segments(s, d):
    root = folder(s, "segments")
    x = table(s, d, "documents").filter("text is not null").select((F.col("doc_id") % 7).alias("segment"), F.col("doc_id").alias("key"), "text")
    x.write.json(f"{root}/passages")
    x.select("segment", "key", F.split("text", " ").alias("tokens")).write.json(f"{root}/tokens")
    return readers.read_segments(s, f"{root}/passages", f"{root}/tokens").select("segment", "key", F.length("text").alias("chars"), F.size("tokens").alias("n_tokens"))


add("src07_aligned_segments", _segments, "SELECT doc_id % 7 AS segment, doc_id AS key, CAST(length(text) AS INT) AS chars, CAST(len(string_split(text, ' ')) AS INT) AS n_tokens FROM documents WHERE text IS NOT NULL")


def _export(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.size("embedding").alias("dim"))
    return readers.export_vectors(e, e.count())


add("src09_export_vectors", _export, "SELECT vec_id AS key, CAST(len(embedding) AS INT) AS dim FROM embeddings")


def _completed(s, d):
    """Passages in finished segments according to manifests, some of them unfinished and one file that is no JSON."""
    root = folder(s, "manifests")
    m = table(s, d, "documents").groupBy((F.col("doc_id") % 9).alias("segment")).agg(F.count("*").alias("n_passages")).withColumn("status", F.when(F.col("segment") % 3 == 0, "open").otherwise("complete"))
    m.write.json(f"{root}/m")
    s.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{root}/m")
    return s.createDataFrame([(readers.completed_rows(s, f"{root}/m"),)], "done bigint")


add("src10_completed_rows", _completed, "SELECT count(*) AS done FROM documents WHERE doc_id % 9 % 3 <> 0")


def _cached(s, d):
    """The second reading comes from the file: what would build it anew is never called."""
    path = f"{folder(s, 'queries')}/set"
    q = table(s, d, "eval_example").groupBy("query_id").agg(F.min("query_en").alias("text"))
    readers.cached_queries(s, path, lambda: q)
    return readers.cached_queries(s, path, lambda: q.limit(0)).select("query_id", "text")


add("src12_cached_queries", _cached, "SELECT query_id, min(query_en) AS text FROM eval_example GROUP BY 1")


def _written(s, d):
    path = f"{folder(s, 'written')}/passages"
    x = table(s, d, "documents").select("doc_id", F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"), F.lit("train").alias("split"), (F.col("doc_id") % 4).alias("segment"))
    readers.write_segments(x, path)
    return s.read.parquet(path).groupBy("lang", "split", F.col("segment").cast("bigint").alias("segment")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


add("snk01_write_segments", _written, "SELECT coalesce(lower(lang), 'und') AS lang, 'train' AS split, doc_id % 4 AS segment, count(*) AS n, sum(doc_id) AS ids FROM documents GROUP BY 1, 2, 3")


def _reported(s, d):
    path = f"{folder(s, 'report')}/r"
    readers.write_report(table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")), path)
    return s.read.schema("source string, n bigint").json(path)


add("snk03_report", _reported, "SELECT source, count(*) AS n FROM documents GROUP BY 1")
_ordered = "row_number() OVER (PARTITION BY {} ORDER BY sha256('42:' || CAST({} AS VARCHAR)), {}) AS r"
add(
    "set03_seeded_sample", lambda s, d: readers.seeded_sample(table(s, d, "documents").select("doc_id", F.lower("lang").alias("lang")), ["lang"], "doc_id", 5),
    f"SELECT doc_id, lang FROM (SELECT doc_id, lower(lang) AS lang, {_ordered.format('lower(lang)', 'doc_id', 'doc_id')} FROM documents) WHERE r <= 5",
)
add(
    "smp01_bucket_sample", lambda s, d: readers.seeded_sample(table(s, d, "eval_example").select("query_id", "is_answerable").distinct(), ["is_answerable"], "query_id", 50),
    f"SELECT query_id, is_answerable FROM (SELECT *, {_ordered.format('is_answerable', 'query_id', 'query_id')} FROM (SELECT DISTINCT query_id, is_answerable FROM eval_example)) WHERE r <= 50",
)
add(
    "smp02_over_read_sample", lambda s, d: readers.over_read_sample(table(s, d, "documents").select("doc_id"), "doc_id", 40),
    "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 200) ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40",
)
