"""The question-answering program over a corpus table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import detect_language, language_filter
from ..functions.plugins import embed_queries, embedding
from ..functions.text import normalize_text
from ..operators import answer as A
from ..operators.dedup import first_wins
from ..operators.retrieve import DOC_BLOCK, bm25_search, dense_search, fuse_ranks
from ..session import table, written

TOP_K = 20


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """key, shard, text, vector of the training passages: normalized, the first of each text per language, one chunk each. English shares the hi group."""
    o = table(spark, d, "passage_occurrence").filter("origin = 'passage'").select("occurrence_id", "config_language", "is_original_english", normalize_text(F.col("raw_text")).alias("text"))
    o = o.filter(F.length("text") >= 10).withColumn("content_hash", F.sha2("text", 256)).withColumn("shard", F.when(F.col("is_original_english"), "hi").otherwise(F.col("config_language")))
    one = first_wins(o.select("shard", "content_hash", "occurrence_id", "text"), ["shard", "content_hash"], ["occurrence_id"])
    return one.select(F.col("occurrence_id").alias("key"), "shard", "text", embedding(F.col("text"), prefix="passage: ").alias("vector"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """query_id, question of the evaluation examples, in English."""
    return table(spark, d, "eval_example").groupBy("query_id").agg(F.min("query_en").alias("question"))


def dense_within(corpus_: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """query_id, shard, key, score, rank of the k nearest passages of each routed shard. Which question goes where is small: a block's routes are as many as its questions times the shards."""
    probes: dict[str, list[int]] = {}
    for r in routed.select("query_id", "shard").distinct().toLocalIterator():
        probes.setdefault(r.shard, []).append(r.query_id)
    rows = corpus_.filter(F.col("shard").isin(list(probes))).select("key", "vector", F.col("shard").alias("cell"))
    blocks = rows.groupBy("cell").agg(F.ceil(F.count("*") / DOC_BLOCK).alias("_n"))  # a task ranks whole blocks, so each gives k rows a question however many files there are
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(F.broadcast(blocks), "cell").repartition(many, "cell", F.pmod(F.xxhash64("key"), "_n")).drop("_n")
    q = routed.select("query_id", "vector").dropDuplicates(["query_id"])
    return dense_search(rows, q, "key", "vector", k, rows, probes, "query_id", per_cell=True).withColumnRenamed("cell", "shard")


def hybrid_search(corpus_: DataFrame, requests: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """query_id, shard, key, score, rank: BM25 and dense ranks of the shards that a question is routed to, fused."""
    candidate_k = max(3 * top_k, 30)
    groups = language_filter(detect_language(F.col("question")), F.lit(None).cast("string"))
    q = embed_queries(requests, "question").withColumn("shard", F.explode(groups))
    routed = written(q.select("query_id", "shard", "question", "vector"), "routes")
    lexical = bm25_search(corpus_, requests, "key", "shard", "text", "query_id", "question", candidate_k, within=routed.select("query_id", "shard"))
    return fuse_ranks(lexical, dense_within(corpus_, routed, candidate_k), "query_id", top_k)


def answer_questions(corpus_: DataFrame, requests: DataFrame, th: A.Thresholds = A.Thresholds()) -> DataFrame:
    """One response per request. Payloads are fetched for the winners only."""
    hits = hybrid_search(corpus_, requests).join(corpus_.select("shard", "key", "text"), ["shard", "key"]).join(requests, "query_id")
    hits = written(hits.select("query_id", "question", "key", "text", "rank", "score"), "hits")
    answers = A.extract_answers(hits, "query_id", "question", "text", "rank", th=th)
    return A.decide(requests, hits, answers, "query_id", "question", "text", "rank", th=th)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return answer_questions(written(corpus(spark, d), "corpus"), questions(spark, d))


def system_info(spark: SparkSession) -> DataFrame:
    """Language sets and readiness as one row."""
    from ..functions.language import INDEXED, PILOT, SUPPORTED

    return spark.range(1).select(F.array(*[F.lit(x) for x in SUPPORTED]).alias("supported"), F.array(*[F.lit(x) for x in INDEXED]).alias("indexed"), F.array(*[F.lit(x) for x in PILOT]).alias("pilot"), F.array_except(F.array(*[F.lit(x) for x in SUPPORTED]), F.array(*[F.lit(x) for x in INDEXED])).alias("not_indexed"), F.lit(True).alias("ready"))
