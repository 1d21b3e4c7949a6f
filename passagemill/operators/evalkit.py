"""Retrieval and answer quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(test: Column, among: Column) -> Column:
    """Share of the rows among which the test holds; 0 where there are none."""
    return F.round(F.count_if(test & among) / F.greatest(F.count_if(among), F.lit(1)), 4)


def recall_and_mrr(ranked: DataFrame, rank: str = "best_rank", ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall at each k and the mean reciprocal rank; a null rank counts as not found."""
    n = F.greatest(F.count("*"), F.lit(1))
    return ranked.agg(F.count("*").alias("examples"), *[F.round(F.count_if(F.col(rank) <= k) / n, 4).alias(f"recall_at_{k}") for k in ks], F.round(F.coalesce(F.sum(1.0 / F.col(rank)), F.lit(0.0)) / n, 4).alias("mrr"))


def reliability(results: DataFrame) -> DataFrame:
    """False refusals among answerable, false confidence among unanswerable examples. Rows with an error don't count."""
    r = results.filter("error is null")
    a, g = F.col("is_answerable"), F.col("grounded")
    return r.agg(F.count_if(a).alias("answerable"), F.count_if(~a).alias("unanswerable"), _rate(~g, a).alias("false_refusal_rate"), _rate(g, ~a).alias("false_confidence_rate"))


def faithfulness(judged: DataFrame) -> DataFrame:
    """Rates of a judge's verdicts, and how often a confident answer is upheld."""
    v, g = F.col("verdict"), F.col("grounded")
    n = F.greatest(F.count("*"), F.lit(1))
    return judged.agg(F.count("*").alias("evaluated"), F.round(F.count_if(v) / n, 4).alias("faithful_rate"), F.round(F.count_if(~v) / n, 4).alias("hallucination_rate"), F.count_if(g).alias("confident"), F.round(1 - F.count_if(g & ~v) / F.greatest(F.count_if(g), F.lit(1)), 4).alias("self_report_precision"))


def correctness(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("evaluated"), F.round(F.count_if("verdict") / F.greatest(F.count("*"), F.lit(1)), 4).alias("correct_rate"))


def offline_gold_rank(scored: DataFrame, query: str, score: str, is_gold: str, tie: list[str]) -> DataFrame:
    """The best rank of a gold chunk per query; at equal scores gold comes first."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.desc(F.col(is_gold).cast("int")), *tie)
    return scored.withColumn("rank", F.row_number().over(w)).groupBy(query).agg(F.min(F.when(F.col(is_gold), F.col("rank"))).alias("gold_rank"))


def contamination(hits: DataFrame, results: DataFrame, query: str) -> DataFrame:
    """Of false confidences: whether the best-scored hit is the query's own passage, another's, or there is none. hits: query, hit_query, score, tie."""
    best = hits.groupBy(query).agg(F.max_by("hit_query", F.struct(F.col("score"), -F.col("tie"))).alias("hit_query"))
    bad = results.filter("error is null and not is_answerable and grounded").select(query)
    kind = F.when(F.col("hit_query").isNull(), "no_hits").when(F.col("hit_query") == F.col(query), "same_query").otherwise("cross_query")
    return bad.join(best, query, "left").groupBy(kind.alias("source")).agg(F.count("*").alias("n"))


def document_frequency(docs: DataFrame, text: str, tokens: Column) -> DataFrame:
    """term, df over distinct texts."""
    return docs.select(text).distinct().select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf_weighted_overlap(pairs: DataFrame, key: str, query_tokens: str, answer_tokens: str, df: DataFrame, n: Column) -> DataFrame:
    """key, overlap: the share of the query's inverse document frequency that the answer has; 1 where the query has no words or no weight. An unseen term counts with frequency 0."""
    q = pairs.select(key, F.explode(query_tokens).alias("term"), F.col(answer_tokens).alias("_a"))
    w = q.join(df, "term", "left").select(key, F.log(n / (1 + F.coalesce("df", F.lit(0)))).alias("idf"), F.array_contains("_a", F.col("term")).alias("hit"))
    s = w.groupBy(key).agg(F.sum("idf").alias("total"), F.sum(F.when(F.col("hit"), F.col("idf")).otherwise(0.0)).alias("part"))
    return pairs.select(key).join(s, key, "left").select(key, F.round(F.when(F.col("total") > 0, F.col("part") / F.col("total")).otherwise(1.0), 6).alias("overlap"))
