"""Answer extraction from retrieved passages and the decision of each request."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.guards import check_input, guard_decision, verify_grounding
from ..functions.plugins import rerank


@dataclass(frozen=True)
class Thresholds:
    """Operating points; they belong to a reranker's scale."""

    passages: int = 3
    least_lexical: float = 0.1
    least_score: float = -2.0
    sentences: int = 6
    short_answer: int = 35
    support: float = 0.45
    overlap: float = 0.25
    citation_chars: int = 200


Scorer = Callable[[Column, Column], Column]


def extract_answers(hits: DataFrame, query: str, question: str, passage: str, rank: str, scorer: Scorer = rerank, th: Thresholds = Thresholds()) -> DataFrame:
    """query, answer, score: of each query's first passages in rank order the first that passes the lexical filter and scores at least the floor, and of its sentences the best-scored; earlier ones win ties.

    Queries without such a passage give no row. If every sentence is junk the whole passage answers. A short answer takes the following sentence along.
    """
    q = T.content_tokens(F.col(question))
    c = hits.filter(F.col(rank) <= th.passages).select(F.col(query), F.col(question).alias("_q"), F.col(passage).alias("_p"), F.col(rank).alias("_r"), q.alias("_qt"))
    c = c.filter((F.coalesce("_p", F.lit("")) != "") & ~T.is_navigation_junk(F.col("_p")) & (T.overlap_ratio(F.col("_qt"), T.content_tokens(F.col("_p"))) >= th.least_lexical))
    gated = c.withColumn("_s", scorer(F.col("_q"), F.col("_p"))).filter(F.col("_s") >= th.least_score)
    first = gated.groupBy(query).agg(F.min_by(F.struct("_q", "_p", "_qt", "_s"), "_r").alias("x")).select(query, "x.*")
    parts = first.withColumn("_all", T.sentences_first(F.col("_p"), th.sentences))
    s = parts.select(query, "_q", "_qt", F.posexplode("_all").alias("_i", "_t"))
    s = s.filter(~T.is_question_echo(F.col("_t"), F.col("_qt")) & ~T.is_pointer_sentence(F.col("_t")) & ~T.is_truncated_fragment(F.col("_t")) & ~T.is_enumerator_stub(F.col("_t")))
    s = s.withColumn("_v", scorer(F.col("_q"), F.col("_t")))
    best = s.groupBy(query).agg(F.min_by(F.struct("_t", "_i"), F.struct(-F.col("_v"), F.col("_i"))).alias("_best"))
    x = parts.join(best, query, "left").withColumn("_a", F.coalesce("_best._t", "_p"))
    return x.select(query, finalized(F.col("_a"), F.col("_all"), th).alias("answer"), F.col("_s").alias("score"))


def finalized(answer: Column, sentences: Column, th: Thresholds = Thresholds()) -> Column:
    """The answer with a full stop at its end; a short one takes the sentence after its first place among sentences along. Null gives null."""
    at = F.array_position(sentences, answer)
    following = F.get(sentences, at.cast("int"))
    long = F.when((F.length(answer) < th.short_answer) & (F.size(sentences) > 1) & (at > 0) & following.isNotNull(), F.concat(answer, F.lit(". "), following)).otherwise(answer)
    return F.when(long.endswith("."), long).otherwise(F.concat(long, F.lit(".")))


def decide(requests: DataFrame, hits: DataFrame, answers: DataFrame, query: str, question: str, passage: str, rank: str, index_ready: bool = True, th: Thresholds = Thresholds()) -> DataFrame:
    """One response per request: decision, reason_code, answer, confidence, citations."""
    guard = check_input(F.col(question))
    r = requests.select(F.col(query), F.col(question), guard.alias("guard"))
    evidence = hits.filter(F.col(rank) <= th.passages).groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col("key").alias("key"), F.col(passage).alias("text")))).alias("_e"))
    x = r.join(answers.select(query, "answer"), query, "left").join(evidence, query, "left")
    g = verify_grounding(F.col(question), F.col("answer"), F.transform("_e", lambda e: e["text"]), th.support, th.overlap)
    x = x.withColumn("_g", F.when(F.col("answer").isNotNull(), g))
    reason = (
        F.when(F.col("guard") != "allowed", F.col("guard")).when(F.lit(not index_ready), "index_unavailable").when(F.col("answer").isNull(), "weak_retrieval")
        .when(~F.col("_g.grounded"), "ungrounded").otherwise("answered")
    )
    x = x.withColumn("reason_code", reason)
    decision = F.coalesce(guard_decision(F.col("guard")), F.when(F.col("reason_code") == "index_unavailable", "error").when(F.col("reason_code") == "answered", "allow").otherwise("abstain"))
    cited = F.when(F.col("reason_code") == "answered", F.transform("_e", lambda e: F.struct(e["rank"].alias("rank"), e["key"].alias("key"), F.substring(e["text"], 1, th.citation_chars).alias("text"))))
    return x.select(query, decision.alias("decision"), "reason_code", F.when(F.col("reason_code") == "answered", F.col("answer")).alias("answer"), F.when(F.col("reason_code").isin("answered", "ungrounded"), F.col("_g.confidence")).otherwise(0.0).alias("confidence"), cited.alias("citations"))


def refusal_reason(hits_n: Column, survivors: Column, best: Column, answer: Column, question: Column, support: Column, overlap: Column, th: Thresholds = Thresholds()) -> Column:
    """The first gate at which a request fails, or accepted."""
    from ..functions.guards import answer_type_mismatch

    junk = T.is_enumerator_stub(answer) | T.is_truncated_fragment(answer) | T.is_navigation_junk(answer)
    return (
        F.when(hits_n == 0, "no_hits").when(survivors == 0, "extract_lexical_prefilter").when(best < th.least_score, "extract_reranker_floor").when(junk, "verify_junk")
        .when(answer_type_mismatch(question, answer), "verify_type").when(support < th.support, "verify_support").when(overlap < th.overlap, "verify_overlap").otherwise("accepted")
    )
