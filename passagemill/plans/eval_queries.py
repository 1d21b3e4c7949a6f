"""Queries of evaluation, calibration and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import text as T
from ..functions.plugins import judged
from ..operators import answer as A
from ..operators import calibrate as K
from ..operators import evalkit as E
from ..operators import latency as L
from ..operators import parse as P
from ..session import table
from . import sql as S
from .text_queries import EXAMPLES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# ---- scored candidates of each example; examples delivered twice are one
def scored(s, d) -> DataFrame:
    """query_id, is_answerable, lang, i, score, is_gold, text of every candidate in both languages."""
    e = table(s, d, "eval_example").dropDuplicates(["query_id"])
    side = lambda lang: e.select("query_id", "is_answerable", "gt_passage_index", F.lit(lang).alias("lang"), F.col(f"query_{lang}").alias("q"), F.posexplode(f"candidates_{lang}").alias("i", "text"))
    x = side("en").unionByName(side("hi"))
    return x.select("query_id", "is_answerable", "lang", "i", F.round(T.token_overlap_score(F.col("q"), F.col("text")), 6).alias("score"), (F.coalesce("gt_passage_index", F.lit(-1)) == F.col("i")).alias("is_gold"), "q", "text")


def _side(lang):
    return f"SELECT query_id, is_answerable, '{lang}' AS lang, i - 1 AS i, query_{lang} AS q, candidates_{lang}[i] AS text, coalesce(gt_passage_index, -1) = i - 1 AS is_gold FROM {EXAMPLES}, LATERAL (SELECT unnest(generate_series(1, len(candidates_{lang}))) AS i)"


SCORED = f"(SELECT *, round({S.overlap_score('q', 'text')}, 6) AS score FROM ({_side('en')} UNION ALL {_side('hi')}))"


def gold_ranks(s, d) -> DataFrame:
    """query_id, is_answerable, best_rank: the better of the English and the Hindi rank."""
    x = scored(s, d).filter("is_answerable")
    w = Window.partitionBy("query_id", "lang").orderBy(F.desc("score"), F.desc(F.col("is_gold").cast("int")), "i")
    r = x.withColumn("rank", F.row_number().over(w)).groupBy("query_id").agg(F.min(F.when(F.col("is_gold") & (F.col("rank") <= 5), F.col("rank"))).alias("best_rank"))
    return r


GOLD = f"(SELECT query_id, min(CASE WHEN is_gold AND r <= 5 THEN r END) AS best_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, is_gold DESC, i) AS r FROM {SCORED} WHERE is_answerable) GROUP BY 1)"
_rec = lambda k: f"round(count(*) FILTER (best_rank <= {k}) / greatest(count(*), 1), 4) AS recall_at_{k}"
add("agg03_recall_mrr", lambda s, d: E.recall_and_mrr(gold_ranks(s, d)), f"SELECT count(*) AS examples, {_rec(1)}, {_rec(3)}, {_rec(5)}, round(coalesce(sum(1.0 / best_rank), 0) / greatest(count(*), 1), 4) AS mrr FROM {GOLD}")
add("ret15_offline_gold_rank", lambda s, d: E.offline_gold_rank(scored(s, d).filter("lang = 'en' and is_answerable"), "query_id", "score", "is_gold", ["i"]), f"SELECT query_id, CAST(min(CASE WHEN is_gold THEN r END) AS INT) AS gold_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, is_gold DESC, i) AS r FROM {SCORED} WHERE lang = 'en' AND is_answerable) GROUP BY 1")


def results(s, d) -> DataFrame:
    """query_id, is_answerable, top1, second, grounded, verdict, error: an evaluation run with the overlap score as the scorer."""
    x = scored(s, d).filter("lang = 'en'").groupBy("query_id", "is_answerable").agg(F.max("score").alias("top1"), F.round(F.avg("score"), 6).alias("second"))
    return x.withColumn("grounded", F.col("top1") >= 1.0).withColumn("verdict", F.col("query_id") % 4 != 0).withColumn("error", F.when(F.col("query_id") % 10 == 0, "timeout"))


RESULTS = f"(SELECT *, top1 >= 1.0 AS grounded, query_id % 4 <> 0 AS verdict, CASE WHEN query_id % 10 = 0 THEN 'timeout' END AS error FROM (SELECT query_id, is_answerable, max(score) AS top1, round(avg(score), 6) AS second FROM {SCORED} WHERE lang = 'en' GROUP BY 1, 2))"
_rate = lambda t, a: f"round(count(*) FILTER ({t} AND {a}) / greatest(count(*) FILTER ({a}), 1), 4)"
add("agg04_reliability", lambda s, d: E.reliability(results(s, d)), f"SELECT count(*) FILTER (is_answerable) AS answerable, count(*) FILTER (NOT is_answerable) AS unanswerable, {_rate('NOT grounded', 'is_answerable')} AS false_refusal_rate, {_rate('grounded', 'NOT is_answerable')} AS false_confidence_rate FROM {RESULTS} WHERE error IS NULL")


def _contamination(s, d):
    hits = scored(s, d).select("query_id", F.when(F.col("i") % 3 == 0, F.col("query_id")).otherwise(F.col("query_id") + 1).alias("hit_query"), "score", (F.col("i") + F.when(F.col("lang") == "hi", 100).otherwise(0)).alias("tie"))
    return E.contamination(hits, results(s, d), "query_id")


add("agg19_contamination", _contamination, f"SELECT CASE WHEN h.hit_query IS NULL THEN 'no_hits' WHEN h.hit_query = r.query_id THEN 'same_query' ELSE 'cross_query' END AS source, count(*) AS n FROM (SELECT * FROM {RESULTS} WHERE error IS NULL AND NOT is_answerable AND grounded) r LEFT JOIN (SELECT query_id, hit_query FROM (SELECT query_id, CASE WHEN i % 3 = 0 THEN query_id ELSE query_id + 1 END AS hit_query, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i + CASE WHEN lang = 'hi' THEN 100 ELSE 0 END) AS k FROM {SCORED}) WHERE k = 1) h ON h.query_id = r.query_id GROUP BY 1")
_th = "(SELECT DISTINCT round(top1, 2) AS th FROM " + RESULTS + ")"
SWEEP = f"(SELECT th AS threshold, round(fr, 6) AS false_refusal, round(fc, 6) AS false_confidence, round(1 - fr - fc, 6) AS youden_j FROM (SELECT th, count(*) FILTER (is_answerable AND top1 < th) / greatest(count(*) FILTER (is_answerable), 1) AS fr, count(*) FILTER (NOT is_answerable AND top1 >= th) / greatest(count(*) FILTER (NOT is_answerable), 1) AS fc FROM {_th}, {RESULTS} GROUP BY 1))"
_sweep = lambda s, d: K.threshold_sweep(results(s, d), "top1", "is_answerable")
add("agg15_threshold_sweep", _sweep, f"SELECT * FROM {SWEEP}")
add("agg15_best_threshold", lambda s, d: K.best_threshold(_sweep(s, d)), f"SELECT * FROM {SWEEP} ORDER BY youden_j DESC, threshold LIMIT 1")
add("agg16_capped_minimum", lambda s, d: K.capped_minimum(_sweep(s, d)), f"SELECT * FROM {SWEEP} WHERE false_refusal <= 0.04 ORDER BY false_confidence, threshold LIMIT 1")
GRID = f"(SELECT a AS least_first, b AS least_second, round(1 - count(*) FILTER (is_answerable AND x >= a AND y >= b) / greatest(count(*) FILTER (is_answerable), 1), 6) AS false_refusal, round(count(*) FILTER (NOT is_answerable AND x >= a AND y >= b) / greatest(count(*) FILTER (NOT is_answerable), 1), 6) AS false_confidence FROM (SELECT DISTINCT round(top1, 1) AS a FROM {RESULTS}), (SELECT DISTINCT round(second, 1) AS b FROM {RESULTS}), (SELECT *, round(top1, 1) AS x, round(second, 1) AS y FROM {RESULTS}) GROUP BY 1, 2)"
_grid = lambda s, d: K.grid_sweep(results(s, d), "top1", "second", "is_answerable")
add("agg17_grid_sweep", _grid, f"SELECT * FROM {GRID}")
add("agg17_skyline", lambda s, d: K.skyline(_grid(s, d), "false_refusal", "false_confidence", ["least_first", "least_second"]), f"SELECT least_first, least_second, false_refusal, false_confidence FROM (SELECT *, min(false_confidence) OVER (ORDER BY false_refusal, false_confidence, least_first, least_second ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM {GRID}) WHERE low IS NULL OR false_confidence < low")
add("agg14_confusion", lambda s, d: K.confusion(results(s, d), F.col("top1") >= 0.8, "is_answerable"), f"SELECT count(*) FILTER (is_answerable AND top1 >= 0.8) AS tp, count(*) FILTER (is_answerable AND top1 < 0.8) AS fn, count(*) FILTER (NOT is_answerable AND top1 >= 0.8) AS fp, count(*) FILTER (NOT is_answerable AND top1 < 0.8) AS tn FROM {RESULTS}")
add("agg13_class_median", lambda s, d: results(s, d).groupBy("is_answerable").agg(F.round(F.avg("top1"), 6).alias("mean"), F.round(F.median("top1"), 6).alias("median")), f"SELECT is_answerable, round(avg(top1), 6) AS mean, round(median(top1), 6) AS median FROM {RESULTS} GROUP BY 1")
add("agg21_percent_declined", lambda s, d: K.percent_declined(results(s, d), "top1", [0.2, 0.6, 1.0, 1.4]), f"SELECT t AS threshold, round(count(*) FILTER (top1 < t) / greatest(count(top1), 1), 6) AS declined FROM {RESULTS}, (VALUES (0.2::DOUBLE), (0.6::DOUBLE), (1.0::DOUBLE), (1.4::DOUBLE)) v(t) GROUP BY 1")
add("win04_margin", lambda s, d: K.margins(scored(s, d).filter("lang = 'en'"), "query_id", "score"), f"SELECT query_id, list_extract(l, 1) AS top1, list_extract(l, 2) AS top2, round(list_extract(l, 1) - list_extract(l, 2), 6) AS margin FROM (SELECT query_id, list(score ORDER BY score DESC) AS l FROM {SCORED} WHERE lang = 'en' GROUP BY 1)")


# ---- answers: relevance and refusals
def _pairs(s, d) -> DataFrame:
    x = scored(s, d).filter("lang = 'en' and i = 0")
    return x.select("query_id", "is_answerable", "q", "text", F.element_at(T.sentences_first(F.col("text"), 1), 1).alias("a"))


_PAIR = f"(SELECT query_id, is_answerable, q, text, {S.first_sentences('text', 1)}[1] AS a FROM {SCORED} WHERE lang = 'en' AND i = 0)"


def _ov(q, a):
    return f"CASE WHEN len({S.ctoks(q)}) > 0 THEN {S.common(S.ctoks(q), S.ctoks(a))} / len({S.ctoks(q)}) ELSE 1.0 END"


add(
    "agg18_overlap_separation",
    lambda s, d: _pairs(s, d).select("is_answerable", G.query_overlap(F.col("q"), F.col("a")).alias("o")).select("is_answerable", F.explode(F.array(*[F.struct(F.lit(t / 10).alias("threshold"), (F.col("o") < t / 10).alias("cut")) for t in range(1, 10, 2)])).alias("x")).groupBy("x.threshold").agg(F.round(F.count_if(F.col("x.cut") & F.col("is_answerable")) / F.greatest(F.count_if("is_answerable"), F.lit(1)), 6).alias("reject_genuine"), F.round(F.count_if(F.col("x.cut") & ~F.col("is_answerable")) / F.greatest(F.count_if(~F.col("is_answerable")), F.lit(1)), 6).alias("reject_fabricated")),
    f"SELECT threshold, round(count(*) FILTER (o < threshold AND is_answerable) / greatest(count(*) FILTER (is_answerable), 1), 6) AS reject_genuine, round(count(*) FILTER (o < threshold AND NOT is_answerable) / greatest(count(*) FILTER (NOT is_answerable), 1), 6) AS reject_fabricated FROM (SELECT is_answerable, {_ov('q', 'a')} AS o FROM {_PAIR}), (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) v(threshold) GROUP BY 1",
)


def _waterfall(s, d):
    x = _pairs(s, d).withColumn("best", F.round(T.token_overlap_score(F.col("q"), F.col("text")) * 4 - 3, 6))
    survivors = (T.overlap_ratio(T.content_tokens(F.col("q")), T.content_tokens(F.col("text"))) >= 0.1).cast("int")
    r = A.refusal_reason(F.col("query_id") % 13, survivors, F.col("best"), F.col("a"), F.col("q"), G.support(F.col("a"), F.array("text")), G.query_overlap(F.col("q"), F.col("a")))
    return x.groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


_sup = f"CASE WHEN c <> '' AND contains(lower(text), c) THEN 1.0 ELSE {S.common(f'list_distinct({S.toks('c')})', S.toks('text'))} / greatest(len(list_distinct({S.toks('c')})), 1) END"
_b = S.strip("a")
_junk = f"{S.rx(_b, f':{T.WS}+(?:[0-9]{{1,2}}' + chr(92) + '.|[A-Za-z]' + chr(92) + f')){T.WS}*$')} OR {S.rx(_b, '^' + chr(92) + '(?[A-Za-z]' + chr(92) + '.?' + chr(92) + ')?$')} OR {S.rx('a', f'(?i)you are here{T.WS}*:')}"
_miss = f"CASE WHEN {S.rx('q', G.NUMERIC_QUESTION)} THEN NOT ({S.rx('a', G.DIGIT)} OR {S.rx('a', G.NUMBER_WORDS)}) WHEN {S.rx('q', G.TEMPORAL_QUESTION)} THEN NOT ({S.rx('a', G.DIGIT)} OR {S.rx('a', G.DATE_WORDS)}) ELSE false END"
add(
    "agg20_waterfall", _waterfall,
    f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN query_id % 13 = 0 THEN 'no_hits' WHEN {S.common(S.ctoks('q'), S.ctoks('text'))} / greatest(len({S.ctoks('q')}), 1) < 0.1 THEN 'extract_lexical_prefilter' WHEN round({S.overlap_score('q', 'text')} * 4 - 3, 6) < -2.0 THEN 'extract_reranker_floor' WHEN {_junk} THEN 'verify_junk' WHEN {_miss} THEN 'verify_type' WHEN {_sup} < 0.45 THEN 'verify_support' WHEN {_ov('q', 'a')} < 0.25 THEN 'verify_overlap' ELSE 'accepted' END AS reason FROM (SELECT *, lower({S.sub(S.strip('a'), '[.?!।॥]+$', '')}) AS c FROM {_PAIR})) GROUP BY 1",
)
add(
    "ans06_grounding", lambda s, d: _pairs(s, d).select("query_id", G.verify_grounding(F.col("q"), F.col("a"), F.array("text")).alias("g")).select("query_id", "g.grounded", F.round("g.confidence", 3).alias("confidence")),
    f"SELECT query_id, CASE WHEN bad THEN false ELSE s >= 0.45 AND o >= 0.25 END AS grounded, round(CASE WHEN bad THEN 0.0 ELSE round(least(s, o), 4) END, 3) AS confidence FROM (SELECT query_id, ({_junk} OR {_miss} OR c = '' OR a = '') AS bad, {_sup} AS s, {_ov('q', 'a')} AS o FROM (SELECT *, lower({S.sub(S.strip('a'), '[.?!।॥]+$', '')}) AS c FROM {_PAIR}))",
)


def _idf(s, d):
    p = _pairs(s, d).select("query_id", T.content_tokens(F.col("q")).alias("qt"), T.content_tokens(F.col("a")).alias("at"))
    texts = scored(s, d).filter("lang = 'en'").select("text")
    df = E.document_frequency(texts, "text", T.tokens(F.col("text")))
    n = texts.select("text").distinct().count()
    return E.idf_weighted_overlap(p, "query_id", "qt", "at", df, F.lit(float(n)))


_tx = f"(SELECT DISTINCT text FROM {SCORED} WHERE lang = 'en')"
add("agg12_document_frequency", lambda s, d: E.document_frequency(table(s, d, "documents").select("text"), "text", T.tokens(F.col("text"))), f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({S.toks('text')})) AS term FROM (SELECT DISTINCT text FROM documents)) GROUP BY 1")
add("txt26_idf_overlap", _idf, f"SELECT query_id, round(CASE WHEN total > 0 THEN part / total ELSE 1.0 END, 6) AS overlap FROM {_PAIR} LEFT JOIN (SELECT query_id, sum(idf) AS total, sum(CASE WHEN hit THEN idf ELSE 0 END) AS part FROM (SELECT query_id, ln((SELECT count(*) FROM {_tx}) / (1.0 + coalesce(df, 0))) AS idf, hit FROM (SELECT query_id, term, list_contains({S.ctoks('a')}, term) AS hit FROM {_PAIR}, LATERAL (SELECT unnest({S.ctoks('q')}) AS term)) LEFT JOIN (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({S.toks('text')})) AS term FROM {_tx}) GROUP BY 1) USING (term)) GROUP BY 1) USING (query_id)")


# ---- latency
def samples(s, d) -> DataFrame:
    """Distinct samples: a request delivered twice counts once."""
    x = table(s, d, "latency_sample").select("request_id", F.struct("language", "decision", "total_backend_ms", "stages_ms").alias("x"), F.struct("received_at", F.coalesce("total_backend_ms", F.lit(-1.0)), F.coalesce(F.col("stages_ms")["rerank"], F.lit(-1.0))).alias("o"))
    return x.groupBy("request_id").agg(F.min_by("x", "o").alias("x")).select("x.*")


SAMPLES = "(SELECT DISTINCT ON (request_id) request_id, language, decision, total_backend_ms, stages_ms FROM latency_sample ORDER BY request_id, received_at, coalesce(total_backend_ms, -1), coalesce(stages_ms['rerank'], -1))"
add("agg01_count_by_language", lambda s, d: samples(s, d).groupBy("language").agg(F.count("*").alias("n")), f"SELECT language, count(*) AS n FROM {SAMPLES} GROUP BY 1")
add("agg02_decisions", lambda s, d: samples(s, d).groupBy(F.coalesce("decision", F.lit("error")).alias("decision")).agg(F.count("*").alias("n")), f"SELECT coalesce(decision, 'error') AS decision, count(*) AS n FROM {SAMPLES} GROUP BY 1")
_lin = lambda p: f"round(quantile_cont(total_backend_ms, {p}), 2)"
add("agg07_linear_percentiles", lambda s, d: L.linear(samples(s, d), ["language", "decision"], "total_backend_ms", budget=500.0).select("language", "decision", "n", F.round("avg", 1).alias("avg"), *[F.round(f"p{p}", 1).alias(f"p{p}") for p in (50, 95, 99)], "within_budget"), f"SELECT language, decision, count(total_backend_ms) AS n, round(round(avg(total_backend_ms), 2), 1) AS avg, round({_lin(0.5)}, 1) AS p50, round({_lin(0.95)}, 1) AS p95, round({_lin(0.99)}, 1) AS p99, {_lin(0.95)} <= 500.0 AS within_budget FROM {SAMPLES} WHERE total_backend_ms IS NOT NULL GROUP BY 1, 2")


def _near(g, v):
    at = lambda p: f"l[least(CAST(floor({p}::DOUBLE / 100 * len(l)) AS BIGINT), len(l) - 1) + 1]"
    return f"SELECT {g}, len(l) AS count, {at(50)} AS p50, {at(70)} AS p70, {at(95)} AS p95, {at(99)} AS p99, l[len(l)] AS p100, round(m, 2) AS mean FROM (SELECT {g}, list({v} ORDER BY {v}) AS l, avg({v}) AS m"


add("agg08_nearest_rank", lambda s, d: L.nearest_rank(samples(s, d), ["language"], "total_backend_ms").withColumn("mean", F.round("mean", 2)), _near("language", "total_backend_ms") + f" FROM {SAMPLES} WHERE total_backend_ms IS NOT NULL GROUP BY 1)")
add("agg10_stage_percentiles", lambda s, d: L.nearest_rank(samples(s, d).select(F.explode("stages_ms").alias("stage", "ms")), ["stage"], "ms").withColumn("mean", F.round("mean", 2)), _near("stage", "ms") + f" FROM (SELECT e.key AS stage, e.value AS ms FROM (SELECT unnest(map_entries(stages_ms)) AS e FROM {SAMPLES})) WHERE ms IS NOT NULL GROUP BY 1)")


def _ablation(s, d):
    """Chunks per strategy of the chunk table with their sizes, repeats and storage."""
    c = table(s, d, "chunk").withColumn("tokens", T.approximate_token_count(F.col("text"))).withColumn("h", F.sha2("text", 256))
    base = c.groupBy("chunk_strategy").agg(F.count_distinct("parent_passage_id").alias("passages"), F.count("*").alias("chunks"), F.count_if(F.col("tokens") > 507).alias("rejected"), (F.count("*") - F.count_distinct("h")).alias("duplicate_texts"), F.round(F.avg("tokens"), 1).alias("token_mean"), F.max("tokens").alias("token_p100"), (F.count("*") * 4096).alias("storage_bytes"))
    x = L.order_statistics(c.withColumn("tokens", F.col("tokens").cast("double")), ["chunk_strategy"], "tokens", {f"token_p{p}": F.floor(F.col("n") * p / 100) for p in (50, 70, 95)})
    return base.withColumn("expansion", F.round(F.col("chunks") / F.greatest("passages", F.lit(1)), 3)).join(x.drop("n"), "chunk_strategy")


_tk = f"(len({S.toks('text')}) + 2)"
_q = lambda p: f"CAST(list(k ORDER BY k)[CAST(floor(count(*) * {p} / 100) AS BIGINT) + 1] AS DOUBLE) AS token_p{p}"
add("agg11_chunk_ablation", _ablation, f"SELECT chunk_strategy, count(DISTINCT parent_passage_id) AS passages, count(*) AS chunks, count(*) FILTER (k > 507) AS rejected, count(*) - count(DISTINCT sha256(text)) AS duplicate_texts, round(avg(k), 1) AS token_mean, max(k) AS token_p100, count(*) * 4096 AS storage_bytes, round(count(*) / greatest(count(DISTINCT parent_passage_id), 1), 3) AS expansion, {_q(50)}, {_q(70)}, {_q(95)} FROM (SELECT *, {_tk} AS k FROM chunk) GROUP BY 1")
add("agg22_answer_relevance", lambda s, d: _pairs(s, d).select("is_answerable", F.round(T.token_overlap_score(F.col("q"), F.col("a")) * 4 - 3, 6).alias("r")).agg(*[F.count_if((F.col("r") >= t) & F.col("is_answerable")).alias(f"kept_genuine_{i}") for i, t in enumerate((-1.7, -1.0, -0.4))], *[F.count_if((F.col("r") >= t) & ~F.col("is_answerable")).alias(f"kept_fabricated_{i}") for i, t in enumerate((-1.7, -1.0, -0.4))]), "SELECT " + ", ".join(f"count(*) FILTER (r >= {t} AND {a}is_answerable) AS kept_{n}_{i}" for a, n in (("", "genuine"), ("NOT ", "fabricated")) for i, t in enumerate((-1.7, -1.0, -0.4))) + f" FROM (SELECT is_answerable, round({S.overlap_score('q', 'a')} * 4 - 3, 6) AS r FROM {_PAIR})")

# ---- projections, samples and adapters
_KNOWN = ["input_guard", "language_detect", "query_embed", "local_hybrid_retrieve", "rerank", "answer_extract", "grounding_verify"]
add(
    "prj02_known_timings",
    lambda s, d: samples(s, d).select("language", F.size(F.map_filter("stages_ms", lambda k, v: k.isin(*_KNOWN[:4]))).alias("k")).groupBy("language").agg(F.sum("k").alias("known"), F.count("*").alias("n")),
    f"SELECT language, sum(len(list_filter(map_keys(stages_ms), lambda k: list_contains([{', '.join(S.q(k) for k in _KNOWN[:4])}], k)))) AS known, count(*) AS n FROM {SAMPLES} GROUP BY 1",
)
add("agg09_floor_index", lambda s, d: L.order_statistics(samples(s, d), ["decision"], "total_backend_ms", {f"p{p}": F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) for p in (50, 90)}), f"SELECT decision, len(l) AS n, l[least(CAST(floor(len(l) * 50 / 100) AS BIGINT), len(l) - 1) + 1] AS p50, l[least(CAST(floor(len(l) * 90 / 100) AS BIGINT), len(l) - 1) + 1] AS p90 FROM (SELECT decision, list(total_backend_ms ORDER BY total_backend_ms) AS l FROM {SAMPLES} WHERE total_backend_ms IS NOT NULL GROUP BY 1)")
add("jon10_gold_and_distractors", lambda s, d: (lambda x: x.filter("is_gold").select("query_id", F.col("score").alias("gold_score")).join(x.filter("not is_gold").select("query_id", "score"), "query_id").groupBy("query_id").agg(F.count("*").alias("distractors"), F.count_if(F.col("score") > F.col("gold_score")).alias("better")))(scored(s, d).filter("lang = 'en'")), f"SELECT g.query_id, count(*) AS distractors, count(*) FILTER (x.score > g.score) AS better FROM (SELECT * FROM {SCORED} WHERE lang = 'en' AND is_gold) g JOIN (SELECT * FROM {SCORED} WHERE lang = 'en' AND NOT is_gold) x ON x.query_id = g.query_id GROUP BY 1")
add("srt03_worst_answerable", lambda s, d: results(s, d).filter("is_answerable").orderBy("top1", "query_id").limit(5).select("query_id", "top1"), f"SELECT query_id, top1 FROM {RESULTS} WHERE is_answerable ORDER BY top1, query_id LIMIT 5")


def _resumed(s, d):
    """What an ingest still has to read of each configuration after the last row that the first batch committed."""
    o = table(s, d, "passage_occurrence").select("config_language", "source_row", "batch_no")
    done = o.filter("batch_no = 0").groupBy("config_language").agg(F.max("source_row").alias("last_row"))
    left = o.join(done, "config_language", "left").filter(F.col("last_row").isNull() | (F.col("source_row") > F.col("last_row")))
    return left.groupBy("config_language").agg(F.count("*").alias("n"), F.min("source_row").alias("next_row"))


add("flt06_resume_position", _resumed, "SELECT config_language, count(*) AS n, min(source_row) AS next_row FROM passage_occurrence LEFT JOIN (SELECT config_language, max(source_row) AS last_row FROM passage_occurrence WHERE batch_no = 0 GROUP BY 1) USING (config_language) WHERE last_row IS NULL OR source_row > last_row GROUP BY 1")


def _judged(s, d, against: str) -> DataFrame:
    """Results with a judge's verdict on the answer: its faithfulness to the passage (text), or its agreement with the reference answer (ref), which only answerable examples have."""
    ref = table(s, d, "eval_example").dropDuplicates(["query_id"]).select("query_id", F.col("gt_answer_en").alias("ref"))
    v = _pairs(s, d).join(ref, "query_id").filter(F.col(against).isNotNull()).select("query_id", P.verdicts(judged(F.col("q"), F.col(against), F.col("a"))).alias("v"))
    return results(s, d).drop("verdict").join(v.select("query_id", F.col("v.verdict").alias("verdict")), "query_id")


def _judged_sql(against: str) -> str:
    words = f"list_distinct({S.toks('a')})"
    j = f"(SELECT query_id, {S.common(words, S.toks(against))} / greatest(len({words}), 1) >= 0.5 AS verdict FROM {_PAIR} JOIN (SELECT query_id, gt_answer_en AS ref FROM {EXAMPLES}) USING (query_id) WHERE {against} IS NOT NULL)"
    return f"(SELECT r.* EXCLUDE (verdict), j.verdict FROM {RESULTS} r JOIN {j} j USING (query_id))"


add("agg05_faithful", lambda s, d: E.faithfulness(_judged(s, d, "text")), f"SELECT count(*) AS evaluated, round(count(*) FILTER (verdict) / greatest(count(*), 1), 4) AS faithful_rate, round(count(*) FILTER (NOT verdict) / greatest(count(*), 1), 4) AS hallucination_rate, count(*) FILTER (grounded) AS confident, round(1 - count(*) FILTER (grounded AND NOT verdict) / greatest(count(*) FILTER (grounded), 1), 4) AS self_report_precision FROM {_judged_sql("text")}")
add("agg06_correct", lambda s, d: E.correctness(_judged(s, d, "ref")), f"SELECT count(*) AS evaluated, round(count(*) FILTER (verdict) / greatest(count(*), 1), 4) AS correct_rate FROM {_judged_sql("ref")}")
