"""Queries of retrieval, fusion, answers, segments and ingest."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.plugins import embedding
from ..operators import answer as A
from ..operators import retrieve as R
from ..session import scratch_dir, table, written
from ..sources import readers
from ..streaming import ingest
from . import pipeline
from . import sql as S
from .text_queries import EXAMPLES

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = 10


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _docs(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce(F.lower("lang"), F.lit("und")).alias("shard"), "text")


DOCS = "(SELECT doc_id AS key, coalesce(lower(lang), 'und') AS shard, text FROM documents)"
QS = "(SELECT query_id, min(query_en) AS question FROM eval_example GROUP BY 1)"
POST = f"(SELECT shard, key, len(t) AS dl, unnest(t) AS term FROM (SELECT shard, key, {S.toks('text')} AS t FROM {DOCS}))"
add("ret01_postings", lambda s, d: R.postings(_docs(s, d), "key", "shard", "text"), f"SELECT shard, key, CAST(dl AS INT) AS dl, term, count(*) AS tf FROM {POST} GROUP BY 1, 2, 3, 4")
BM25 = (
    f"(SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, key) AS rank FROM (SELECT query_id, p.shard, p.key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {R.K1} * (1 - {R.B} + {R.B} * dl / avgdl))), 6) AS score "
    f"FROM (SELECT DISTINCT query_id, unnest({S.toks('question')}) AS term FROM {QS}) q JOIN (SELECT shard, key, dl, term, count(*) AS tf FROM {POST} GROUP BY ALL) p USING (term) "
    f"JOIN (SELECT shard, term, count(DISTINCT key) AS df FROM {POST} GROUP BY 1, 2) f ON f.shard = p.shard AND f.term = p.term JOIN (SELECT shard, count(*) AS n, avg(len({S.toks('text')})) AS avgdl FROM {DOCS} GROUP BY 1) st ON st.shard = p.shard GROUP BY 1, 2, 3))"
)


def _bm25(s, d, k=K):
    return R.bm25_search(_docs(s, d), pipeline.questions(s, d), "key", "shard", "text", "query_id", "question", k)


def _four(c):
    """Four digits as the SQL rounds: the scaled number, not the shortest decimal."""
    return F.round(c * 1e4) / 1e4


add("ret02_bm25_topk", lambda s, d: _bm25(s, d).select("query_id", "shard", "key", _four(F.col("score")).alias("score"), "rank"), f"SELECT query_id, shard, key, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM {BM25} WHERE rank <= {K}")
add("ret02_bm25_padded", lambda s, d: R.bm25_search(_docs(s, d), pipeline.questions(s, d), "key", "shard", "text", "query_id", "question", K, pad_zero_scores=True))


def _dense(s, d):
    e = table(s, d, "embeddings")
    return R.dense_search(e.select("vec_id", "embedding"), e.filter("vec_id % 20 = 0").select("vec_id", "embedding"), "vec_id", "embedding", K).select("query_id", "key", F.round("score", 4).alias("score"), F.col("rank").cast("int").alias("rank"))


_dot = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_norm = lambda t: f"sqrt(list_dot_product(CAST({t}.embedding AS DOUBLE[]), CAST({t}.embedding AS DOUBLE[])))"
add("ret04_dense_topk", _dense, f"SELECT query_id, key, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS key, round({_dot} / ({_norm('a')} * {_norm('b')}), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= {K}")


def _cells(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return R.CellIndex(e, "vec_id", "embedding").search(e.filter("vec_id % 20 = 0"), K)


add("ret03_cell_index_topk", _cells)


def _two_lists(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("shard"), F.col("event_id").alias("key"), "value")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "shard")
    a = e.filter("key % 3 <> 0").withColumn("rank", F.row_number().over(w.orderBy(F.desc("value"), "key"))).filter("rank <= 30")
    b = e.filter("key % 4 <> 0").withColumn("rank", F.row_number().over(w.orderBy("value", "key"))).filter("rank <= 30")
    return a, b


_ranked = lambda m, o: f"(SELECT * FROM (SELECT user_id AS query_id, event_type AS shard, event_id AS key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value {o}, event_id) AS rank FROM events WHERE event_id % {m} <> 0) WHERE rank <= 30)"
_part = lambda c: f"1.0 / (60 + coalesce({c}, 90))"
add(
    "ret05_rrf", lambda s, d: R.fuse_ranks(*_two_lists(s, d), "query_id", 10).select("query_id", "shard", "key", F.round("score", 8).alias("score"), "rank"),
    f"SELECT query_id, shard, key, round(score, 8) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(dr, 31), shard, key) AS r FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.shard, b.shard) AS shard, coalesce(a.key, b.key) AS key, round({_part('a.rank')} + {_part('b.rank')}, 10) AS score, b.rank AS dr FROM {_ranked(3, 'DESC')} a FULL JOIN {_ranked(4, '')} b ON a.query_id = b.query_id AND a.shard = b.shard AND a.key = b.key)) WHERE r <= 10",
)
add("ret05_hybrid_routed", lambda s, d: pipeline.hybrid_search(written(pipeline.corpus(s, d), "corpus"), pipeline.questions(s, d)).select("query_id", "shard", "key", "score", "rank"))
add("ret08_embedding", lambda s, d: table(s, d, "eval_item").select("item_id", embedding(F.col("text"), prefix="query: ").alias("v")).select("item_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("squared")), "SELECT item_id, 128 AS dim, 1.0 AS squared FROM eval_item")
add("ans01_extract", lambda s, d: A.extract_answers(_own_hits(s, d), "query_id", "question", "text", "rank"))
add("ans07_decision", lambda s, d: pipeline.flagship(s, d).select("query_id", "decision", "reason_code", "answer", F.round("confidence", 4).alias("confidence"), F.size("citations").alias("citations")))
add("ans10_system_info", lambda s, d: pipeline.system_info(s))


def _own_hits(s, d):
    """A question's own candidates in order, as hits."""
    e = table(s, d, "eval_example").groupBy("query_id").agg(F.min(F.struct("query_en", "candidates_en")).alias("x"))
    return e.select("query_id", F.col("x.query_en").alias("question"), F.posexplode("x.candidates_en").alias("i", "text")).withColumn("rank", F.col("i") + 1)


# ---- sources
def _segment_names(s, d):
    o = table(s, d, "passage_occurrence").select(F.concat("config_language", F.lit("_"), F.split_part("source_shard", F.lit("/"), F.lit(1)), F.lit("_segment_"), F.lpad((F.col("source_row") % 5).cast("string"), 4, "0")).alias("name"))
    return o.distinct()


add(
    "src11_segment_cap", lambda s, d: readers.segments_in_order(_segment_names(s, d), "name", 3).select("name", "language", "split", "segment", "position"),
    r"SELECT name, language, split, segment, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY split = 'validation', name) AS position FROM (SELECT DISTINCT config_language || '_' || split_part(source_shard, '/', 1) || '_segment_' || lpad(CAST(source_row % 5 AS VARCHAR), 4, '0') AS name, config_language AS language, split_part(source_shard, '/', 1) AS split, CAST(source_row % 5 AS INT) AS segment FROM passage_occurrence)) WHERE position <= 3",
)
add("src04_config_of_file", lambda s, d: table(s, d, "passage_occurrence").groupBy("source_shard").agg(F.min("config_language").alias("config_language")).select("source_shard", "config_language", (readers.config_of(F.col("source_shard")) == F.col("config_language")).alias("same")), "SELECT source_shard, min(config_language) AS config_language, true AS same FROM passage_occurrence GROUP BY 1")


def _fetch(s, d):
    best = _bm25(s, d, 1).select("query_id", "shard", "key")
    return readers.fetch(best, _docs(s, d), ["shard", "key"]).select("query_id", "shard", "key", F.length("text").alias("chars"))


add("src08_late_fetch", _fetch, f"SELECT b.query_id, b.shard, b.key, CAST(length(t.text) AS INT) AS chars FROM {BM25} b JOIN {DOCS} t ON t.shard = b.shard AND t.key = b.key WHERE rank = 1")


def _ingest(s: SparkSession, d: str) -> DataFrame:
    base = f"{scratch_dir(s)}/ingest-{next(tempfile._get_candidate_names())}"
    o = table(s, d, "passage_occurrence").filter("content_hash is not null").select("occurrence_id", "config_language", F.coalesce("split", F.lit("")).alias("split"), "source_row", "passage_position", "is_original_english", "content_hash", "batch_no")
    for b in range(5):
        o.filter(F.col("batch_no") == b).drop("batch_no").coalesce(1).write.mode("append").parquet(f"{base}/in")
    schema = o.drop("batch_no").schema
    ingest.ingest(s, f"{base}/in", schema, f"{base}/out", f"{base}/checkpoint")
    return s.read.parquet(f"{base}/out").groupBy("is_original_english", "content_hash").agg(F.count("*").alias("n"))


add("str01_incremental_ingest", _ingest, "SELECT is_original_english, content_hash, 1 AS n FROM passage_occurrence WHERE content_hash IS NOT NULL GROUP BY 1, 2")


def _eval_index(s, d):
    """The index of an evaluation run: candidates of both languages in character windows, searched by inner product with the questions of both."""
    from ..operators.chunk import char_windows
    from .eval_queries import scored

    x = scored(s, d).select("query_id", "lang", "i", F.inline(char_windows(F.col("text")))).select(F.xxhash64("query_id", "lang", "i", "chunk_ordinal").alias("key"), F.col("query_id").alias("owner"), embedding(F.col("text"), prefix="passage: ").alias("vector"))
    rows = written(x, "eval-index")
    q = scored(s, d).select((F.col("query_id") * 2 + (F.col("lang") == "hi").cast("int")).alias("q"), F.col("q").alias("text")).distinct().withColumn("vector", embedding(F.col("text"), prefix="query: "))
    top = R.dense_search(rows, q, "key", "vector", 5, query_key="q")
    return top.join(rows.select("key", "owner").dropDuplicates(["key"]), "key").select(F.floor(F.col("query_id") / 2).alias("query_id"), "rank", "score", (F.col("owner") == F.floor(F.col("query_id") / 2)).alias("own"))


add("ret07_eval_search", _eval_index)


def _adapter(s, d):
    """Guard, extraction and grounding over a question's own candidates; the text is blank unless grounded."""
    h = _own_hits(s, d).withColumn("key", F.col("i").cast("bigint"))
    req = pipeline.questions(s, d)
    out = A.decide(req, h, A.extract_answers(h, "query_id", "question", "text", "rank"), "query_id", "question", "text", "rank")
    return out.select("query_id", (F.col("decision") == "allow").alias("grounded"), F.coalesce("answer", F.lit("")).alias("text"), "reason_code")


add("ans09_eval_adapter", _adapter)
add("smp03_language_queries", lambda s, d: readers.language_queries(_source_rows(s, d), 20), f"SELECT query_id, kind, CASE WHEN kind = 'native' THEN query_hi ELSE query_en END AS text FROM (SELECT * FROM {EXAMPLES} WHERE query_hi <> '' AND query_en <> '' ORDER BY query_id LIMIT 10), (VALUES ('native'), ('english')) k(kind)")


def _source_rows(s, d):
    return table(s, d, "eval_example").dropDuplicates(["query_id"]).select("query_id", F.col("query_hi").alias("query"), F.col("query_en").alias("Eng_Query"))


add("txt29_json_fields", lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m")).select("event_id", F.size("m").alias("n"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names")), "SELECT event_id, CAST(len(json_keys(props)) AS INT) AS n, array_to_string(list_sort(json_keys(props)), ',') AS names FROM events")
