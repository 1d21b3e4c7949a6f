"""Retrieval moves rows in proportion to documents and answers, not to their product with the questions."""

import random
import uuid

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from passagemill.operators import retrieve as R
from passagemill.plans import pipeline
from passagemill.plans.retrieval_queries import QUERIES, SQL

from .llm import tables


def moved(spark, run):
    """Rows of run(), and how many records all its jobs wrote to shuffles."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        rows = [tuple(r) for r in run().collect()]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, tracker, n = sc._jsc.sc().statusStore(), sc.statusTracker(), 0
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        n += store.lastStageAttempt(stage).shuffleWriteRecords()
    return rows, n


def test_a_task_keeps_the_nearest_of_whole_shards(spark):
    corpus = spark.range(1600).select(F.col("id").alias("key"), F.when(F.col("id") % 4 == 0, "mr").when(F.col("id") % 4 == 1, "te").otherwise("hi").alias("shard"), F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(8)]).alias("vector")).repartition(16)
    routed = spark.range(150).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("hi"), F.lit("mr"))).alias("shard"), F.array(*[F.cos(F.col("id") * (i + 1)).cast("float") for i in range(8)]).alias("vector"))
    rows, n = moved(spark, lambda: pipeline.dense_within(corpus, routed, 20))
    assert len(rows) == 150 * 2 * 20 and {r[3] for r in rows} == {"hi", "mr"}
    assert n < 2 * (1600 + 150 * 2 * 20)  # 16 tasks with k rows a question each were 84,000


def test_nearest_across_batches_and_blocks_of_questions(spark, monkeypatch):
    monkeypatch.setattr(R, "SCORED", 7, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = spark.range(600).select(F.col("id").alias("vec_id"), F.array(*[F.sin((F.col("id") % 90) * (i + 1)).cast("float") for i in range(6)]).alias("embedding"))
        got = {}
        for r in R.dense_search(rows, rows.filter("vec_id < 40"), "vec_id", "embedding", 9).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    v = R._unit(np.array([r.embedding for r in rows.orderBy("vec_id").collect()], dtype="float64"))
    for q in range(40):  # every vector stands there six or seven times: ties go to the lower key
        s = (v @ v[q]).round(6)
        assert got[q] == sorted(range(600), key=lambda i: (-s[i], i))[:9]


@pytest.fixture
def asked(tmp_path):
    """400 questions that share words with 500 documents, some keys twice, some texts without words."""
    r = random.Random(7)
    word = lambda: r.choice(["The", "of", "is", *(f"t{i}" for i in range(50))])
    docs = [dict(doc_id=i % 450, lang=r.choice(["EN", "hi", None]), text=r.choice([None, " ", *[" ".join(word() for _ in range(r.randrange(1, 30)))] * 20])) for i in range(500)]
    questions = [dict(query_id=i, query_en="what is the of " + " ".join(word() for _ in range(r.randrange(3)))) for i in range(400)] + [dict(query_id=900, query_en="none"), dict(query_id=901)]
    return tables.write(tmp_path, documents=docs, eval_example=questions)


def by_sql(folder, name):
    c = duckdb.connect()
    for t in ("documents", "eval_example"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return {tuple(r) for r in c.sql(SQL[name]).fetchall()}


@pytest.mark.parametrize("doc_block, term_block", [(32_768, 16_384), (1, 90)])
def test_bm25_as_the_sql_without_a_row_for_each_question_and_document(spark, asked, monkeypatch, doc_block, term_block):
    monkeypatch.setattr(R, "DOC_BLOCK", doc_block, raising=False)
    monkeypatch.setattr(R, "TERM_BLOCK", term_block, raising=False)
    rows, n = moved(spark, lambda: QUERIES["ret02_bm25_topk"](spark, asked))
    assert set(rows) == by_sql(asked, "ret02_bm25_topk") and len(rows) == len(set(rows))
    assert doc_block == 1 or n < 500 * 30 + 2 * len(rows)  # the join had a row for each pair with a common word: about 180,000


def test_late_fetch_as_the_sql(spark, asked):
    rows, n = moved(spark, lambda: QUERIES["src08_late_fetch"](spark, asked))
    assert sorted(rows) == sorted(by_sql(asked, "src08_late_fetch")) and n < 500 * 30 + 3 * len(rows)


def test_padding_fills_each_shard_once(spark, asked):
    rows, n = moved(spark, lambda: QUERIES["ret02_bm25_padded"](spark, asked).select("query_id", "shard", "key", F.expr("round(score * 1e4) / 1e4"), "rank"))
    found = {r for r in rows if r[3] > 0}
    assert found == by_sql(asked, "ret02_bm25_topk") and n < 500 * 30 + 6 * len(rows)
    keys, lists = {}, {}
    for k, s in spark.read.parquet(f"{asked}/documents.parquet").selectExpr("doc_id", "coalesce(lower(lang), 'und')").distinct().collect():
        keys.setdefault(s, []).append(k)
    for q, s, k, _, rank in sorted(rows, key=lambda r: (r[0], r[1], r[4])):
        lists.setdefault((q, s), []).append(k)
    assert set(lists) == {(q, s) for q in [*range(400), 900, 901] for s in keys}
    for (q, s), got in lists.items():
        scored = [r[2] for r in sorted((r for r in found if r[:2] == (q, s)), key=lambda r: r[4])]
        assert got == (scored + [k for k in sorted(keys[s]) if k not in scored])[:10]


def test_hybrid_ranks_only_routed_shards(spark):
    r = random.Random(11)
    text = lambda: " ".join(r.choice(["the", "of", *(f"t{i}" for i in range(40))]) for _ in range(15))
    corpus = spark.createDataFrame([(i, r.choice(["hi", "mr", "bn", "te"]), text(), [r.random() for _ in range(128)]) for i in range(400)], "key long, shard string, text string, vector array<float>").repartition(8)
    requests = spark.createDataFrame([(i, "the " + r.choice(["of t1", "t2 t3", "t4", "none", "কী t5"])) for i in range(200)], "query_id long, question string")
    rows, n = moved(spark, lambda: pipeline.hybrid_search(corpus, requests, 5).select("query_id", "shard", "key", "score", "rank"))
    to = {i: ({"bn", "hi"} if "কী" in q else {"hi", "mr"}) for i, q in requests.collect()}
    assert {x[0] for x in rows} == set(to) and all(x[1] in to[x[0]] for x in rows)
    every = R.bm25_search(corpus, requests, "key", "shard", "text", "query_id", "question", 30)
    routed = spark.createDataFrame([(i, s) for i, ss in to.items() for s in ss], "query_id long, shard string")
    within = R.bm25_search(corpus, requests, "key", "shard", "text", "query_id", "question", 30, within=routed)
    same = lambda d: {tuple(x) for x in d.select("query_id", "shard", "key", "score", "rank").collect()}
    assert same(within) == same(every.join(routed, ["query_id", "shard"], "left_semi"))
    assert n < 6 * 200 * 2 * 30  # either list of 30, of two shards a question, is ranked, joined and fused; it was 132,496
