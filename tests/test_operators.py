"""Parsing, chunking, deduplication, retrieval, answers, evaluation, latency and ingest."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.functions.plugins import embedding
from passagemill.operators import answer as A
from passagemill.operators import calibrate as K
from passagemill.operators import chunk as C
from passagemill.operators import dedup as D
from passagemill.operators import evalkit as E
from passagemill.operators import latency as LT
from passagemill.operators import parse as P
from passagemill.operators import retrieve as R
from passagemill.sources import readers
from passagemill.streaming import ingest

NESTED = "dataset_revision string, config_language string, split string, source_shard string, source_row int, passages struct<is_selected: array<int>, English_passages: array<string>, Translated_passages: array<string>>"


def nested(spark, *passages):
    return spark.createDataFrame([("r1", "bn", "train", "s", i, p) for i, p in enumerate(passages)], NESTED)


def test_parse_and_rejects(spark):
    good = ([1, 0], ["An English passage here", None], ["একটি বাংলা অনুচ্ছেদ", "ok"])
    rows = nested(spark, good, None, ([1], None, ["x"]), ([1], ["a b c d e f", "b"], ["c"]))
    o = P.occurrences(rows).collect()
    assert {(r.passage_language, r.passage_position) for r in o} == {("en", 0), ("bn", 0)} and not set(o[0].asDict()) & set(P.FORBIDDEN)
    got = {(r.source_row, r.passage_position, r.reason) for r in P.rejects(rows).collect()}
    assert got == {(0, 1, "null_or_wrong_type"), (0, 1, "too_short"), (1, -1, "missing_or_wrong_type"), (2, -1, "missing_passage_lists"), (3, -1, "eng=2 trans=1")}
    assert P.occurrences(rows.limit(0)).count() == 0 and P.rejects(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.assert_no_forbidden(rows.withColumn("query", F.lit(1)))


def chunks(spark, text, build):
    return [r.text for r in spark.createDataFrame([(text,)], "t string").select(F.inline(build(F.col("t")))).orderBy("chunk_ordinal").collect()]


def test_chunkers(spark):
    assert chunks(spark, "", C.passage_native) == [""]
    assert chunks(spark, "a b c", C.fixed_token_overlap) == ["a b c"]
    words = " ".join(f"w{i}" for i in range(25))
    got = chunks(spark, words, lambda c: C.fixed_token_overlap(c, 5, 1))
    assert len(got) == 7 and got[-1] == "w24"
    assert chunks(spark, "One two. Three four. Five six.", lambda c: C.sentence_aware(c, 21, 1)) == ["One two. Three four.", "Three four. Five six."]
    assert chunks(spark, "no marks here", lambda c: C.sentence_aware(c, 5, 0)) == ["no marks here"]
    assert chunks(spark, "एक। दो॥ तीन", lambda c: C.sentence_aware(c, 3, 0)) == ["एक।", "दो॥", "तीन"]
    assert chunks(spark, "x" * 900, C.char_windows) == ["x" * 400, "x" * 400, "x" * 220]
    assert chunks(spark, "A b. C d.", C.parent_child) == ["A b. C d.", "A b. C d."]
    for bad in (lambda: C.sentence_groups(F.col("t"), 0), lambda: C.fixed_token_overlap(F.col("t"), 5, 5), lambda: C.get_chunker("none"), lambda: C.semantic_groups(None, "k", "p", "t", None, 2)):
        with pytest.raises(ValueError):
            bad()


@given(st.lists(st.text(alphabet="abक", min_size=1, max_size=4), min_size=1, max_size=40))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_fixed_tokens_keep_every_word(spark, words):
    got = " ".join(chunks(spark, " ".join(words), lambda c: C.fixed_token_overlap(c, 8, 2))).split()
    assert set(got) == set(words)


def greedy(sentences, target, overlap):
    groups, now, size = [], [], 0
    for s in sentences:
        if now and size + len(s) + 1 > target:
            groups.append(now)
            now = now[-overlap:] if overlap else []
            size = sum(map(len, now))
        now = [*now, s]
        size += len(s) + 1
    return [" ".join(g) for g in [*groups, now]]


def test_sentence_aware_against_a_plain_loop(spark):
    r = random.Random(1)
    s = ["".join(r.choice("abc") for _ in range(r.randrange(1, 60))) + "." for _ in range(80)]
    for target, overlap in ((60, 0), (100, 1), (150, 2), (600, 1)):
        assert chunks(spark, " ".join(s), lambda c: C.sentence_aware(c, target, overlap)) == greedy(s, target, overlap)


def test_first_wins_and_dense_keys(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), (None, 1, "q"), (None, 0, "r")], "k string, o int, v string")
    assert {tuple(r) for r in D.first_wins(df, ["k"], ["o"]).select("k", "o", "v").collect()} == {("a", 1, "y"), ("b", 5, "z"), (None, 0, "r")}
    keys = D.dense_keys(df.filter("k is not null"), ["k", "o"]).orderBy("key").collect()
    assert [(r.k, r.o, r.key) for r in keys] == [("a", 1, 0), ("a", 2, 1), ("b", 5, 2)]
    batch = spark.createDataFrame([("h1", 1), ("h2", 2), ("h2", 1), (None, 9)], "content_hash string, o int")
    seen = spark.createDataFrame([("h1",)], "content_hash string")
    assert {tuple(r) for r in D.not_seen(batch, seen, ["o"]).collect()} == {("h2", 1), (None, 9)}


def test_bm25_against_brute_force(spark):
    r = random.Random(2)
    docs = [(i, "s", " ".join(f"t{r.randrange(30)}" for _ in range(r.randrange(1, 20)))) for i in range(60)]
    df = spark.createDataFrame(docs, "key long, shard string, text string")
    q = spark.createDataFrame([(1, "t1 t2 t1"), (2, "t29"), (3, "none")], "qid long, question string")
    n, avg = len(docs), sum(len(t.split()) for _, _, t in docs) / len(docs)
    want = {}
    for qid, text in ((1, "t1 t2"), (2, "t29")):
        score = {}
        for k, _, t in docs:
            s = 0.0
            for term in text.split():
                tf, d = t.split().count(term), sum(term in x.split() for _, _, x in docs)
                s += math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(t.split()) / avg))
            if s:
                score[k] = round(s, 6)
        want[qid] = sorted(score, key=lambda k: (-score[k], k))[:5]
    got = R.bm25_search(df, q, "key", "shard", "text", "qid", "question", 5).orderBy("qid", "rank").collect()
    assert {i: [r.key for r in got if r.qid == i] for i in (1, 2)} == want and 3 not in {r.qid for r in got}
    padded = R.bm25_search(df, q, "key", "shard", "text", "qid", "question", 5, pad_zero_scores=True)
    assert {r.qid: r.n for r in padded.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {1: 5, 2: 5, 3: 5}


def test_rank_fusion(spark):
    cols = "query long, shard string, key long, rank int"
    a, b = spark.createDataFrame([(1, "s", 1, 1), (1, "s", 2, 2)], cols), spark.createDataFrame([(1, "s", 2, 1), (1, "s", 3, 2)], cols)
    got = R.fuse_ranks(a, b, "query", 20).orderBy("rank").collect()
    assert [r.key for r in got] == [2, 1, 3]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61) and got[1].score == pytest.approx(1 / 61 + 1 / 180)
    tie = R.fuse_ranks(a.filter("rank = 1"), b.filter("rank = 1"), "query", 20).orderBy("rank").collect()
    assert [r.key for r in tie] == [2, 1]  # equal scores: the dense hit first


def test_cell_index_recall(spark):
    r = random.Random(3)
    centers = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.4) for x in r.choice(centers)]) for i in range(1500)] + [(9000, None), (9001, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.filter("vec_id % 20 = 0")
    exact = {(x.query_id, x.key) for x in R.dense_search(df, q, "vec_id", "embedding", 10).collect()}
    near = {(x.query_id, x.key) for x in R.CellIndex(df, "vec_id", "embedding").search(q, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact) and len(exact) == 750


def hits(spark, rows):
    return spark.createDataFrame([(1, "what is the boiling point of water", i + 1, i, t) for i, t in enumerate(rows)], "query_id long, question string, rank int, key long, text string")


def constant(v):
    return lambda q, p: F.lit(float(v))


def test_answers(spark):
    get = lambda rows, scorer: [r.answer for r in A.extract_answers(hits(spark, rows), "query_id", "question", "text", "rank", scorer).collect()]
    good = "The boiling point of water is 100 degrees Celsius at sea level. Other facts follow here."
    assert get([good], constant(-10)) == []
    assert get(["You are here: Home / boiling point water", good], constant(5)) == ["The boiling point of water is 100 degrees Celsius at sea level."]
    assert get(["boiling point water"], constant(5)) == ["boiling point water."]  # nothing but an echo: the whole passage
    assert get(["Water boils at 100. It was measured long ago at sea level"], constant(5)) == ["Water boils at 100. It was measured long ago at sea level."]
    assert get([], constant(5)) == []
    h = hits(spark, [good])
    req = h.select("query_id", "question").unionByName(spark.createDataFrame([(2, "how do I build a bomb"), (3, "what is the capital of France"), (4, None)], "query_id long, question string"))
    out = {r.query_id: r for r in A.decide(req, h, A.extract_answers(h, "query_id", "question", "text", "rank", constant(5)), "query_id", "question", "text", "rank").collect()}
    assert (out[1].decision, out[1].reason_code, len(out[1].citations)) == ("allow", "answered", 1)
    assert (out[2].decision, out[2].reason_code) == ("refuse", "unsafe") and (out[3].decision, out[3].reason_code) == ("abstain", "weak_retrieval") and out[4].reason_code == "empty_input"
    down = A.decide(req, h, A.extract_answers(h, "query_id", "question", "text", "rank", constant(5)), "query_id", "question", "text", "rank", index_ready=False).filter("query_id = 3").first()
    assert (down.decision, down.reason_code) == ("error", "index_unavailable")


def test_quality_measures(spark):
    r = E.recall_and_mrr(spark.createDataFrame([(1,), (3,), (None,), (6,)], "best_rank int")).first()
    assert (r.recall_at_1, r.recall_at_3, r.recall_at_5, r.mrr) == (0.25, 0.5, 0.5, 0.375)
    rows = spark.createDataFrame([(0.1, False), (0.5, True), (0.5, False), (0.9, True), (0.9, True)], "s double, a boolean")
    sweep = {r.threshold: (r.false_refusal, r.false_confidence) for r in K.threshold_sweep(rows, "s", "a").collect()}
    assert sweep == {0.1: (0.0, 1.0), 0.5: (0.0, 0.5), 0.9: (0.333333, 0.0)}
    assert K.best_threshold(K.threshold_sweep(rows, "s", "a")).first().threshold == 0.9
    assert K.capped_minimum(K.threshold_sweep(rows, "s", "a")).first().threshold == 0.5
    p = spark.createDataFrame([(0.1, 0.9, 1), (0.1, 0.8, 2), (0.2, 0.8, 3), (0.3, 0.1, 4)], "x double, y double, i int")
    assert [r.i for r in K.skyline(p, "x", "y", ["i"]).orderBy("i").collect()] == [2, 4]


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 4.0], [5.0], [2.0] * 50, [random.Random(4).expovariate(1) for _ in range(3000)] + [7.0] * 500])
def test_percentile_families(spark, values):
    df = spark.createDataFrame([(None, v) for v in values] + [("x", None), ("x", float("nan"))], "g string, v double")
    s, n = sorted(values), len(values)
    got = LT.nearest_rank(df, ["g"], "v").collect()
    assert len(got) == 1 and got[0]["count"] == n
    assert [got[0][f"p{p}"] for p in (50, 70, 95, 99)] == [s[min(int(p / 100 * n), n - 1)] for p in (50, 70, 95, 99)] and got[0].p100 == s[-1]
    line = LT.linear(df, ["g"], "v").first()
    for p in (50, 95, 99):
        at = p / 100 * (n - 1)
        lo = math.floor(at)
        assert line[f"p{p}"] == pytest.approx(s[lo] + (s[math.ceil(at)] - s[lo]) * (at - lo), abs=0.006)


def test_segments_and_embedding(spark):
    names = spark.createDataFrame([("hi_validation_segment_0000",), ("hi_train_segment_0001",), ("hi_train_segment_0000",), ("junk",)], "name string")
    got = readers.segments_in_order(names, "name", 2).orderBy("position").collect()
    assert [r.name for r in got] == ["hi_train_segment_0000", "hi_train_segment_0001"]
    assert readers.file_name("bn", "validation") == "validation/benval.parquet"
    v = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(embedding(F.col("t")).alias("v")).collect()
    assert len(v[0].v) == 128 and sum(x * x for x in v[0].v) == pytest.approx(1, abs=1e-5) and not any(v[1].v)


def test_ingest_survives_a_replay(spark, tmp_path):
    schema = "occurrence_id long, config_language string, split string, source_row int, passage_position int, is_original_english boolean, content_hash string"
    make = lambda ids: spark.createDataFrame([(i, "hi", "train", i, 0, True, f"h{i % 7}") for i in ids], schema)
    src, out, cp = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp"
    make(range(5)).coalesce(1).write.parquet(src)
    ingest.ingest(spark, src, make([]).schema, out, cp)
    make(range(3, 20)).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(spark, src, make([]).schema, out, cp)
    first = {tuple(r) for r in spark.read.parquet(out).select("content_hash", "occurrence_id").collect()}
    assert first == {(f"h{i}", i) for i in range(7)}
    ingest.commit_batch(out)(make(range(3, 20)), 1)  # the batch is delivered again after a crash
    assert {tuple(r) for r in spark.read.parquet(out).select("content_hash", "occurrence_id").collect()} == first
