"""Every query of the ten problems over empty tables, and over nulls, empty and very long texts, ties, repeats and clashing names."""

import pytest

from passagemill.llm import queries as Q

from .tables import DAY, passages, write

LONG = "The wide river carries cold water past the old mill. " * 4000
NAMES = [name for name, _, _ in Q.REGISTRY]


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    texts = [None, "", " \n\r\n ", "...", LONG, "x" * 5000, "The cat sat on the mat near the door.", "The cat sat on the mat near the door.", "नमस्ते दुनिया। यह एक वाक्य है।"]
    rows = passages(texts) + passages([{"raw_text": t, "occurrence_id": 100 + i, "passage_id": f"q{i}", "split": s, "batch_no": b, "passage_language": None} for i, (t, s, b) in enumerate(zip(texts, ["val", None, "TRAIN", "Validation", "validation", "val", "val", "train", "dev"], [1, 2, 3, 4, 1, 2, 3, 4, None]))])
    rows += passages([{"raw_text": t, "occurrence_id": 200 + i, "passage_id": f"g{i}", "origin": "page", "site": s} for i, (t, s) in enumerate([(None, None), ("", "a.example"), ("Home | Search\nThe cat sat on the mat near the door.\r\n\nBack to top", None), (LONG, "a.example")])])
    rows += [dict()]  # nothing but nulls
    chunks = [dict(chunk_id=i, text=t, parent_passage_id=p, chunk_ordinal=o, chunk_strategy="s") for i, (t, p, o) in enumerate([(None, None, None), ("", "g1", 0), (LONG, "g3", 0), ("x" * 1500, "g3", 0), ("Home | Search", "g2", 1), ("Home | Search", "g2", 1)])]
    lat = [dict(request_id=r, language=l, decision=d, total_backend_ms=v, stages_ms=m, sampled_at=a, received_at=b) for r, l, d, v, m, a, b in [("a", "en", "allow", 1.0, [("rerank", 2.0)], DAY, DAY), ("a", "en", "allow", 1.0, [("rerank", 2.0)], DAY, DAY), (None, None, None, None, None, None, None), ("b", None, "allow", float("nan"), [], DAY, DAY), ("c", "en", "allow", float("inf"), [("rerank", None)], DAY, None)]]
    docs = [dict(doc_id=i, text=t, source=s) for i, (t, s) in enumerate([(None, "a"), ("", None), (LONG, "a"), ("null\nundefined", None), ("The cat sat on the mat near the door today.", "a"), ("The cat sat on the mat near the door today.", "a"), ("🙂 " * 50, "b")])]
    return write(
        tmp_path_factory.mktemp("edges"), extra=True, passage_occurrence=rows, chunk=chunks, latency_sample=lat, documents=docs,
        seen_hashes=[dict(), dict(content_hash="h"), dict(first_passage_id="x")], citation=[dict(citation_id=1), dict(citation_id=2, text="", language="en"), dict(citation_id=3, text="The cat sat on the mat.", language="EN-us")],
        eval_example=[dict(query_id=1), dict(query_id=2, candidates_en=[None, "", "The cat sat on the mat near the door."]), dict(query_id=2, candidates_en=[None, "", "The cat sat on the mat near the door."]), dict(query_id=3, candidates_en=[])],
        eval_item=[dict(item_id=1), dict(item_id=2, text=""), dict(item_id=3, text="too short"), dict(item_id=4, text="the CAT sat, on the mat near the door today")],
    )


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert Q.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, edges, name):
    rows = Q.queries()[name](spark, edges).collect()
    if name == "p2_found":
        assert {("candidate", 2, 2), ("occurrence", 106, 2)} <= {tuple(r) for r in rows}
        assert len({tuple(r) for r in rows}) == len(rows)
    if name == "p6_found":
        assert {(107, "p7"), (106, "p7")} <= {tuple(r) for r in rows}
    if name == "p9_found":
        assert {tuple(r) for r in rows} == {(4, 4), (5, 4)}
    if name == "p10_found":
        assert [r.doc_id for r in rows] == [3]
    if name == "p5_percentiles":
        assert {(r.metric, r.n) for r in rows if r.grain == "all"} == {("total_backend_ms", 1), ("rerank", 1)}
    if name == "p7_pieces":
        assert all(r.char_length is None or r.char_length <= 600 for r in rows)
        assert {r.chunk_id for r in rows} == {0, 1, 2, 3, 4, 5}
