"""Small tables in the layout of the test data, with whatever rows a test names; columns that a test leaves out are null."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

S, L, I, D, B = pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.bool_()
TS = pa.timestamp("us")
SCHEMAS = {
    "passage_occurrence": dict(occurrence_id=L, passage_id=S, dataset_revision=S, config_language=S, split=S, source_shard=S, source_row=I, passage_position=I, passage_language=S, raw_text=S, normalized_text=S, content_hash=S, is_original_english=B, origin=S, site=S, batch_no=I, ingested_at=TS),
    "seen_hashes": dict(content_hash=S, first_passage_id=S),
    "chunk": dict(chunk_id=L, text=S, chunk_strategy=S, chunk_strategy_version=S, chunk_ordinal=I, chunk_total=I, parent_passage_id=S, token_length=I, char_length=I, tokenizer_label=S, embedding_text=S),
    "citation": dict(citation_id=L, request_id=S, passage_id=S, language=S, chunk_ordinal=I, text=S, score=D, cited_at=TS),
    "eval_example": dict(query_id=L, query_en=S, query_hi=S, is_answerable=B, gt_answer_en=S, gt_passage_index=I, candidates_en=pa.list_(S), candidates_hi=pa.list_(S)),
    "latency_sample": dict(request_id=S, query=S, language=S, decision=S, reason_code=S, total_backend_ms=D, stages_ms=pa.map_(S, D), error=S, sampled_at=TS, received_at=TS),
    "documents": dict(doc_id=L, text=S, lang=S, source=S, n_chars=L, fetched_at=TS),
    "eval_item": dict(item_id=L, text=S, lang=S),
}
DAY = dt.datetime(2025, 3, 3)
#: Columns that no table has, with names that operators use inside.
EXTRA = {"class": S, "tokens": S, "n": L, "path": S, "value": S, "block": S}


def write(folder, extra=False, **rows):
    """Write every table; rows: table name to list of dicts."""
    folder = str(folder)
    for name, schema in SCHEMAS.items():
        fields = dict(schema) | (EXTRA if extra else {})
        data = [{k: r.get(k) for k in fields} for r in rows.get(name, [])]
        pq.write_table(pa.Table.from_pylist(data, schema=pa.schema(list(fields.items()))), f"{folder}/{name}.parquet")
    return folder


def passages(texts, **same):
    """Rows of passage_occurrence; a text or a dict with raw_text and what differs."""
    out = []
    for i, t in enumerate(texts):
        r = dict(occurrence_id=i + 1, passage_id=f"p{i + 1}", config_language="hi", split="train", source_shard="train/hintrain.parquet", source_row=i, passage_position=i % 4, passage_language="en", origin="passage", site="a-b.example", batch_no=0, is_original_english=True)
        out.append(r | same | (t if isinstance(t, dict) else {"raw_text": t}))
    return out
