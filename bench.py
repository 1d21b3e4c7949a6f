"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from passagemill.plans import catalog
from passagemill.session import build_session

try:
    from passagemill.llm import queries as training_data
except ImportError:
    training_data = None

HEADLINE = [
    "txt01_normalize", "txt09_content_tokens", "txt13_input_guard", "prs01_parse", "chk02_sentence_aware", "chk03_fixed_token", "chk08_char_window", "ded01_first_wins", "ded02_seen_antijoin", "ded03_merge_rekey",
    "ret01_postings", "ret02_bm25_topk", "ret04_dense_topk", "ret03_cell_index_topk", "ret05_rrf", "ret05_hybrid_routed", "ans06_grounding", "ans07_decision", "agg03_recall_mrr", "agg08_nearest_rank", "agg10_stage_percentiles",
    "agg12_document_frequency", "agg15_threshold_sweep", "agg17_skyline",
    "p1_found", "p2_found", "p3_found", "p4_found", "p5_percentiles", "p6_found", "p7_pieces", "p8_assignments", "p9_found", "p10_found",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries = catalog.queries() | (training_data.queries() if training_data else {})
    names = sys.argv[1:] or [n for n in HEADLINE if n in queries]
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 2)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
