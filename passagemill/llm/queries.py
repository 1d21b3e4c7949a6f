"""The queries of the ten training-data problems; each reads its whole tables."""

from __future__ import annotations

import importlib

#: Query name, module, function.
REGISTRY = [
    ("p1_found", "p01_boilerplate", "found"),
    ("p1_main_text", "p01_boilerplate", "main_text"),
    ("p2_found", "p02_overlap", "found"),
    ("p2_report", "p02_overlap", "report"),
    ("p2_links", "p02_overlap", "links"),
    ("p3_found", "p03_sentences", "found"),
    ("p3_sentences", "p03_sentences", "sentences"),
    ("p4_found", "p04_language", "found"),
    ("p4_segments", "p04_language", "assigned"),
    ("p5_percentiles", "p05_percentiles", "percentiles"),
    ("p5_day_digests", "p05_percentiles", "day_digests"),
    ("p5_group_counts", "p05_percentiles", "group_counts"),
    ("p6_found", "p06_history", "found"),
    ("p6_decisions", "p06_history", "decisions"),
    ("p6_representatives", "p06_history", "representatives"),
    ("p7_pieces", "p07_split", "pieces"),
    ("p8_assignments", "p08_packing", "assignments"),
    ("p8_fill", "p08_packing", "fill"),
    ("p8_equal_mixture", "p08_packing", "equal_mixture"),
    ("p9_found", "p09_leaks", "found"),
    ("p9_matches", "p09_leaks", "matches"),
    ("p10_found", "p10_residue", "found"),
    ("p10_scores", "p10_residue", "scores"),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), function) for name, module, function in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {}
