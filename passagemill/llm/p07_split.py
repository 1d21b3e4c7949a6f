"""Problem 7: chunks over the size limit come out as pieces at natural boundaries with overlap.

Method: lexical-cohesion segmentation. At every sentence end the words of a block before and a block after are compared; a
gap's depth is how far its similarity lies below the peaks on both sides. Of the paragraph and sentence ends in the size
window the deepest valley is cut; where the window has none, the last word end; where there is none either, the limit, moved
back in front of a combining mark. Then each piece begins with up to OVERLAP characters of the piece before, from a word on.

A text within the limit is one piece, the empty text too; null stays one piece with null text. Pieces overlap but their own
parts put together are the text. Ordinals follow chunk_ordinal, chunk_id within parent, strategy and version; nulls there
are values like others.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written
from .p03_sentences import BoundaryModel, fitted, sentence_ends

LIMIT, OVERLAP, BLOCK = 600, 60, 3
LEAST = 0.35
STEP = 1024
SENTENCE = re.compile(r"(?:[.!?。！？]+(?=[\s\"'”’»)\]]|$)|[।॥۔؟]+)[\"'”’»)\]]*\s*|\n+\s*")
WORD_END = re.compile(r"\s+")


def depths(text: str, ends: list[int]) -> list[float]:
    """How deep the valley of word similarity is at each end of a unit but the last."""
    units = [Counter(text[a:b].lower().split()) for a, b in zip([0, *ends], ends)]
    sims = []
    for i in range(1, len(units)):
        left, right = sum(units[max(0, i - BLOCK) : i], Counter()), sum(units[i : i + BLOCK], Counter())
        norm = (sum(v * v for v in left.values()) * sum(v * v for v in right.values())) ** 0.5
        sims.append(sum(v * right[w] for w, v in left.items()) / norm if norm else 0.0)
    # the peak at the end of the climb to either side; who climbs on shares the neighbour's
    left, right = sims[:], sims[:]
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            left[i] = left[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            right[i] = right[i + 1]
    return [l - s + r - s for l, s, r in zip(left, sims, right)]


LINE_END = re.compile(r"\n+\s*")


def unit_ends(text: str, model: BoundaryModel) -> list[int]:
    """Ends of sentences and lines, with the white space after them."""
    out = {m.end() for m in LINE_END.finditer(text)}
    for e in sentence_ends(text, model):
        while e < len(text) and text[e].isspace():
            e += 1
        out.add(e)
    return sorted(out)


def after_line(text: str, e: int) -> bool:
    """Whether a line break, blanks aside, is what stands before a place."""
    while e and text[e - 1] in " \t\r":
        e -= 1
    return e > 0 and text[e - 1] == "\n"


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, model: BoundaryModel | None = None) -> list[tuple[int, int, int]]:
    """(begin with overlap, begin, end) of each piece, in characters. Sentence ends come from the classifier of problem 3; without a model end marks before white space serve."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    ends = sorted(set([m.end() for m in SENTENCE.finditer(text)] if model is None else unit_ends(text, model)) - {0} | {len(text)})
    depth = dict(zip(ends, depths(text, ends)))
    paragraph = {e for e in ends if "\n" in text[max(0, e - 3) : e].strip(" \t\r")[-2:] or after_line(text, e)} if "\n" in text else set()
    words = [m.end() for m in WORD_END.finditer(text)]
    word_at = np.array(words, dtype=np.int64)
    ends_at = np.array(ends, dtype=np.int64)
    pieces, begin = [], 0
    while True:
        lead = begin
        if pieces and overlap:
            lead = max(begin - overlap, pieces[-1][1])
            k = int(np.searchsorted(word_at, lead))
            # from a word on, if the text before the cut has one; an unbroken string repeats its last characters
            if lead and not text[lead - 1].isspace() and k < len(words) and words[k] < begin:
                lead = words[k]
            while lead < begin and (unicodedata.combining(text[lead]) or unicodedata.category(text[lead])[0] == "M" or text[lead] == "‍"):
                lead += 1
        room = limit - (begin - lead)
        if len(text) - begin <= room:
            pieces.append((lead, begin, len(text)))
            return pieces
        low, high = begin + int(room * LEAST), begin + room
        inside = ends_at[np.searchsorted(ends_at, low, side="right") : np.searchsorted(ends_at, high, side="right")].tolist()
        if inside:
            cut = max(inside, key=lambda e: (depth.get(e, 0.0) + (0.25 if e in paragraph else 0.0), e))
        else:
            k = int(np.searchsorted(ends_at, high, side="right")) - 1
            w = int(np.searchsorted(word_at, high, side="right")) - 1
            if k >= 0 and ends[k] > begin + room // 8:
                cut = ends[k]
            elif w >= 0 and words[w] > begin:
                cut = words[w]
            else:
                cut = high
                while cut > begin + 1 and (unicodedata.category(text[cut])[0] == "M" or text[cut] in "‌‍" or text[cut - 1] == "‍"):
                    cut -= 1
                if cut == begin + 1:
                    cut = high
        pieces.append((lead, begin, cut))
        begin = cut


def split_rows(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, model: BoundaryModel | None = None) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                cuts = [(0, 0, 0)] if row.text is None else split_text(row.text, limit, overlap, shared.value)
                for i, (lead, begin, end) in enumerate(cuts):
                    out.append((row.chunk_id, row.parent_passage_id, row.chunk_strategy, row.chunk_strategy_version, None if pd.isna(row.chunk_ordinal) else int(row.chunk_ordinal), i, len(cuts), lead, begin, end, None if row.text is None else row.text[lead:end]))
            yield pd.DataFrame(out, columns=["chunk_id", "parent_passage_id", "chunk_strategy", "chunk_strategy_version", "old_ordinal", "piece_no", "piece_total", "lead_offset", "begin_offset", "end_offset", "text"]).astype({"old_ordinal": "Int32"})

    schema = "chunk_id bigint, parent_passage_id string, chunk_strategy string, chunk_strategy_version string, old_ordinal int, piece_no int, piece_total int, lead_offset int, begin_offset int, end_offset int, text string"
    return chunks.select("chunk_id", "parent_passage_id", "chunk_strategy", "chunk_strategy_version", "chunk_ordinal", "text").mapInPandas(run, schema)


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks as pieces of at most LIMIT characters, numbered anew within parent, strategy and version.

    Numbers are sums over narrow rows in two steps (ranges of STEP ordinals, then inside them), so one parent with very many chunks is no single sort.
    """
    model = fitted(table(spark, sf_dir, "passage_occurrence").filter("origin = 'passage'").select("occurrence_id", "config_language", "raw_text"))
    cut = written(split_rows(table(spark, sf_dir, "chunk"), model=model), "p7-pieces")
    parent = ["parent_passage_id", "chunk_strategy", "chunk_strategy_version"]
    heads = cut.filter("piece_no = 0").select(*parent, "chunk_id", "old_ordinal", "piece_total", F.coalesce(F.floor(F.col("old_ordinal") / STEP), F.lit(-1)).alias("part"))
    parts = heads.groupBy(*parent, "part").agg(F.sum("piece_total").alias("size"))
    w = Window.partitionBy(*parent)
    parts = parts.select(*parent, "part", (F.sum("size").over(w.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(w).alias("chunk_total"))
    inner = Window.partitionBy(*parent, "part").orderBy("old_ordinal", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("inside", F.coalesce(F.sum("piece_total").over(inner), F.lit(0)))
    same = [heads[c].eqNullSafe(parts[c]) for c in [*parent, "part"]]
    numbered = heads.join(parts, same).select(heads["chunk_id"], (F.col("before") + F.col("inside")).alias("base"), "chunk_total")
    return cut.join(numbered, "chunk_id").select(
        "chunk_id", *parent, "piece_no", (F.col("base") + F.col("piece_no")).cast("int").alias("chunk_ordinal"), F.col("chunk_total").cast("int").alias("chunk_total"), "lead_offset", "begin_offset", "end_offset", F.length("text").alias("char_length"), "text"
    )
