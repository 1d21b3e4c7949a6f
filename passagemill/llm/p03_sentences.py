"""Problem 3: sentences of documents in many languages and scripts.

Method: candidate boundaries with a maximum-entropy classifier. Every run of end marks with its closing quotes is a
candidate; blank lines end sentences by themselves. The classifier is a logistic model over the neighbouring tokens (how
often a token ends or begins a paragraph against how often it occurs at all), case, length, digits and script of what
surrounds the mark. It is trained on reliable boundaries: ends of paragraphs against plain gaps between words, from at most
SAMPLE_ROWS rows of every config_language, chosen by hash. Marks shift the odds by fixed amounts.

Null and blank texts have no sentence. A text without any mark is one sentence for each paragraph. Repeated rows give their
own rows. Offsets count code points.
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

from ..session import table

SAMPLE_ROWS = 500
#: End marks, what may close a sentence after them, what may open the next one.
CANDIDATE = re.compile("[.!?।॥۔؟…。！？]+[\"'”’»)\\]]*")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
OPENERS = "\"'“‘«([{-–—•*"
EDGE = "\"'“”‘’«»()[]{}.,;:!?।॥۔؟…،-–—•*"
INVISIBLE = "​‌‍⁠﻿­‎‏"
#: Log odds that a mark adds.
MARK_ODDS = {"danda": 6.0, "strong": 5.0, "dot": 4.0, "pause": 1.5}
STRONG_SET, DANDA_SET = set("!?؟！？"), set("।॥۔。")
ALPHA = 0.3


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each paragraph without the white and invisible characters around it."""
    at = 0
    for m in [*BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        a, b = at, end
        while a < b and (text[a].isspace() or text[a] in INVISIBLE):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in INVISIBLE):
            b -= 1
        if b > a:
            yield a, b
        if m:
            at = m.end()


def script(c: str) -> str:
    """A letter's block of 128 code points, all Latin ones alike."""
    return "latin" if c < "ɐ" else str(ord(c) >> 7)


class BoundaryModel:
    """Counts of tokens and the weights of the classifier."""

    FEATURES = ["bias", "end", "unknown latin", "unknown other", "begin", "next lower", "next upper", "next digit", "next opener", "one letter", "digits", "inner dot", "capital before", "short"]

    def __init__(self, seen: dict[str, tuple[int, int, int]], rate: float, weights: np.ndarray):
        self.seen, self.rate, self.weights = seen, rate, weights

    def features(self, before: str, after: str, own: int = 0) -> list[float]:
        """Of a gap between two tokens; own: 1 if the gap itself was counted as an end and a beginning."""
        b, a = before.strip(EDGE), after.strip(EDGE)
        n, e, _ = self.seen.get(b, (0, 0, 0))
        m, _, s = self.seen.get(a, (0, 0, 0))
        n, e, m, s = max(0, n - own), max(0, e - own), max(0, m - own), max(0, s - own)
        latin = b[-1:] < "ɐ"
        first = after[:1]
        while first and first in OPENERS and len(after) > 1:
            after = after[1:]
            first = after[:1]
        return [
            1.0,
            float(np.log((e + ALPHA * self.rate) / (n + ALPHA) / self.rate)) if n else 0.0,
            float(n < 3 and latin), float(n < 3 and not latin),
            float(np.log((s + ALPHA * self.rate) / (m + ALPHA) / self.rate)) if m else 0.0,
            float(first.islower()), float(first.isupper()), float(first.isdigit()), float(a is not after and after[:1] in OPENERS),
            float(len(b) == 1), float(b.isdigit()), float("." in b and not any(c.isdigit() for c in b)), float(b[:1].isupper()), float(len(b) <= 3),
        ]

    def score(self, before: str, after: str) -> float:
        return float(np.dot(self.weights, self.features(before, after)))


def train(texts: list[str]) -> BoundaryModel:
    total, ends, begins = Counter(), Counter(), Counter()
    gaps, bounds = [], []
    for t in texts:
        last = ""
        for a, b in paragraphs(t):
            raw = t[a:b].split()
            toks = [w.strip(EDGE) for w in raw]
            total.update(toks)
            begins[toks[0]] += 1
            k = -2 if len(toks) > 1 and not toks[-1] else -1  # a mark that stands alone
            ends[toks[k]] += 1
            if last:
                bounds.append((last, raw[0]))
            last = raw[k].rstrip(EDGE)
            for i in range(1, len(raw) - 1, 3):
                if raw[i][-1] not in EDGE and raw[i + 1][0] not in EDGE:
                    gaps.append((raw[i], raw[i + 1]))
    n, rate = sum(total.values()), max(1, sum(ends.values()))
    seen = {w: (c, ends[w], begins[w]) for w, c in total.items() if c >= 3 and w}
    model = BoundaryModel(seen, rate / max(1, n), np.array([0.0] * len(BoundaryModel.FEATURES)))
    model.weights[:2] = -1.0, 1.0
    if len(bounds) < 50 or len(gaps) < 50:
        return model
    gaps = gaps[:: max(1, len(gaps) // (3 * len(bounds)))]
    x = np.array([model.features(*p, own=1) for p in bounds] + [model.features(*g) for g in gaps])
    y = np.array([1.0] * len(bounds) + [0.0] * len(gaps))
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1.0 * np.eye(len(w)), x.T @ (y - p) - 1.0 * w)
    model.weights = w
    return model


def sentence_ends(text: str | None, model: BoundaryModel) -> list[int]:
    """End offsets of the sentences of a text."""
    if not text:
        return []
    out = []
    for a, b in paragraphs(text):
        begin = a
        for m in CANDIDATE.finditer(text, a, b):
            if m.end() >= b:
                break
            at = m.start()
            marks = m.group().rstrip("\"'”’»)]")
            stop, end = at + len(marks), m.end()
            # a straight quote closes only if one is open in the sentence; else it opens the next
            for i in range(stop, end):
                if text[i] in "\"'" and text.count(text[i], begin, i) % 2 == 0:
                    end = i
                    break
            after = end
            while after < b and (text[after].isspace() or text[after] in INVISIBLE):
                after += 1
            c = text[after]
            if c in ",;:،" or c in STRONG_SET:
                continue
            kind = "danda" if DANDA_SET.intersection(marks) else "strong" if STRONG_SET.intersection(marks) else "pause" if len(marks) > 1 or marks == "…" else "dot"
            if c.islower():
                continue
            head = text[begin:at].rstrip()
            space = max(head.rfind(" "), head.rfind("\n"))
            before = head[space + 1 :].lstrip(OPENERS)
            if kind == "dot":
                if not head.strip(OPENERS + " ") or head.strip(OPENERS + " )").isdigit() and len(head) <= 5:
                    continue  # a list number belongs to what follows
                if after == end and c.isalnum() and (c.isdigit() or len(before) == 1 or "." in before or c >= "ɐ" and not model.seen.get(before.strip(EDGE), (0, 0, 0))[1]):
                    continue  # inside a number or an abbreviation; without a space only a token that ends paragraphs ends a sentence
            elif not before and kind != "danda":
                continue
            if kind in ("danda", "strong") and not (end > stop and c in "("):
                # such marks end unless a clause carries a quotation on
                keep = 6.0
            else:
                keep = 0.0
            end_of_next = after
            while end_of_next < b and not text[end_of_next].isspace():
                end_of_next += 1
            if model.score(before, text[after:end_of_next]) + MARK_ODDS[kind] + keep > 0:
                out.append(end)
                begin = after
        out.append(b)
    return out


def fitted(passages: DataFrame) -> BoundaryModel:
    """The model from at most SAMPLE_ROWS rows of each config_language, those of the lowest hash."""
    w = Window.partitionBy("config_language").orderBy(F.xxhash64("occurrence_id"), "occurrence_id")
    low = passages.select("config_language", "occurrence_id").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLE_ROWS).select("occurrence_id")
    rows = passages.join(F.broadcast(low), "occurrence_id").select("occurrence_id", "raw_text").collect()
    return train([r.raw_text for r in sorted(rows, key=lambda r: (r.occurrence_id, r.raw_text or "")) if r.raw_text])


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occurrence_id, sentence_no, begin_offset, end_offset of each sentence of the rows with origin passage."""
    rows = table(spark, sf_dir, "passage_occurrence").filter("origin = 'passage'").select("occurrence_id", "config_language", "raw_text")
    shared = spark.sparkContext.broadcast(fitted(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            out = []
            for i, t in zip(b["occurrence_id"], b["raw_text"]):
                at = 0
                for k, e in enumerate(sentence_ends(t, model)):
                    while text_space(t, at):
                        at += 1
                    out.append((i, k, at, e))
                    at = e
            yield pd.DataFrame(out, columns=["occurrence_id", "sentence_no", "begin_offset", "end_offset"])

    return rows.select("occurrence_id", "raw_text").mapInPandas(run, "occurrence_id bigint, sentence_no int, begin_offset int, end_offset int")


def text_space(t: str, at: int) -> bool:
    return at < len(t) and (t[at].isspace() or t[at] in INVISIBLE)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("occurrence_id", "end_offset")
