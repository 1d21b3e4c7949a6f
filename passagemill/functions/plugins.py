"""Extension points with deterministic defaults: embedder, reranker, judge. A model is any object with the same method; it is loaded once per Python worker."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed hashing of words and character trigrams; unit length. A text without words is the zero vector."""

    KEPT = 200_000

    def __init__(self, dim: int = 128):
        self.dim, self.known = dim, {}

    def word(self, w: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a word and its trigrams."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            h = [xxhash.xxh64_intdigest(x) for x in (w, *(f"^{w}$"[i : i + 3] for i in range(len(w))))]
            weight = np.array([2.0] + [0.5] * (len(h) - 1))
            got = self.known[w] = (np.array([x % self.dim for x in h]), np.where([x >> 63 for x in h], weight, -weight))
        return got

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, t in zip(out, texts):
            parts = [self.word(w) for w in t.lower().split()]
            if parts:
                row += np.bincount(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), self.dim).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedding(c: Column, make: Callable[[], Embedder] = HashEmbedder, prefix: str = "", batch: int = 32) -> Column:
    """array<float> of a text column. Batches are formed by length so that a padding model wastes little; null is embedded as the empty text."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            texts = [prefix + unicodedata.normalize("NFC", t or "").strip() for t in s]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            vectors: list = [None] * len(texts)
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                for i, v in zip(some, model.embed([texts[i] for i in some])):
                    vectors[i] = v
            yield pd.Series(vectors)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ArrayType(FloatType()))(c)


def embed_queries(queries: DataFrame, text: str, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """Each distinct question is embedded once."""
    return queries.join(queries.select(text).distinct().withColumn("vector", embedding(F.col(text), make, "query: ")), text, "left")


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit mean of the token vectors that the mask keeps."""
    m = mask[:, :, None].astype(np.float32)
    x = (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def piece_ids(ids: np.ndarray, offset: int = 1) -> np.ndarray:
    """Token ids of a vocabulary whose special tokens come first, shifted by its offset."""
    return ids + offset


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class OverlapReranker:
    """Content-word overlap on a scale like that of raw logits: -4 without any shared word, 4 with all of the question's."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, p in pairs:
            a, b = set(q.lower().split()), {w.strip(".,!?।॥\"'") for w in p.lower().split()}
            out.append(8.0 * len(a & b) / max(1, len(a)) - 4.0)
        return out


def rerank(query: Column, passage: Column, make: Callable[[], Reranker] = OverlapReranker, most: int = 256) -> Column:
    """Scores of (question, passage), both composed and cut to so many characters."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        cut = lambda t: unicodedata.normalize("NFC", t or "")[:most]
        for q, p in parts:
            yield pd.Series(model.score([(cut(a), cut(b)) for a, b in zip(q, p)]), dtype="float64")

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType())(query, passage)


class Judge(Protocol):
    def judge(self, rows: list[tuple[str, str, str]]) -> list[str]: ...


class WordJudge:
    """The answer stands if at least half of its different words are in the reference; JSON with verdict and reason, as a model would answer."""

    def judge(self, rows: list[tuple[str, str, str]]) -> list[str]:
        out = []
        for _, reference, answer in rows:
            a, r = set(answer.lower().split()), set(reference.lower().split())
            share = len(a & r) / max(1, len(a))
            out.append(json.dumps({"verdict": share >= 0.5, "reason": f"{share:.2f} of the words"}))
        return out


def judged(question: Column, reference: Column, answer: Column, make: Callable[[], Judge] = WordJudge) -> Column:
    """A judge's JSON on an answer: against the passages it should be faithful to, or the reference it should be equal to. Nulls are judged as empty texts."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, r, a in parts:
            yield pd.Series(model.judge([(x or "", y or "", z or "") for x, y, z in zip(q, r, a)]), dtype="object")

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, StringType())(question, reference, answer)
