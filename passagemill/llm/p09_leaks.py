"""Problem 9: passages of evaluation items inside training documents.

Method: spaced-seed hashing. A seed is a fixed mask over WINDOW words that ignores some positions; the words at the others
are hashed. The items' hashes under every mask form a sorted table (at most MAX_ITEM_WORDS words of items, else the items
come in several blocks of that size, each a pass over the documents). Each run of WINDOW words of a document looks its
hashes up; a hit names an item position, and around it the two texts are compared word by word: the longest run of equal
words, and the stretch that holds while at most one word in TOLERANCE differs. Ten or more equal words in a row hit every
mask, so the seeds miss none of them; a stretch with substitutions hits if they fall on positions that some mask ignores.

Null and empty texts and items of fewer than ten words share nothing. Repeated documents count each; a pair comes once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .words import _table, words

WINDOW = 10
#: Fixed masks: 1 takes the word at a position, 0 ignores it. The first takes all.
MASKS = ("1111111111", "1101101011", "1110010111", "1011110101")
TOLERANCE = 8
MAX_ITEM_WORDS = 2_000_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xB492B66FBE98F273], dtype=np.uint64)


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each run of WINDOW word numbers under a mask."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, len(mask), dtype=np.uint64)
    for k, m in enumerate(mask):
        if m == "1":
            x = (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _MULT[k]
            h += x ^ (x >> np.uint64(31))
    return h


class Items:
    """Seed tables of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.ids, seqs = [], []
        for item_id, text in items:
            w = words(text)
            if len(w) >= WINDOW:
                self.ids.append(item_id)
                seqs.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], dtype=np.int64))
        self.seqs = seqs
        self.tables = []
        for mask in MASKS:
            h = [seed_hashes(s, mask) for s in seqs]
            hashes = np.concatenate(h) if h else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(h)), [len(x) for x in h])
            at = np.concatenate([np.arange(len(x)) for x in h]) if h else owner
            order = np.argsort(hashes, kind="stable")
            self.tables.append((hashes[order], owner[order], at[order]))

    def search(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(document, item, longest run of equal words, longest stretch with few substitutions) of the pairs that a seed joins. Word number 0 equals nothing."""
        lens = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(lens + WINDOW)])[:-1]
        flat = np.zeros(int((lens + WINDOW).sum()), dtype=np.int64)
        for at, d in zip(starts, docs):
            flat[at : at + len(d)] = d
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        n = len(flat) - WINDOW + 1
        if n <= 0:
            return []
        dense = np.flatnonzero(known[WINDOW:] - known[:-WINDOW] >= min(m.count("1") for m in MASKS))
        hits = []
        for (hashes, owner, at), mask in zip(self.tables, MASKS):
            if not len(hashes) or not len(dense):
                continue
            h = np.full(len(dense), len(mask), dtype=np.uint64)
            ok = np.ones(len(dense), dtype=bool)
            for k, m in enumerate(mask):
                if m == "1":
                    v = flat[dense + k]
                    ok &= v > 0
                    x = (v.astype(np.uint64) + np.uint64(1)) * _MULT[k]
                    h += x ^ (x >> np.uint64(31))
            pos, h = dense[ok], h[ok]
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            hit = hi > lo
            pos, lo, hi = pos[hit], lo[hit], hi[hit]
            if len(pos):
                reps = hi - lo
                row = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(lo, reps)
                p = np.repeat(pos, reps)
                hits.append(np.stack([np.searchsorted(starts, p, side="right") - 1, owner[row], p - at[row]]))  # the place where the item would begin
        if not hits:
            return []
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, begin in np.unique(np.concatenate(hits, axis=1), axis=1).T:
            s = self.seqs[i]
            lo, hi = max(begin, starts[d]), min(begin + len(s), starts[d] + lens[d])
            same = flat[lo:hi] == s[lo - begin : hi - begin]
            run, stretch = longest(same)
            old = out.get((d, i), (0, 0))
            out[d, i] = (max(old[0], run), max(old[1], stretch))
        return [(int(d), int(i), *map(int, v)) for (d, i), v in out.items()]


def longest(same: np.ndarray) -> tuple[int, int]:
    """The longest run of equal words, and the longest stretch, equal at both ends, in which at most one word in TOLERANCE differs."""
    if not same.any():
        return 0, 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    begins, ends = edge[::2], edge[1::2]
    run = int((ends - begins).max())
    stretch = run
    for x in range(len(begins)):  # few runs: an item has some dozens of words
        bad = 0
        for y in range(x + 1, len(begins)):
            bad += begins[y] - ends[y - 1]
            size = ends[y] - begins[x]
            if bad * TOLERANCE <= size:
                stretch = max(stretch, int(size))
    return run, stretch


def number(text: str | None, vocab: dict[str, int]) -> np.ndarray:
    """The words of a text as item word numbers, 0 for a word that no item has."""
    get = vocab.get
    return np.array([get(w, 0) for w in words(text)], dtype=np.int64)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, equal_run, tolerant_run of each document and item that a seed joins."""
    spark = docs.sparkSession
    blocks, size = [[]], 0
    for r in items.select("item_id", "text").filter("text is not null").orderBy("item_id").toLocalIterator():
        size += len(r.text.split())
        if size > MAX_ITEM_WORDS:
            blocks.append([])
            size = len(r.text.split())
        blocks[-1].append((r.item_id, r.text))

    def joined(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # at most MAX_ITEM_WORDS words

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table_ = Items(shared.value)
            _table()
            for b in batches:
                for k in range(0, len(b), 512):
                    part = b.iloc[k : k + 512]
                    found = table_.search([number(t, table_.vocab) for t in part["text"]])
                    ids = part["doc_id"].to_numpy()
                    yield pd.DataFrame({"doc_id": [ids[d] for d, *_ in found], "item_id": [table_.ids[i] for _, i, *_ in found], "equal_run": [x[2] for x in found], "tolerant_run": [x[3] for x in found]})

        return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, item_id bigint, equal_run int, tolerant_run int")

    out = joined(blocks[0])
    for b in blocks[1:]:
        out = out.unionByName(joined(b))
    return out.groupBy("doc_id", "item_id").agg(F.max("equal_run").alias("equal_run"), F.max("tolerant_run").alias("tolerant_run")) if len(blocks) > 1 else out


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a run of at least WINDOW equal words or a stretch of at least 2 WINDOW words with few substitutions."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).filter(f"equal_run >= {WINDOW} or tolerant_run >= {2 * WINDOW}")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).filter(f"equal_run >= {WINDOW}").select("doc_id", "item_id")
