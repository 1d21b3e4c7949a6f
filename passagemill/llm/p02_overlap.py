"""Problem 2: records of the validation split and evaluation candidates that the training split repeats, exactly or almost.

Method: compressed full-text index of evaluation shards. The evaluation texts, one for each class of copies, are dealt by
hash to shards of about SHARD_WORDS words. A shard's index is a compressed suffix array: the successor of each row of the
suffix array as differences within a word's rows, and every SAMPLE-th position; the texts themselves are read back from it.
Training texts stream through the shards, all positions of a part stepping through backward search together. Of the
l - SEED + 1 runs of SEED words in a training text of l words an edit spoils SEED at most, and there are at most l // 5 edits:
so a partner holds at least one of any SEED * (l // 5) + 1 of them, those that the shard holds least often are located, and a
text with more runs than that which the shard lacks has no partner. Lengths, places and signatures (near.py) sift the hits, edit distance over words
decides. For the pairs that are left all runs are located and merge along diagonals into maximal matches, whose spans are
counted. Exact copies are pairs like others, without edits.

With more than ROUTED shards a training text streams only through those that hold one of its seeds (near.py).

Null texts and texts without a word are equal to nothing; a null split is neither training nor validation. Other columns
of the input are not read, so clashing names do no harm.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from .near import most_edits, probe_rows, seed_rows, signature_of, with_classes
from .words import edit_distance_within

SEED, SAMPLE = 3, 16
SHARD_WORDS, ROUTED = 4_000_000, 8
#: A part of the training texts that one task streams through one shard: so many words, fewer while there are cores without work.
PART_WORDS, LEAST_PART = 16_000_000, 250_000
STREAM_WORDS, LOCATE_AT_ONCE = 300_000, 2_000_000


def canonical_split(c):
    """train, validation or test for the spellings of a split; null where it is null or none of them."""
    x = F.lower(F.trim(c))
    return F.when(x.isin("train", "training", "trn"), "train").when(x.isin("validation", "valid", "val", "dev"), "validation").when(x.isin("test", "tst"), "test")


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(s)
    rank, k = s.astype(np.int64), 1
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        k *= 2
        if rank[sa[-1]] == n - 1 or k >= n:
            return sa


class FullTextIndex:
    """Compressed suffix array over the concatenated texts of an evaluation shard, each ended by symbol 0."""

    def __init__(self, lens: np.ndarray, symbols: np.ndarray, counts: np.ndarray, psi: np.ndarray, sampled: np.ndarray):
        self.lens, self.symbols, self.counts, self.sampled = lens, symbols, counts, sampled
        self.n = n = len(psi)
        self.starts = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        # rows are in order of (first symbol, successor), so a row is found by a search among these
        self.keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * (n + 1) + psi
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.at = np.full(n, -1, dtype=np.int32)
        self.at[sampled] = np.arange(len(sampled), dtype=np.int32)

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> FullTextIndex:
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        symbols = np.unique(np.concatenate(texts))
        s = np.zeros(int((lens + 1).sum()), dtype=np.int64)
        for at, t in zip(np.concatenate([[0], np.cumsum(lens + 1)]), texts):
            s[at : at + len(t)] = np.searchsorted(symbols, t) + 1
        sa = suffix_order(s)
        row_of = np.empty(len(s), dtype=np.int64)
        row_of[sa] = np.arange(len(s))
        return cls(lens, symbols, np.bincount(s, minlength=len(symbols) + 1), row_of[(sa + 1) % len(s)], row_of[::SAMPLE])

    def to_bytes(self) -> bytes:
        psi = self.keys % (self.n + 1)
        step = np.diff(psi, prepend=0).astype(np.int32)
        planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T)
        parts = (self.lens.astype(np.int32), self.symbols, self.counts.astype(np.int32), planes, self.sampled.astype(np.int32))
        return zstandard.compress(pickle.dumps(parts, protocol=5), 3)

    @classmethod
    def from_bytes(cls, blob: bytes) -> FullTextIndex:
        lens, symbols, counts, planes, sampled = pickle.loads(zstandard.decompress(blob))
        psi = np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int64)
        return cls(lens.astype(np.int64), symbols, counts.astype(np.int64), psi, sampled.astype(np.int64))

    def code(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 for a word the shard doesn't hold."""
        i = np.minimum(np.searchsorted(self.symbols, words), len(self.symbols) - 1)
        return np.where(self.symbols[i] == words, i + 1, -1)

    def runs(self, coded: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts in coded of runs of that length which the shard holds, with their rows lo to hi - 1."""
        known = np.concatenate([[0], np.cumsum(coded > 0)])
        begin = np.flatnonzero(known[length:] - known[:-length] == length) if len(coded) >= length else np.zeros(0, np.int64)
        sym = coded[begin + length - 1]
        lo, hi = self.first[sym], self.first[sym + 1]
        for step in range(length - 2, -1, -1):
            key = coded[begin + step] * (self.n + 1)
            lo, hi = np.searchsorted(self.keys, key + lo), np.searchsorted(self.keys, key + hi)
            ok = hi > lo
            begin, lo, hi = begin[ok], lo[ok], hi[ok]
        return begin, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of rows: forward to the next sampled position."""
        out, left, row = np.empty(len(row), dtype=np.int64), np.arange(len(row)), row.copy()
        for step in range(SAMPLE):
            k = self.at[row]
            hit = k >= 0
            out[left[hit]] = (k[hit].astype(np.int64) * SAMPLE - step) % self.n
            left, row = left[~hit], self.keys[row[~hit]] % (self.n + 1)
        return out

    def texts(self, which: np.ndarray) -> list[np.ndarray]:
        """The words of some texts."""
        start, size = self.starts[which], self.lens[which]
        skip = start % SAMPLE
        row, upto = self.sampled[start // SAMPLE], skip + size
        out = [np.empty(k, dtype=np.uint32) for k in size]
        live = np.arange(len(which))
        for step in range(int(upto.max()) if len(which) else 0):
            live = live[upto[live] > step]
            key = self.keys[row[live]]
            for i, c, past in zip(live, key // (self.n + 1), step - skip[live]):
                if past >= 0:
                    out[i][past] = self.symbols[c - 1]
            row[live] = key % (self.n + 1)
        return out


class Stream:
    """Training texts of a part on their way through an index."""

    def __init__(self, index: FullTextIndex, signatures: np.ndarray):
        self.index, self.signatures = index, signatures

    def hits(self, begin, lo, hi, starts) -> pd.DataFrame:
        """q, t, shift, at of the located occurrences of runs: the place in the query less that in the text."""
        reps = hi - lo
        row = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(lo, reps)
        where = self.index.locate(row)
        q = np.searchsorted(starts, begin, side="right") - 1
        t = np.searchsorted(self.index.starts, where, side="right") - 1
        at = where - self.index.starts[t]
        return pd.DataFrame({"q": np.repeat(q, reps), "t": t, "shift": np.repeat(begin - starts[q], reps) - at, "at": at})

    @staticmethod
    def chunks(reps: np.ndarray, owner: np.ndarray):
        """Ranges whose repeats sum to about LOCATE_AT_ONCE; the runs of a query stay together."""
        size = np.cumsum(reps)
        cuts = np.searchsorted(size, np.arange(LOCATE_AT_ONCE, int(size[-1]), LOCATE_AT_ONCE)) if len(size) else []
        edges = [0, *sorted({int(np.searchsorted(owner, owner[c])) for c in cuts} - {0}), len(reps)]
        return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]

    def pairs(self, queries: list[np.ndarray]) -> pd.DataFrame:
        """q, t, edits, spans, covered, longest of the nearly equal pairs of a query and a text."""
        ix = self.index
        lens = np.array([len(q) for q in queries], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        coded = np.full(int((lens + 1).sum()), -1, dtype=np.int64)
        whole = np.concatenate([np.append(q, np.uint32(0)) for q in queries])
        coded[:] = ix.code(whole)
        coded[starts + lens] = -1
        begin, lo, hi = ix.runs(coded, SEED)
        owner = np.searchsorted(starts, begin, side="right") - 1
        # the rarest runs first; those the shard lacks are the rarest of all
        order = np.lexsort((hi - lo, owner))
        held = np.bincount(owner, minlength=len(lens))
        nth = np.empty(len(order), dtype=np.int64)
        nth[order] = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        lacked = np.maximum(lens - SEED + 1, 0) - held
        keep = nth + lacked[owner] < SEED * (lens[owner] // 5) + 1
        found = [self.sifted(self.hits(begin[keep][a:b], lo[keep][a:b], hi[keep][a:b], starts), lens, queries) for a, b in self.chunks((hi - lo)[keep], owner[keep])]
        for length in range(1, SEED):  # so short a text has copies only
            b0, l0, h0 = ix.runs(coded, length)
            mine = np.searchsorted(starts, b0, side="right") - 1
            ok = lens[mine] == length
            found.append(self.sifted(self.hits(b0[ok], l0[ok], h0[ok], starts), lens, queries))
        close = pd.concat(found) if found else pd.DataFrame({"q": [], "t": []}, dtype=np.int64)
        texts = dict(zip(some := np.unique(close["t"].to_numpy(dtype=np.int64)), ix.texts(some)))
        rows = []
        for q, t in close.itertuples(index=False):
            most = most_edits(int(lens[q]), int(ix.lens[t]))
            e = edit_distance_within(texts[t], queries[q], most)
            if e <= most:
                rows.append((q, t, e))
        out = pd.DataFrame(rows, columns=["q", "t", "edits"], dtype=np.int64)
        return out.merge(self.matches(begin, lo, hi, owner, starts, out), on=["q", "t"], how="left").fillna({"spans": 1, "covered": pd.Series(lens[out["q"].to_numpy()], index=out.index), "longest": pd.Series(lens[out["q"].to_numpy()], index=out.index)}) if len(out) else out.assign(spans=0, covered=0, longest=0)

    def sifted(self, h: pd.DataFrame, lens: np.ndarray, queries: list[np.ndarray]) -> pd.DataFrame:
        """q, t of hits that lengths, places and signatures allow."""
        q, t = h["q"].to_numpy(), h["t"].to_numpy()
        a, b = lens[q], self.index.lens[t]
        most = np.maximum(a, b) // 6
        h = h[(np.abs(a - b) <= most) & (np.abs(h["shift"].to_numpy()) <= most)][["q", "t"]].drop_duplicates()
        q, t = h["q"].to_numpy(), h["t"].to_numpy()
        some = np.unique(q)
        mine = np.array([signature_of(queries[i]) for i in some], dtype=np.int64).reshape(-1, 2)[np.searchsorted(some, q)]
        apart = np.bitwise_count((mine ^ self.signatures[t]).view(np.uint64)).sum(axis=1)
        return h[apart <= 2 * (np.maximum(lens[q], self.index.lens[t]) // 6)]

    def matches(self, begin, lo, hi, owner, starts, pairs: pd.DataFrame) -> pd.DataFrame:
        """q, t, spans, covered, longest: maximal matches of at least SEED words of the given pairs."""
        ok = np.isin(owner, pairs["q"].to_numpy())
        begin, lo, hi, owner = begin[ok], lo[ok], hi[ok], owner[ok]
        out = []
        for a, b in self.chunks(hi - lo, owner):
            h = self.hits(begin[a:b], lo[a:b], hi[a:b], starts).merge(pairs[["q", "t"]], on=["q", "t"]).sort_values(["q", "t", "shift", "at"])
            q, t, shift, at = (h[c].to_numpy() for c in ("q", "t", "shift", "at"))
            if len(h):
                fresh = np.ones(len(h), dtype=bool)
                fresh[1:] = (q[1:] != q[:-1]) | (t[1:] != t[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + 1)
                head = np.flatnonzero(fresh)
                size = np.diff(np.append(head, len(h)))
                out.append(merged_spans(q[head], t[head], at[head], at[head] + size + SEED - 1))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "t": [], "spans": [], "covered": [], "longest": []}, dtype=np.int64)


def merged_spans(q, t, begin, end) -> pd.DataFrame:
    """Spans of a text that overlap or touch become one."""
    order = np.lexsort((begin, t, q))
    q, t, begin, end = q[order], t[order], begin[order], end[order]
    rows: dict[tuple, list] = {}
    for i, j, a, b in zip(q, t, begin, end):
        spans = rows.setdefault((i, j), [])
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return pd.DataFrame([(*k, len(v), sum(b - a for a, b in v), max(b - a for a, b in v)) for k, v in rows.items()], columns=["q", "t", "spans", "covered", "longest"])


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """The index of a shard with the classes and signatures of its texts."""
    blob = FullTextIndex.of([np.frombuffer(x, dtype=np.uint32) for x in pdf["tokens"]]).to_bytes()
    names = pickle.dumps((pdf["class"].tolist(), pdf[["sig0", "sig1"]].to_numpy(dtype=np.int64)))
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "blob": [blob], "names": [names]})


def search_part(key: tuple, index: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a part of the training classes with the texts of a shard."""
    out = [pd.DataFrame({"class": [], "partner": [], "edits": [], "spans": [], "covered": [], "longest": []})]
    if len(index) and len(train):
        names, signatures = pickle.loads(index["names"].iloc[0])
        stream = Stream(FullTextIndex.from_bytes(index["blob"].iloc[0]), signatures)
        ids = [np.frombuffer(x, dtype=np.uint32) for x in train["tokens"]]
        at = np.cumsum([len(x) for x in ids]) // STREAM_WORDS
        for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(at)) + 1):
            p = stream.pairs([ids[i] for i in part])
            partner = train["class"].iloc[part].tolist()
            out.append(p.assign(**{"class": [names[t] for t in p["t"]], "partner": [partner[q] for q in p["q"]]})[["class", "partner", "edits", "spans", "covered", "longest"]])
    return pd.concat([x for x in out if len(x)] or out[:1])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eval_kind, eval_id, item_position, split, source_shard, text of all texts that take part."""
    o = table(spark, sf_dir, "passage_occurrence").select(
        F.lit("occurrence").alias("eval_kind"), F.col("occurrence_id").alias("eval_id"), F.col("passage_position").alias("item_position"), canonical_split(F.col("split")).alias("split"), "source_shard", F.col("raw_text").alias("text")
    )
    e = table(spark, sf_dir, "eval_example").select("query_id", F.posexplode("candidates_en").alias("item_position", "text"))
    e = e.select(F.lit("candidate").alias("eval_kind"), F.col("query_id").alias("eval_id"), "item_position", F.lit("candidate").alias("split"), F.lit(None).cast("string").alias("source_shard"), "text")
    return o.filter(F.col("split").isin("train", "validation")).unionByName(e)


def overlaps(rows: DataFrame, shard_words: int = SHARD_WORDS, routed: int = ROUTED) -> tuple[DataFrame, DataFrame]:
    """The rows with their class, and the links class (of evaluation rows), partner (of training rows), edits, spans, covered, longest: every nearly equal pair of classes."""
    spark = rows.sparkSession
    rows = written(with_classes(rows).filter("class is not null").drop("wide"), "p2-rows")
    train, ev = F.col("split") == "train", F.col("split") != "train"
    classes = rows.groupBy("class").agg(F.bool_or(train).alias("in_train"), F.bool_or(ev).alias("in_eval"), *[F.first(c).alias(c) for c in ("id", "n", "sig0", "sig1", "tokens")])
    classes = written(classes, "p2-classes")
    words = classes.agg(F.sum(F.when(F.col("in_eval"), F.col("n"))), F.sum(F.when(F.col("in_train"), F.col("n")))).first()
    shards = max(1, -(-(words[0] or 0) // shard_words))
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-(words[1] or 0) // PART_WORDS), min(cores, -(-(words[1] or 0) // LEAST_PART)))
    dealt = classes.filter("in_eval").withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int"))
    index = written(dealt.groupBy("shard").applyInPandas(build_shard, "shard int, blob binary, names binary"), "p2-index")
    train_rows = classes.filter("in_train").select("class", "id", "n", "tokens")
    if shards > routed:
        seeds = seed_rows(dealt, "shard").groupBy("key", "shard").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
        most = F.floor(F.col("n") / 5)
        near = (F.col("n1") >= F.col("n") - F.floor(F.col("n") / 6)) & (F.col("n0") <= F.col("n") + most) & (F.col("p1") >= F.col("pos") - most) & (F.col("p0") <= F.col("pos") + most)
        to = probe_rows(train_rows, "id").join(seeds, "key").filter(near).select("id", "shard").distinct()
        short = train_rows.filter("n < 5").select("id", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))  # no seeds; their copies may lie anywhere
        to = to.unionByName(short)
        sent = train_rows.join(to, "id")
    else:
        sent = train_rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sent = sent.select("shard", F.pmod(F.xxhash64("class", F.lit(1)), F.lit(parts)).cast("int").alias("part"), "class", "tokens")
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    links = copies.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInPandas(search_part, "class binary, partner binary, edits int, spans int, covered int, longest int")
    return rows.drop("tokens", "sig0", "sig1"), written(links, "p2-links")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pairs = overlaps(texts(spark, sf_dir))
    hit = rows.filter("split <> 'train'").join(pairs.select("class").distinct(), "class")
    return hit.select("eval_kind", F.col("eval_id").cast("bigint").alias("eval_id"), F.col("item_position").cast("int").alias("item_position")).distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of an evaluation text and a training text that repeats it: class, partner (hexadecimal), eval_rows and train_rows that have them, edits, and the spans, words covered and longest span of their maximal matches."""
    rows, pairs = overlaps(texts(spark, sf_dir))
    n = rows.groupBy("class").agg(F.count_if(F.col("split") != "train").alias("eval_rows"), F.count_if(F.col("split") == "train").alias("train_rows"))
    x = pairs.join(n.select("class", "eval_rows"), "class").join(n.select(F.col("class").alias("partner"), "train_rows"), "partner")
    return x.select(F.hex("class").alias("class"), F.hex("partner").alias("partner"), "eval_rows", "train_rows", "edits", "spans", "covered", "longest")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split and source_shard, of the training split too: all, and those that have an exact, or no exact but a near, partner on the other side."""
    all_rows = texts(spark, sf_dir)
    rows, pairs = overlaps(all_rows)
    ends = pairs.select(F.lit(False).alias("is_train"), "class", "edits").unionByName(pairs.select(F.lit(True).alias("is_train"), F.col("partner").alias("class"), "edits"))
    ends = ends.groupBy("is_train", "class").agg(F.min("edits").alias("edits"))
    place = ["eval_kind", "eval_id", "item_position", "split", "source_shard"]
    hit = rows.withColumn("is_train", F.col("split") == "train").join(ends, ["is_train", "class"]).select(*place, F.when(F.col("edits") == 0, "exact").otherwise("near").alias("kind"))
    every = all_rows.select(*place, F.lit(None).cast("string").alias("kind")).unionByName(hit).groupBy(*place).agg(F.min("kind").alias("kind"))
    return every.groupBy("split", "source_shard").agg(F.count("*").alias("rows_all"), F.count_if(F.col("kind") == "exact").alias("rows_exact"), F.count_if(F.col("kind") == "near").alias("rows_near"))
