"""Near-equal texts: classes of exact copies, and the seeds by which partners meet without a loss.

Two texts are nearly equal if at most one word in six (of the longer) is added, dropped or changed. A text of n words then
has at most n // 5 edits to any partner, so of n // 5 + 1 stretches that it is cut into, one stands in the partner word for
word and is moved by no more places than there are edits. The first words of each stretch (four, fewer in texts under twenty
words) are its seeds; a partner finds it by looking all its own runs of that length up. Nothing is sampled or left out, so
edits may be spread as they like. Hits whose lengths or places differ by more than the limit go, and so do those whose
signatures show it: a signature holds the parity of the word counts in 128 cells, and an edit changes two cells at most.

A text of fewer than five words is nearly equal to its copies only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import gram_hashes, word_ids

ONE_IN = 6
CELLS, WIDE_CELLS = 128, 512


def most_edits(n: int, m: int | None = None) -> int:
    """Edits that texts of n and m words may have; without m, of n words and any partner."""
    return n // (ONE_IN - 1) if m is None else max(n, m) // ONE_IN


def seed_length(n: int) -> int:
    return n // (n // (ONE_IN - 1) + 1)


def seeds_of(ids: np.ndarray) -> np.ndarray:
    """The seeds of a text in order, as signed 64-bit numbers; seed i of m begins at word i * n // m."""
    n = len(ids)
    if n < ONE_IN - 1:
        return np.zeros(0, np.int64)
    m = most_edits(n) + 1
    return gram_hashes(ids, seed_length(n))[np.arange(m) * n // m].view(np.int64)


def probes_of(ids: np.ndarray) -> list[np.ndarray]:
    """All runs of the lengths that the seeds of possible partners have, one array for each length; a run's place is its index."""
    n = len(ids)
    partners = range(max(ONE_IN - 1, n - n // ONE_IN), n + most_edits(n) + 1) if n < 30 else (n,)  # beyond, all have one length
    return [gram_hashes(ids, q).view(np.int64) for q in sorted({seed_length(m) for m in partners})]


def signature_of(ids: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Parity of the number of words in each of so many cells, as signed 64-bit numbers."""
    cell = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - cells.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=cells) & 1).astype(np.uint8)).view(np.int64)


def word_counts_allow(a: list[bytes], b: list[bytes], cells: int = 1024, at_once: int = 2000) -> np.ndarray:
    """Which pairs of token strings differ by no more words than near-equal texts may: the counts of words in each of so many cells differ by 2 for an edit at most."""
    out = []
    for k in range(0, len(a), at_once):
        x, y = ([np.frombuffer(t, dtype=np.uint32) for t in side[k : k + at_once]] for side in (a, b))
        size = [np.array([len(t) for t in side]) for side in (x, y)]
        count = []
        for side, n in zip((x, y), size):
            cell = (np.concatenate(side).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64) % cells
            count.append(np.bincount(np.repeat(np.arange(len(side)) * cells, n) + cell, minlength=len(side) * cells).reshape(len(side), cells))
        out.append(np.abs(count[0] - count[1]).sum(axis=1) <= 2 * (np.maximum(*size) // ONE_IN))
    return np.concatenate(out) if out else np.zeros(0, dtype=bool)


def with_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the column text by class (128-bit hash of the word sequence), id (its first 64 bits, for narrow rows), n (words), sig0, sig1 (signature), wide (one of WIDE_CELLS cells, for pairs) and tokens (words as 32-bit hashes). A text without any word has a null class."""
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [word_ids(t) for t in b[text]]
            some = [len(x) > 0 for x in ids]
            digest = [xxhash.xxh3_128_digest(x.tobytes()) if s else None for x, s in zip(ids, some)]
            sig = [signature_of(x) for x in ids]
            yield b.drop(columns=[text]).assign(
                **{"class": pd.Series(digest, dtype="object", index=b.index)},
                id=pd.Series([int.from_bytes(d[:8], "little", signed=True) if d else 0 for d in digest], dtype="int64", index=b.index),
                n=pd.Series([len(x) for x in ids], dtype="int32", index=b.index),
                sig0=pd.Series([s[0] for s in sig], dtype="int64", index=b.index),
                sig1=pd.Series([s[1] for s in sig], dtype="int64", index=b.index),
                wide=pd.Series([signature_of(x, WIDE_CELLS) for x in ids], dtype="object", index=b.index),
                tokens=pd.Series([x.tobytes() if s else None for x, s in zip(ids, some)], dtype="object", index=b.index),
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["class binary", "id bigint", "n int", "sig0 bigint", "sig1 bigint", "wide array<bigint>", "tokens binary"])
    return df.mapInPandas(run, schema)


def seed_rows(classes: DataFrame, *keep: str) -> DataFrame:
    """key, pos and the kept columns: a row for each seed of each class (n, tokens, keep)."""
    schema = ", ".join([f"`{c}` {classes.schema[c].dataType.simpleString()}" for c in keep] + ["n int", "seeds array<bigint>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(seeds=[seeds_of(np.frombuffer(t, dtype=np.uint32)) for t in b["tokens"]])[[*keep, "n", "seeds"]]

    x = classes.select(*keep, "n", "tokens").mapInPandas(run, schema).select(*keep, "n", F.size("seeds").alias("_m"), F.posexplode("seeds").alias("_i", "key"))
    return x.select("key", F.expr("cast(_i * n div _m as int)").alias("pos"), "n", *keep)


def probe_rows(classes: DataFrame, *keep: str) -> DataFrame:
    """key, pos and the kept columns: a row for each run that a partner of the class (n, tokens, keep) might have as a seed."""
    schema = ", ".join([f"`{c}` {classes.schema[c].dataType.simpleString()}" for c in keep] + ["n int", "probes array<bigint>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            probes = [probes_of(np.frombuffer(t, dtype=np.uint32)) for t in b["tokens"]]
            out = b[[*keep, "n"]].iloc[np.repeat(np.arange(len(b)), [len(p) for p in probes])]  # a row for each length of runs
            yield out.reset_index(drop=True).assign(probes=pd.Series([g for p in probes for g in p], dtype="object"))

    x = classes.select(*keep, "n", "tokens").mapInPandas(run, schema)
    return x.select(*keep, "n", F.posexplode("probes").alias("pos", "key")).select("key", "pos", "n", *keep)


def possible(a: str, b: str) -> Column:
    """Whether the hit of a seed (columns a.pos, a.n, a.sig0, a.sig1 and the same of b) may belong to a near-equal pair."""
    col = lambda side, name: F.col(f"{side}.{name}")
    most = F.floor(F.greatest(col(a, "n"), col(b, "n")) / ONE_IN)
    apart = F.bit_count(col(a, "sig0").bitwiseXOR(col(b, "sig0"))) + F.bit_count(col(a, "sig1").bitwiseXOR(col(b, "sig1")))
    return (F.abs(col(a, "n") - col(b, "n")) <= most) & (F.abs(col(a, "pos") - col(b, "pos")) <= most) & (apart <= 2 * most)


def wide_possible() -> Column:
    """Whether a pair (n, wide, other_n, other_wide) may be near-equal."""
    apart = F.aggregate(F.zip_with("wide", "other_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return apart <= 2 * F.floor(F.greatest("n", "other_n") / ONE_IN)
