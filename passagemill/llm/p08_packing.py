"""Problem 8: texts of varying token length into containers of fixed capacity.

Method: mixture-controlled packing. The documents are dealt by hash to packers of about PACKER_TOKENS tokens. A packer holds
a queue per source and fills window after window of WINDOW containers by deficit round-robin: each window credits a source
with its target share of the window's tokens, a source gives texts while its deficit covers them, and what is over or under
is carried to the next window. The deficits a packer starts with are those the packers before it leave, computed from token
sums per packer and source, so shares hold across partitions. A window's texts go, largest first, into the open container
that they fill best (best fit); a container is closed when less than a few tokens are left or the packer ends.

A text stays whole unless it alone exceeds the capacity: then it gives full containers and a rest, which is packed like a
text. Null and empty texts have no tokens and take no container. Null sources are one source. Ties go by doc_id.
"""

from __future__ import annotations

import base64
import importlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written

CAPACITY, WINDOW, PACKER_TOKENS = 2048, 32, 4_000_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_ENCODERS: dict[str, object] = {}


def encoder(path: str | None = None):
    """The public byte-level tokenizer; path: its rank file, by default where the installed vocabulary package has it."""
    if path not in _ENCODERS:
        import tiktoken

        public = importlib.import_module("public_tokenizers")
        file = path or public.path(VOCABULARY)
        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of the documents that have tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b["text"]]
            out = b[["doc_id", "source"]].assign(n_tokens=n)
            yield out[out.n_tokens > 0]

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, n_tokens int")


def pack(items: list[tuple[int, str, int]], share: dict[str, float], carry: dict[str, float], capacity: int = CAPACITY, window: int = WINDOW) -> list[tuple]:
    """(container, window, doc_id, piece_no, token_begin, token_end, source) of the items (doc_id, source, tokens) of one packer."""
    queues: dict[str, deque] = defaultdict(deque)
    out, container = [], 0
    for doc, source, n in sorted(items, key=lambda x: (str(x[1]), x[0])):
        queues[source].append((doc, n))
    deficit = {s: carry.get(s, 0.0) for s in queues}
    open_: list[tuple[int, int]] = []  # (room, container), by room
    w = 0
    while queues:
        taken = []
        live = sum(share.get(s, 0.0) for s in queues) or 1.0
        for s in list(queues):
            deficit[s] += capacity * window * share.get(s, 0.0) / live
            q = queues[s]
            while q and q[0][1] <= deficit[s]:
                doc, n = q.popleft()
                deficit[s] -= n
                taken.append((n, doc, s))
            if not q:
                del queues[s]
        parts = []
        for n, doc, s in taken:
            piece = 0
            while n - piece * capacity > capacity:
                out.append((container, w, doc, piece, piece * capacity, (piece + 1) * capacity, s))
                container += 1
                piece += 1
            parts.append((n - piece * capacity, doc, piece, piece * capacity, n, s))
        for size, doc, piece, begin, end, s in sorted(parts, key=lambda x: (-x[0], x[1])):
            k = bisect_left(open_, (size, -1))
            if k < len(open_):
                room, c = open_.pop(k)
            else:
                room, c = capacity, container
                container += 1
            out.append((c, w, doc, piece, begin, end, s))
            if room - size > 3:
                insort(open_, (room - size, c))
        w += 1
    return out


def assignments(spark: SparkSession, sf_dir: str, targets: dict[str, float] | None = None) -> DataFrame:
    """container_id, window_no, doc_id, source, piece_no, token_begin, token_end, n_tokens. targets: token share per source; by default the sources' own shares."""
    sizes = written(token_counts(table(spark, sf_dir, "documents")), "p8-sizes")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    packers = max(1, -(-total // PACKER_TOKENS))
    dealt = sizes.withColumn("packer", F.pmod(F.xxhash64("doc_id"), F.lit(packers)).cast("int"))
    supply = dealt.groupBy("packer", "source").agg(F.sum("n_tokens").alias("tokens"))
    target = F.lit(0.0) if not targets else F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col("source")], F.lit(0.0))
    by_packer, by_source = Window.partitionBy("packer"), Window.partitionBy("source")
    share = (F.sum("tokens").over(by_source) / F.lit(max(1, total))) if targets is None else target
    want = supply.withColumn("share", share).withColumn("lack", F.col("share") * F.sum("tokens").over(by_packer) - F.col("tokens"))
    # what the packers before lacked of a source is this packer's first credit
    want = want.withColumn("carry", F.coalesce(F.sum("lack").over(by_source.orderBy("packer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = dealt.select("packer", "source", "doc_id", "n_tokens", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("carry"))
    rows = rows.unionByName(want.select("packer", "source", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("n_tokens"), "share", "carry"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["source"] = pdf["source"].where(pdf["source"].notna(), None)
        head, items = pdf[pdf.share.notna()], pdf[pdf.doc_id.notna()]
        shares, carry = dict(zip(head["source"], head["share"])), dict(zip(head["source"], head["carry"]))
        if not sum(shares.values()):
            shares = {s: 1.0 for s in shares}
        shares = {s: max(v, 1e-9) for s, v in shares.items()}
        rows = pack(list(zip(items["doc_id"].astype("int64").tolist(), items["source"], items["n_tokens"].astype("int64").tolist())), shares, carry)
        out = pd.DataFrame(rows, columns=["container", "window_no", "doc_id", "piece_no", "token_begin", "token_end", "source"])
        out["container_id"] = f"{int(pdf['packer'].iloc[0])}-" + out["container"].astype(str)
        out["n_tokens"] = out["token_end"] - out["token_begin"]
        return out[["container_id", "window_no", "doc_id", "source", "piece_no", "token_begin", "token_end", "n_tokens"]]

    return rows.groupBy("packer").applyInPandas(run, "container_id string, window_no int, doc_id bigint, source string, piece_no int, token_begin int, token_end int, n_tokens int")


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of capacity used, per packer."""
    c = assignments(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return c.groupBy(F.split_part("container_id", F.lit("-"), F.lit(1)).cast("int").alias("packer")).agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"), F.round(F.sum("tokens") / (F.count("*") * CAPACITY), 6).alias("used")
    )


def equal_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packer, window_no, source, tokens, share: what each window holds of each source if all sources are to have equal shares, whatever their supply. Sources that run out leave their share to the others."""
    names = [r.source for r in table(spark, sf_dir, "documents").filter("source is not null").select("source").distinct().collect()]  # as many as the mixture has entries
    a = assignments(spark, sf_dir, {s: 1.0 / len(names) for s in names})
    x = a.groupBy(F.split_part("container_id", F.lit("-"), F.lit(1)).cast("int").alias("packer"), "window_no", "source").agg(F.sum("n_tokens").alias("tokens"))
    return x.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy("packer", "window_no")), 6))
