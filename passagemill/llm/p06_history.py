"""Problem 6: new batches against everything accepted before.

Method: incremental record linkage over persisted tables (History). A class is a word sequence with all its copies, known by
its earliest row; its blocking keys are the seeds of near.py. A batch probes the key table with the runs of its own texts;
hits that lengths, places and word counts allow get a score from agreement fields with learned weights (logistic regression on a bounded sample
of at most SAMPLE_TEXTS texts and edited copies of them). A pair scoring below the least that a pair within the limit can
score, computed from the weights and the lengths, is none; the others are verified by edit distance over words. Then the
batch's new classes and keys are appended, and its links update the mapping of classes to representatives by union-find:
only clusters that a link touches get new rows.

The tables lie under one path and may be opened again by another session. Classes are bucketed by id and keys by key, so a
batch shuffles itself and scans, but neither shuffles nor tokenizes again, what is accepted. Rows of a batch are pending until its commit
is written; what a crashed attempt left is never read. Batches must be accepted in ascending order.

Rows without a batch number belong to no batch and give no row. Null and wordless texts repeat nothing by text; their hash
may still be known. A null first_passage_id in seen_hashes names no passage and is passed over. A seen hash whose passage_id
a table holds adds nothing to the text comparison.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import delete_on_exit, exists, scratch_dir, table, written
from .near import ONE_IN, most_edits, possible, probe_rows, seed_rows, wide_possible, with_classes, word_counts_allow
from .words import edit_distance_within, gram_hashes

SAMPLE_TEXTS = 300
BUCKETS = 24
#: The most held keys, at most HOT_KEYS of those that more than HOT_ROWS classes hold, are hot: what holds them meets in cells of HOT_ROWS rows. Others meet in one task each.
HOT_ROWS, HOT_KEYS = 2000, 10_000
#: Links of a batch whose clusters one task joins; beyond, joins do.
LINKS_AT_ONCE = 1_000_000


def normal_hash(text: str | None) -> str | None:
    """SHA-256 of the text in form NFC with white space collapsed, as content_hash has it."""
    return None if text is None else hashlib.sha256(re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip().encode()).hexdigest()


@F.pandas_udf(StringType())
def recomputed_hash(text: pd.Series) -> pd.Series:
    return text.map(normal_hash)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two multisets."""
    return (Counter(a.tolist()) & Counter(b.tolist())).total()


def fields(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Agreement of two word sequences: words, pairs of words, length, beginning and end."""
    la, lb = len(a), len(b)
    words, pairs = shared(a, b), shared(gram_hashes(a, 2), gram_hashes(b, 2))
    ends = min(la, lb) >= 3
    return [1.0, words / (la + lb - words), pairs / max(1, la + lb - 2 - pairs), abs(la - lb) / max(la, lb), float(ends and bool((a[:3] == b[:3]).all())), float(ends and bool((a[-3:] == b[-3:]).all()))]


def least_score(w: np.ndarray, la: int, lb: int) -> float:
    """The lowest score of a pair of these lengths within the limit: an edit costs at most one common word and two common pairs of words. Holds as the weights of agreement are not negative."""
    n, most = max(la, lb), most_edits(la, lb)
    words, pairs = n - most, max(0, n - 1 - 2 * most)
    return float(w @ np.array([1.0, words / (la + lb - words), pairs / max(1, la + lb - 2 - pairs), abs(la - lb) / n, 0.0, 0.0])) - 1e-9


def learned_weights(texts: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """Weights of the fields from texts and edited copies: up to one edit in six is a match, one in four or another text none. Agreement never weighs against a match."""
    r = np.random.default_rng(seed)
    texts = [t for t in texts if len(t) >= 6]
    if len(texts) < 20:
        return np.array([-6.0, 6.0, 6.0, -6.0, 0.5, 0.5])

    def edited(t: np.ndarray, share: float) -> np.ndarray:
        out = list(t)
        for _ in range(max(1, int(len(t) * share))):
            k, what = int(r.integers(len(out))), int(r.integers(3))
            if what == 0 and len(out) > 3:
                out.pop(k)
            else:
                out[k : k + (what == 1)] = [int(r.integers(1 << 32))]
        return np.array(out, dtype=np.uint32)

    x, y = [], []
    for i, t in enumerate(texts):
        for share, match in ((r.uniform(0, 1 / ONE_IN), 1), (1 / ONE_IN, 1), (r.uniform(0.3, 0.7), 0)):
            x.append(fields(t, edited(t, share)))
            y.append(match)
        x.append(fields(t, texts[(i + 1) % len(texts)]))
        y.append(0)
    x, y, w = np.array(x), np.array(y), np.zeros(6)
    for _ in range(60):  # Newton steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(6), x.T @ (y - p) - 0.05 * w)
    w[[1, 2, 4, 5]] = np.maximum(w[[1, 2, 4, 5]], 0.0)
    w[3] = min(w[3], 0.0)
    return w


def verified(pairs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Of pairs with tokens and other_tokens those that are nearly equal, with edits and score in place of the tokens."""
    rest = [f for f in pairs.schema.fields if f.name not in ("tokens", "other_tokens")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p[word_counts_allow(p["tokens"].tolist(), p["other_tokens"].tolist())]
            edits, score = [], []
            for x, y in zip(p["tokens"], p["other_tokens"]):
                a, b = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                most, s = most_edits(len(a), len(b)), float(weights @ np.array(fields(a, b)))
                edits.append(edit_distance_within(a, b, most) if s >= least_score(weights, len(a), len(b)) else most + 1)
                edits[-1] = edits[-1] if edits[-1] <= most else -1
                score.append(s)
            out = p.drop(columns=["tokens", "other_tokens"]).assign(edits=pd.Series(edits, dtype="int32", index=p.index), score=pd.Series(score, dtype="float64", index=p.index))
            yield out[out.edits >= 0]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["edits int", "score double"])
    return pairs.mapInPandas(run, schema)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """class, top: the least first of its component. edges: class, partner, both ways; nodes: class, first (a struct that ends in the class)."""
    label = nodes.select("class", F.col("first").alias("top"))
    while True:  # each label becomes the least of its neighbours' and then that of the class it names
        near = edges.join(label.select(F.col("class").alias("partner"), F.col("top").alias("seen")), "partner").groupBy("class").agg(F.min("seen").alias("seen"))
        hooked = written(label.join(near, "class").select("class", F.least("top", "seen").alias("top"), (F.col("seen") < F.col("top")).alias("changed")), "p6-labels")
        if hooked.filter("changed").isEmpty():
            return hooked.select("class", "top")
        label = written(hooked.select("class", F.col("top.class").alias("mid")).join(hooked.select(F.col("class").alias("mid"), "top"), "mid").select("class", "top"), "p6-labels")


class History:
    """The accepted passages under a path: classes, keys, parents, commits, and the weights of the score."""

    CLASSES = "class binary, id bigint, n int, first_batch int, first_occurrence bigint, first_passage string, wide array<bigint>, tokens binary, attempt bigint"
    KEYS = "key bigint, pos int, n int, id bigint, sig0 bigint, sig1 bigint, attempt bigint"
    PARENTS = "class binary, parent struct<first_batch: int, first_occurrence: bigint, class: binary>, batch int, attempt bigint"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        if exists(spark, f"{self.path}/layout"):
            buckets = spark.read.schema("buckets int").parquet(f"{self.path}/layout").first()[0]
        else:
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.path}/layout")
        self.buckets = buckets
        self.names = {}
        for name, columns, by in (("classes", self.CLASSES, "id"), ("keys", self.KEYS, "key")):
            self.names[name] = f"passagemill_{name}_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {self.names[name]} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        done = spark.read.schema("batch int, attempt bigint").parquet(f"{self.path}/commits").collect() if exists(spark, f"{self.path}/commits") else []
        self.attempts = {r.attempt: r.batch for r in done}  # one for each batch

    def close(self) -> None:
        """Forget the tables' names; what is stored stays."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def read(self, name: str, also: int | None = None) -> DataFrame:
        """A table's committed rows, and those of one pending attempt."""
        if name in self.names:
            self.spark.catalog.refreshTable(self.names[name])
            df = self.spark.table(self.names[name])
        elif exists(self.spark, f"{self.path}/{name}"):
            df = self.spark.read.schema(self.PARENTS).parquet(f"{self.path}/{name}")
        else:
            return self.spark.createDataFrame([], self.PARENTS)
        return df.filter(F.col("attempt").isin([*self.attempts, *([] if also is None else [also])]))

    def weights(self, classes: DataFrame) -> np.ndarray:
        """The stored weights; at first they are learned from a sample of the classes at hand."""
        where = f"{self.path}/weights"
        if not exists(self.spark, where):
            sample = classes.select("tokens").orderBy(F.xxhash64("class")).limit(SAMPLE_TEXTS).collect()
            w = learned_weights([np.frombuffer(r.tokens, dtype=np.uint32) for r in sample])
            self.spark.createDataFrame([(w.tolist(),)], "w array<double>").coalesce(1).write.mode("overwrite").parquet(where)
        return np.array(self.spark.read.schema("w array<double>").parquet(where).first()[0])

    def _append(self, name: str, df: DataFrame, by: str, attempt: int) -> None:
        columns = [c.split()[0] for c in (self.CLASSES if name == "classes" else self.KEYS).split(", ")]
        df.select(*columns[:-1]).repartition(self.buckets, by).withColumn("attempt", F.lit(attempt).cast("bigint")).write.insertInto(self.names[name])

    def candidates(self, classes: DataFrame, attempt: int) -> DataFrame:
        """id, other: ids of classes of a batch and of accepted ones, the batch's own among them, that share a seed and may be near-equal."""
        keys = self.read("keys", attempt)
        probes = probe_rows(classes, "id", "sig0", "sig1")
        most = keys.groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > HOT_ROWS).orderBy(F.desc("held"), "key").limit(HOT_KEYS).collect()
        some_hot = len(most) > 0
        hot = self.spark.createDataFrame(most, "key bigint, held bigint")
        pair = (F.col("p.id") != F.col("k.id")) & ((F.col("k.attempt") != attempt) | (F.col("p.id") < F.col("k.id"))) & possible("p", "k")
        cold = lambda x: x.join(F.broadcast(hot), "key", "left_anti") if some_hot else x
        out = cold(probes).alias("p").join(cold(keys).alias("k"), F.col("p.key") == F.col("k.key")).filter(pair).select(F.col("p.id").alias("id"), F.col("k.id").alias("other"))
        if some_hot:
            cells = F.ceil(F.col("held") / HOT_ROWS).cast("int")
            k = keys.join(F.broadcast(hot), "key").withColumn("cell", F.pmod(F.xxhash64("id"), cells).cast("int"))
            p = probes.join(F.broadcast(hot), "key").withColumn("cell", F.explode(F.sequence(F.lit(0), cells - 1)))
            on = (F.col("p.key") == F.col("k.key")) & (F.col("p.cell") == F.col("k.cell"))
            out = out.unionByName(p.alias("p").join(k.alias("k"), on).filter(pair).select(F.col("p.id").alias("id"), F.col("k.id").alias("other")))
        return out.distinct()

    def accept(self, rows: DataFrame, batch: int, link: bool = True) -> DataFrame:
        """Take a batch (occurrence_id, passage_id, hash and text, or what with_classes makes of it) and return occurrence_id, hash, class, m of its rows: m (batch, occurrence, passage, kind, score) is the earliest row of a lower batch with an equal or nearly equal text, null if there is none.

        link=False is for a history that is accepted as it is: its rows are not compared with each other.
        """
        attempt = uuid.uuid4().int >> 65
        rows = rows if "tokens" in rows.columns else written(with_classes(rows), "p6-rows")
        one = rows.filter("class is not null").groupBy("class").agg(F.min(F.struct("occurrence_id", "passage_id")).alias("f"), *[F.first(c).alias(c) for c in ("id", "n", "sig0", "sig1", "wide", "tokens")])
        stored = self.read("classes").select(F.col("class").alias("_c"), "id", "first_batch", "first_occurrence", "first_passage")
        known = one.select("class", "id").join(stored, "id").filter(F.col("class") == F.col("_c")).drop("_c", "id")
        one = one.join(known, "class", "left")
        is_new = F.col("first_batch").isNull()
        one = one.select("class", "id", "n", "sig0", "sig1", "wide", "tokens", is_new.alias("is_new"), F.coalesce("first_batch", F.lit(batch)).alias("first_batch"), F.when(is_new, F.col("f.occurrence_id")).otherwise(F.col("first_occurrence")).alias("first_occurrence"), F.when(is_new, F.col("f.passage_id")).otherwise(F.col("first_passage")).alias("first_passage"))
        one = written(one, "p6-classes")
        new = one.filter("is_new")
        with ThreadPoolExecutor(2) as both:
            jobs = [both.submit(self._append, "classes", new, "id", attempt), both.submit(self._append, "keys", seed_rows(new, "id", "sig0", "sig1"), "key", attempt)]
            for j in jobs:
                j.result()
        exact = one.filter(~F.col("is_new")).select("class", F.struct(F.col("first_batch").alias("batch"), F.col("first_occurrence").alias("occurrence"), F.col("first_passage").alias("passage"), F.lit("exact").alias("kind"), F.lit(None).cast("double").alias("score")).alias("m"))
        matches = exact
        if link:
            near = self.links(one, attempt)
            self._merge(near, batch, attempt)
            close = near.filter(F.col("other_batch") < batch).select("class", F.struct(F.col("other_batch").alias("batch"), F.col("other_occurrence").alias("occurrence"), F.col("other_passage").alias("passage"), F.lit("near").alias("kind"), "score").alias("m"))
            matches = exact.unionByName(close).groupBy("class").agg(F.min_by("m", F.struct("m.batch", "m.occurrence")).alias("m"))
        self.spark.createDataFrame([(batch, attempt)], "batch int, attempt bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.attempts[attempt] = batch
        return rows.select("occurrence_id", "hash", "class").join(written(matches, "p6-matches"), "class", "left")

    def links(self, one: DataFrame, attempt: int) -> DataFrame:
        """Verified near-equal pairs of classes of a batch with accepted ones, of two of the batch once: class, first_batch, first_occurrence, other_class, other_batch, other_occurrence, other_passage, edits, score."""
        stored = self.read("classes", attempt)
        pairs = self.candidates(one, attempt).join(one.select("id", "n", "wide"), "id").join(stored.select(F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("wide").alias("other_wide")), "other")
        pairs = written(pairs.filter(wide_possible()).select("id", "other"), "p6-pairs")  # few: they are broadcast, and no tokens are shuffled
        mine = one.select("id", "class", "tokens", "first_batch", "first_occurrence")
        theirs = stored.select(F.col("id").alias("other"), F.col("class").alias("other_class"), F.col("tokens").alias("other_tokens"), F.col("first_batch").alias("other_batch"), F.col("first_occurrence").alias("other_occurrence"), F.col("first_passage").alias("other_passage"))
        return written(verified(pairs.join(mine, "id").join(theirs, "other").drop("id", "other"), self.weights(one)), "p6-links")

    def parents(self) -> DataFrame:
        """class, parent: the newest row of each class that a link ever joined to another; its parent is the root of its cluster."""
        return self.read("parents").groupBy("class").agg(F.max_by("parent", "batch").alias("parent"))

    def roots(self, nodes: DataFrame) -> DataFrame:
        """class, root (first_batch, first_occurrence, class) of nodes (class, first)."""
        return nodes.join(self.parents(), "class", "left").select("class", F.coalesce("parent", "first").alias("root"))

    def _merge(self, near: DataFrame, batch: int, attempt: int) -> None:
        """Union-find: clusters that links join get the earliest of their roots, and each member of a cluster whose root changed gets a row, so that one look finds a root."""
        first = lambda b, o, c: F.struct(F.col(b).alias("first_batch"), F.col(o).alias("first_occurrence"), F.col(c).alias("class"))
        of = self.parents()
        parent_of = lambda c, name: of.select(F.col("class").alias(c), F.col("parent").alias(name))
        e = near.select("class", first("first_batch", "first_occurrence", "class").alias("a"), "other_class", first("other_batch", "other_occurrence", "other_class").alias("b"))
        e = e.join(parent_of("class", "pa"), "class", "left").join(parent_of("other_class", "pb"), "other_class", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        e = e.filter(F.col("a.class") != F.col("b.class"))
        if near.count() <= LINKS_AT_ONCE:
            flat = e.select("a.*", F.col("b.first_batch").alias("batch2"), F.col("b.first_occurrence").alias("occurrence2"), F.col("b.class").alias("class2"))
            moved = flat.groupBy().applyInPandas(joined, "class binary, first_batch int, first_occurrence bigint, top binary").select("class", F.struct("first_batch", "first_occurrence", F.col("top").alias("class")).alias("top"))
        else:
            e = written(e.distinct(), "p6-edges")
            edges = e.select("a.class", F.col("b.class").alias("partner")).unionByName(e.select(F.col("b.class").alias("class"), F.col("a.class").alias("partner"))).distinct()
            nodes = e.select(F.col("a").alias("first")).unionByName(e.select(F.col("b").alias("first"))).distinct().select("first.class", "first")
            moved = components(edges, nodes).filter(F.col("top.class") != F.col("class"))
        moved = written(moved, "p6-moved")
        members = of.join(moved.select(F.col("class").alias("_r"), "top"), F.col("parent.class") == F.col("_r")).select("class", F.col("top").alias("parent"))
        rows = moved.select("class", F.col("top").alias("parent")).unionByName(members)
        rows.select("class", "parent", F.lit(batch).alias("batch"), F.lit(attempt).cast("bigint").alias("attempt")).coalesce(1).write.mode("append").parquet(f"{self.path}/parents")


def joined(edges: pd.DataFrame) -> pd.DataFrame:
    """class, first_batch, first_occurrence, top of the ends of edges that are not the earliest of their component, by union-find with path compression."""
    top: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    for b1, o1, c1, b2, o2, c2 in edges[["first_batch", "first_occurrence", "class", "batch2", "occurrence2", "class2"]].itertuples(index=False):
        x, y = sorted((find((b1, o1, c1)), find((b2, o2, c2))))
        top[y] = x
    rows = [(x[2], *find(x)) for x in top if find(x) != x]
    return pd.DataFrame(rows, columns=["class", "first_batch", "first_occurrence", "top"]) if rows else pd.DataFrame({"class": [], "first_batch": [], "first_occurrence": [], "top": []})


def batches_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """The rows with the hash that content_hash has or should have, and the batch numbers in order."""
    o = table(spark, sf_dir, "passage_occurrence").filter("batch_no is not null")
    hash_ = F.coalesce("content_hash", F.when(F.col("normalized_text").isNotNull(), F.sha2("normalized_text", 256)), F.when(F.col("content_hash").isNull() & F.col("normalized_text").isNull(), recomputed_hash("raw_text")))
    return o.select("occurrence_id", "passage_id", "batch_no", hash_.alias("hash"), F.col("raw_text").alias("text")), sorted(r[0] for r in o.select("batch_no").distinct().collect())


def new_history(spark: SparkSession) -> History:
    """An empty history in the shared scratch folder; it goes when the application ends."""
    path = f"{scratch_dir(spark)}/passagemill-history-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return History(spark, path)


def run_batches(spark: SparkSession, sf_dir: str, history: History, link_first: bool) -> DataFrame | None:
    """Accept the batches in order; occurrence_id, batch_no, hash, class, m of the rows of all batches."""
    rows, numbers = batches_of(spark, sf_dir)
    rows, out = written(with_classes(rows), "p6-rows"), None
    for b in numbers:
        part = history.accept(rows.filter(F.col("batch_no") == b).drop("batch_no"), b, link_first or b != numbers[0]).withColumn("batch_no", F.lit(b))
        out = part if out is None else out.unionByName(part)
    return out


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occurrence_id, batch_no, first_passage_id (null: new), kind (seen, exact, near or new), score (of near) of every row of batches 1 and up."""
    history = new_history(spark)
    out = run_batches(spark, sf_dir, history, link_first=False)
    if out is None:
        return spark.createDataFrame([], "occurrence_id bigint, batch_no int, first_passage_id string, kind string, score double")
    kept = table(spark, sf_dir, "passage_occurrence").select(F.col("passage_id").alias("first_passage_id"))
    old = table(spark, sf_dir, "seen_hashes").filter("first_passage_id is not null and content_hash is not null").join(kept, "first_passage_id", "left_anti")
    old = written(old.groupBy(F.col("content_hash").alias("hash")).agg(F.min("first_passage_id").alias("old_id")), "p6-old")
    seen = F.col("old_id").isNotNull()
    return out.filter("batch_no > 0").join(old, "hash", "left").select(
        "occurrence_id", "batch_no", F.coalesce("old_id", "m.passage").alias("first_passage_id"),
        F.when(seen, "seen").otherwise(F.coalesce("m.kind", F.lit("new"))).alias("kind"), F.when(~seen, F.col("m.score")).alias("score"),
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).filter("first_passage_id is not null").select("occurrence_id", "first_passage_id").distinct()


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occurrence_id, representative (passage_id of the earliest row of its cluster) of each row with a word: connected components of all near-equal pairs, as the mapping has them after the last batch."""
    history = new_history(spark)
    out = run_batches(spark, sf_dir, history, link_first=True)
    if out is None:
        return spark.createDataFrame([], "occurrence_id bigint, representative string")
    classes = history.read("classes").select("class", "first_passage", F.struct("first_batch", "first_occurrence", "class").alias("first"))
    top = history.roots(classes.select("class", "first")).select("class", F.col("root.class").alias("_top"))
    name = classes.select(F.col("class").alias("_top"), F.col("first_passage").alias("representative"))
    return out.filter("class is not null").select("occurrence_id", "class").join(top, "class").join(name, "_top").select("occurrence_id", "representative")
