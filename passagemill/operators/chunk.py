"""Chunkers: column builders that turn a text into array<struct(chunk_ordinal, chunk_total, text, char_length, ...)>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, let, sentences_keeping_marks, strip, tokens

VERSION = "v1"


def _as_chunks(texts: Column, strategy: str, token_length: Callable[[Column], Column] | None = None) -> Column:
    one = lambda n, t, i: F.struct(
        i.cast("int").alias("chunk_ordinal"), n.alias("chunk_total"), t.alias("text"), F.length(t).alias("char_length"), F.lit(strategy).alias("chunk_strategy"), F.lit(VERSION).alias("chunk_strategy_version"),
        (token_length(t) if token_length else F.lit(None)).cast("int").alias("token_length"),
    )
    return let(texts, lambda all_: F.transform(all_, lambda t, i: one(F.size(all_), t, i)))


def passage_native(text: Column) -> Column:
    """The text as one chunk, the empty text too."""
    return _as_chunks(F.array(text), "passage_native")


def sentence_groups(text: Column, target_chars: int = 600, overlap_sentences: int = 1) -> Column:
    """Sentences packed greedily to the target, the last ones of a group carried into the next; an over-long sentence stays whole."""
    if target_chars <= 0 or overlap_sentences < 0:
        raise ValueError("target_chars must be positive and overlap_sentences not negative")
    s = sentences_keeping_marks(text)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("size"))

    def add(acc: Column, x: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (acc["size"] + F.length(x) + 1 > target_chars)
        carried = F.slice(acc["now"], F.greatest(F.size(acc["now"]) - overlap_sentences + 1, F.lit(1)), overlap_sentences) if overlap_sentences else F.array().cast("array<string>")
        carried_size = F.aggregate(carried, F.lit(0), lambda a, y: a + F.length(y))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.concat(carried, F.array(x))).otherwise(F.concat(acc["now"], F.array(x))).alias("now"),
            F.when(full, carried_size + F.length(x) + 1).otherwise(acc["size"] + F.length(x) + 1).cast("int").alias("size"),
        )

    groups = lambda s: F.aggregate(s, start, add, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], " ")))).otherwise(a["done"]))
    return let(s, lambda s: F.when(F.size(s) > 0, groups(s)).otherwise(F.array(text)))


def sentence_aware(text: Column, target_chars: int = 600, overlap_sentences: int = 1) -> Column:
    return _as_chunks(sentence_groups(text, target_chars, overlap_sentences), "sentence_aware")


def fixed_token_overlap(text: Column, target_tokens: int = 128, overlap_tokens: int = 20) -> Column:
    """Windows over white space words; a text within the target stays as it is. Stepping goes on while words are left, so the last window may lie inside the one before."""
    if target_tokens <= 0 or overlap_tokens < 0 or overlap_tokens >= target_tokens:
        raise ValueError("need 0 <= overlap_tokens < target_tokens")
    split = lambda t: F.filter(F.split(t, f"{WS}+"), lambda x: x != "")
    step = F.lit(target_tokens - overlap_tokens)
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, step), lambda i: F.array_join(F.slice(w, i + 1, target_tokens), " "))
    texts = let(split(text), lambda w: F.when(F.size(w) <= target_tokens, F.array(text)).otherwise(windows(w)))
    return _as_chunks(texts, "fixed_token_overlap", lambda t: F.size(split(t)))


def char_windows(text: Column, size: int = 400, overlap: int = 60) -> Column:
    """Stripped windows of characters that stop once one reaches the end; a blank text gives none."""
    n, step = F.length(text), size - overlap
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int") * step, F.lit(step)))
    return _as_chunks(F.filter(F.transform(starts, lambda i: strip(F.substring(text, i + 1, size))), lambda x: x != ""), "char_window")


def parent_child(text: Column, target_chars: int = 600) -> Column:
    """The full text and its sentence-aware children."""
    return _as_chunks(F.concat(F.array(text), sentence_groups(text, target_chars, 1)), "parent_child")


def with_metadata_prefix(chunks: DataFrame, metadata: DataFrame, key: str, prefix: Column) -> DataFrame:
    """embedding_text for chunks whose passage has metadata, and the strategy renamed; other chunks stay."""
    x = chunks.join(metadata.select(key, prefix.alias("_prefix")), key, "left")
    has = F.coalesce(F.col("_prefix"), F.lit("")) != ""
    return x.select(
        *[c for c in chunks.columns if c != "chunk_strategy"], F.when(has, F.concat(F.lit("metadata_prefix+"), F.col("chunk_strategy"))).otherwise(F.col("chunk_strategy")).alias("chunk_strategy"), F.when(has, F.concat("_prefix", "text")).alias("embedding_text")
    )


def semantic_groups(sentences: DataFrame, key: str, position: str, text: str, similarity: Column, threshold: float = 0.5) -> DataFrame:
    """A new group where a sentence's similarity to the one before is below the threshold. similarity may use columns prev_<text> and <text>."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    w = Window.partitionBy(key).orderBy(position)
    x = sentences.withColumn(f"prev_{text}", F.lag(text).over(w))
    x = x.withColumn("_cut", F.when(F.col(f"prev_{text}").isNull(), 0).otherwise((similarity < threshold).cast("int")))
    x = x.withColumn("chunk_ordinal", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return x.groupBy(key, "chunk_ordinal").agg(F.expr(f"array_join(transform(array_sort(collect_list(struct(`{position}`, `{text}`))), x -> x.`{text}`), ' ')").alias("text"), F.count("*").alias("n_sentences"))


def word_jaccard(a: Column, b: Column) -> Column:
    """A similarity that needs no model."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


REGISTRY: dict[str, Callable[[Column], Column]] = {"passage_native": passage_native, "sentence_aware": sentence_aware, "fixed_token_overlap": fixed_token_overlap}


def get_chunker(strategy: str) -> Callable[[Column], Column]:
    if strategy not in REGISTRY:
        raise ValueError(f"unknown chunk strategy {strategy!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[strategy]
