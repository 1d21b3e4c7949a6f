"""Nested source rows to passage occurrences, with bad records routed to a reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

#: Columns that must never reach an indexed payload.
FORBIDDEN = ("query", "Answer", "Eng_Query", "Eng_Answer", "query_type", "is_selected")
MIN_CHARS = 10
PLACE = ["config_language", "split", "source_shard", "source_row"]


def assert_no_forbidden(df: DataFrame) -> DataFrame:
    found = sorted(set(FORBIDDEN) & set(df.columns))
    if found:
        raise ValueError(f"columns that must not be indexed: {found}")
    return df


def _elements(rows: DataFrame) -> DataFrame:
    """One row per element of the two lists of valid rows: English before translated at each position."""
    e, t = F.col("passages.English_passages"), F.col("passages.Translated_passages")
    valid = F.coalesce(F.col("passages").isNotNull() & e.isNotNull() & t.isNotNull() & (F.size(e) == F.size(t)), F.lit(False))
    both = F.arrays_zip(e.alias("en"), t.alias("tr"))
    x = rows.filter(valid).select(*PLACE, "dataset_revision", F.posexplode(both).alias("passage_position", "pair"))
    two = F.array(F.struct(F.lit(True).alias("is_original_english"), F.col("pair.en").alias("raw_text")), F.struct(F.lit(False).alias("is_original_english"), F.col("pair.tr").alias("raw_text")))
    x = x.select(*PLACE, "dataset_revision", "passage_position", F.explode(two).alias("y")).select(*PLACE, "dataset_revision", "passage_position", "y.*")
    return x.withColumn("normalized_text", normalize_text(F.col("raw_text")))


def occurrences(rows: DataFrame) -> DataFrame:
    """Valid passages. rows: dataset_revision, config_language, split, source_shard, source_row, passages struct. A passage needs MIN_CHARS characters after normalization."""
    x = _elements(rows).filter(F.col("raw_text").isNotNull() & (F.length("normalized_text") >= MIN_CHARS))
    return assert_no_forbidden(
        x.select("dataset_revision", *PLACE, "passage_position", F.when(F.col("is_original_english"), "en").otherwise(F.col("config_language")).alias("passage_language"), "raw_text", "normalized_text", F.sha2("normalized_text", 256).alias("content_hash"), "is_original_english")
    )


def rejects(rows: DataFrame) -> DataFrame:
    """What occurrences leaves out, with field, reason and the first 100 characters; position -1 for whole rows."""
    p = F.col("passages")
    e, t = F.col("passages.English_passages"), F.col("passages.Translated_passages")
    field, reason = F, F
    cases: list[tuple[Column, str, Column]] = [
        (p.isNull(), "passages", F.lit("missing_or_wrong_type")),
        (e.isNull() | t.isNull(), "passages", F.lit("missing_passage_lists")),
        (F.size(e) != F.size(t), "passages.length_mismatch", F.format_string("eng=%d trans=%d", F.size(e), F.size(t))),
    ]
    for test, name, why in cases:
        field, reason = field.when(test, name), reason.when(test, why)
    whole = rows.select(*PLACE, F.lit(-1).alias("passage_position"), field.otherwise(None).alias("field"), reason.otherwise(None).alias("reason"), F.lit(None).cast("string").alias("raw_value")).filter("reason is not null")
    bad = F.when(F.col("raw_text").isNull(), "null_or_wrong_type").when(F.length("normalized_text") < MIN_CHARS, "too_short")
    parts = _elements(rows).select(
        *PLACE, "passage_position", F.when(F.col("is_original_english"), "English_passages").otherwise("Translated_passages").alias("field"), bad.alias("reason"), F.coalesce(F.substring("raw_text", 1, 100), F.lit("None")).alias("raw_value")
    )
    return whole.unionByName(parts.filter("reason is not null"))


#: Fixed value: the answer text that marks a question without answer.
NO_ANSWER = "no answer present."


def answerable_bucket(rows: DataFrame) -> DataFrame:
    """Evaluation examples of valid rows: answerable with the first selected passage, unanswerable, or dropped where the two signs disagree."""
    e, t, s = F.col("passages.English_passages"), F.col("passages.Translated_passages"), F.col("passages.is_selected")
    qe, qh, answer = F.trim(F.coalesce("Eng_Query", F.lit(""))), F.trim(F.coalesce("query", F.lit(""))), F.trim(F.coalesce("Eng_Answer", F.lit("")))
    first = F.array_position(s, 1)
    none = F.lower(answer).isin(NO_ANSWER, "")
    usable = (qe != "") & (qh != "") & (F.size(e) > 0) & (F.size(t) > 0) & (F.size(e) == F.size(s)) & (F.size(t) == F.size(s))
    at = lambda c: F.coalesce(F.get(c, (first - 1).cast("int")), F.lit(""))
    kind = F.when((first > 0) & ~none & (at(e) != "") & (at(t) != ""), True).when((F.coalesce(first, F.lit(0)) == 0) & none, False)
    out = rows.filter(usable).select("query_id", qe.alias("query_en"), qh.alias("query_hi"), kind.alias("is_answerable"), F.when(kind, answer).alias("gt_answer_en"), F.when(kind, (first - 1).cast("int")).alias("gt_passage_index"), e.alias("candidates_en"), t.alias("candidates_hi"))
    return out.filter("is_answerable is not null")


def verdicts(c: Column) -> Column:
    """A judge's JSON as struct(verdict, reason); what can't be read is false with a message."""
    x = F.from_json(c, "verdict boolean, reason string")
    return F.struct(F.coalesce(x["verdict"], F.lit(False)).alias("verdict"), F.when(x["verdict"].isNull(), "unparseable verdict").otherwise(F.coalesce(x["reason"], F.lit(""))).alias("reason"))
