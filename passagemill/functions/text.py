"""Scalar text functions as column expressions. Patterns are in the subset that Java and RE2 read alike, so the SQL side can use the same strings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space, as a class that no dialect shortens.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: Function words left out of content tokens.
STOPWORDS = (
    "a an the is are was were be been being of to in on at for and or what who whom whose which how why when where does do did can "
    "will would should could this that these those it its as with"
).split()


def bounded(alternatives: str) -> str:
    """Any of the alternatives between word boundaries, in any case."""
    return f"(?i){LEFT}(?:{alternatives}){RIGHT}"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no builtin for it. Null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t), na_action="ignore")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; what a lambda refers to from outside is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """White space runs become one space and go at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normalize_text(c: Column) -> Column:
    """NFC and collapsed white space; null and empty give the empty text."""
    return F.coalesce(collapse(nfc(c)), F.lit(""))


def is_valid_passage(norm: Column, min_chars: int = 10) -> Column:
    return F.length(norm) >= min_chars


def content_hash(norm: Column) -> Column:
    return F.sha2(norm, 256)


def short_hash(text: Column, digits: int = 40) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def tokens(c: Column) -> Column:
    """Lower-case white space tokens, punctuation kept, repeats kept."""
    return F.filter(F.split(F.lower(c), f"{WS}+"), lambda t: t != "")


def content_tokens(c: Column) -> Column:
    """Distinct tokens that are no function words."""
    return F.array_except(F.array_distinct(tokens(c)), F.array(*[F.lit(w) for w in STOPWORDS]))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences_keeping_marks(c: Column) -> Column:
    """Sentences with their end marks; null gives null, blank gives none."""
    return _trimmed(F.split(c, rf"(?<=[.?!।॥]){WS}+|\n+"))


def sentences_first(c: Column, most: int = 6) -> Column:
    """The first sentences without end marks; the text itself if there is none."""
    return let(F.slice(_trimmed(F.split(c, r"[.!?।॥\n]+")), 1, most), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(c)))


def overlap_ratio(query_tokens: Column, text_tokens: Column) -> Column:
    return F.size(F.array_intersect(query_tokens, text_tokens)) / F.greatest(F.size(query_tokens), F.lit(1))


def token_overlap_score(query: Column, chunk: Column) -> Column:
    """Chunk tokens that the query has, repeats counted, damped by the chunk's length."""
    both = F.struct(F.array_distinct(tokens(query)).alias("q"), tokens(chunk).alias("c"))
    return let(both, lambda b: F.size(F.filter(b["c"], lambda t: F.array_contains(b["q"], t))) / (F.log(F.size(b["c"]) + F.lit(1.0)) + 1.0))


def approximate_token_count(c: Column) -> Column:
    return F.size(tokens(c)) + 2


def is_navigation_junk(c: Column) -> Column:
    return c.rlike(rf"(?i)you are here{WS}*:")


def is_pointer_sentence(c: Column) -> Column:
    return strip(c).rlike(rf"(?i)^(?:see|learn more|click here|find out more|read more|for more information){RIGHT}")


def is_truncated_fragment(c: Column) -> Column:
    return strip(c).rlike(r"^\(?[A-Za-z]\.?\)?$")


def is_enumerator_stub(c: Column) -> Column:
    return strip(c).rlike(rf":{WS}+(?:[0-9]{{1,2}}\.|[A-Za-z]\)){WS}*$")


def is_question_echo(sentence: Column, query_tokens: Column) -> Column:
    """The sentence has words and none beyond the query's, punctuation aside."""
    bare = F.filter(F.array_distinct(F.transform(content_tokens(sentence), lambda t: F.regexp_replace(t, r"^[.,!?।॥\"']+|[.,!?।॥\"']+$", ""))), lambda t: t != "")
    return (F.size(bare) > 0) & (F.size(F.array_except(bare, query_tokens)) == 0)


def metadata_prefix(*fields: Column) -> Column:
    """[a|b|c] and a space of the fields that are there; empty if none is."""
    joined = F.concat_ws("|", *[F.when(f != "", f) for f in fields])
    return F.when(joined != "", F.concat(F.lit("["), joined, F.lit("] "))).otherwise("")


def language_code(c: Column) -> Column:
    return F.lower(F.split_part(c, F.lit("-"), F.lit(1)))


#: Codes of the speech services that differ from the two-letter codes.
SPEECH_CODES = {"or": "od-IN", "en": "en-IN", "hi": "hi-IN", "bn": "bn-IN", "gu": "gu-IN", "kn": "kn-IN", "ml": "ml-IN", "mr": "mr-IN", "pa": "pa-IN", "ta": "ta-IN", "te": "te-IN"}


def speech_code(c: Column) -> Column:
    """The speech service's code of a language; null where it has none."""
    pairs = [F.lit(x) for kv in SPEECH_CODES.items() for x in kv]
    return F.create_map(*pairs)[language_code(c)]


def audio_format(c: Column) -> Column:
    """Container of an audio blob by its first bytes: wav, mp3, ogg, flac, webm, mp4, or wav where none fits."""
    head = F.hex(F.substring(c, 1, 12))
    at = lambda start, text: F.substring(head, start, len(text)) == text
    return (
        F.when(at(1, "52494646") & at(17, "57415645"), "wav").when(at(1, "494433"), "mp3").when(at(1, "FFFB") | at(1, "FFF3") | at(1, "FFF2"), "mp3")
        .when(at(1, "4F676753"), "ogg").when(at(1, "664C6143"), "flac").when(at(1, "1A45DFA3"), "webm").when(at(9, "66747970"), "mp4").otherwise("wav")
    )


def gap_row(name: Column, value: Column, ideal: float = 1.0) -> Column:
    """One line of the gap report: a bar of 24, the value and how far it is from the ideal in points."""
    gap = value - F.lit(ideal)
    fill = F.least(F.greatest(F.round(value * 24), F.lit(0)), F.lit(24)).cast("int")
    bar = F.rpad(F.substring(F.lit("#" * 24), F.lit(1), fill), 24, ".")
    verdict = F.when(F.abs(gap) < 0.0005, "PERFECT").when(gap < 0, F.format_string("%.1f points short", F.abs(gap) * 100)).otherwise(F.format_string("%.1f points over", gap * 100))
    return F.concat_ws("  ", name, bar, F.format_string("%.4f", value), verdict)
