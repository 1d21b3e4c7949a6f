"""Scripts, language guesses and the segment groups a question goes to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import language_code

#: Scripts in order of precedence with their code points, and the languages written in them.
SCRIPTS = [
    ("Devanagari", r"[\x{900}-\x{97F}]", ["hi", "mr", "ne", "sa"]),
    ("Bengali", r"[\x{980}-\x{9FF}]", ["bn", "as"]),
    ("Gujarati", r"[\x{A80}-\x{AFF}]", ["gu"]),
    ("Tamil", r"[\x{B80}-\x{BFF}]", ["ta"]),
    ("Arabic", r"[\x{600}-\x{6FF}]", ["ur"]),
    ("Kannada", r"[\x{C80}-\x{CFF}]", ["kn"]),
    ("Malayalam", r"[\x{D00}-\x{D7F}]", ["ml"]),
    ("Odia", r"[\x{B00}-\x{B7F}]", ["or"]),
    ("Gurmukhi", r"[\x{A01}-\x{A74}]", ["pa"]),
]
#: Languages with segments, and those known without.
INDEXED = ["as", "bn", "en", "gu", "hi", "kn", "ml", "mr", "ne", "or", "pa", "sa", "ta", "ur"]
SUPPORTED = sorted([*INDEXED, "te"])
PILOT = ["as", "kn", "ml", "ne", "or", "pa", "sa"]
DANDA = r"[\x{964}\x{965}]"


def detect_script(c: Column, strict: bool = False) -> Column:
    """The first script of the list that has a character in the text, else Latin. The danda lies in the first range, so other scripts' texts with it count as Devanagari; strict looks at letters only."""
    if strict:
        c = F.regexp_replace(c, DANDA, "")
    out = F
    for name, pattern, _ in SCRIPTS:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("Latin")


def detect_language(c: Column, strict: bool = False) -> Column:
    """The script's first language; en for Latin."""
    s, out = detect_script(c, strict), F
    for name, _, languages in SCRIPTS:
        out = out.when(s == name, languages[0])
    return out.otherwise("en")


def language_filter(detected: Column, hint: Column) -> Column:
    """Segment groups to search; the hint wins over the detected language."""
    lang = language_code(F.coalesce(F.when(hint != "", hint), F.when(detected != "", detected), F.lit("en")))
    words = lambda xs: F.array(*[F.lit(x) for x in xs])
    return (
        F.when(lang.isin("en", "hi", "mr", "ne", "sa"), words(["hi", "mr", "ne", "sa"]))
        .when(lang.isin("bn", "as"), words(["bn", "as", "hi"]))
        .when(lang.isin(*INDEXED), F.array(lang, F.lit("hi")))
        .when(lang.isin(*SUPPORTED), words(["hi"]))
        .otherwise(words(INDEXED))
    )
