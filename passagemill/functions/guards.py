"""Checks of questions before, and of answers after, retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEFT, RIGHT, WS, bounded, content_tokens, is_enumerator_stub, is_navigation_junk, is_truncated_fragment, strip

#: Patterns of the input checks. The two Bengali and the Devanagari greeting end in a vowel sign, after which a word boundary needs a letter.
UNSAFE = bounded("bomb|kill|hack|exploit|malware|ransomware|cvv|ssn|credit card|password|api key|private key")
CREDENTIAL = r"(?i)(?:password|passwd|secret|api[_\-]?key|token|bearer|ssh[_\-]?key)"
INJECTION = r"(?i)(?:ignore previous|forget instructions|you are now|disregard|jailbreak|DAN mode)"
GREETING = rf"(?i)^(?:(?:hi|hello|hey|namaste|namaskar|bonjour|ola|hola|salut|ciao){RIGHT}|(?:नमस्ते|হ্যালো|হেলো)[\p{{L}}\p{{N}}_])"
CURRENT_STATE = bounded("weather|temperature|stock price|share price|cricket score|latest news|current|today|right now|live score")
#: Question and answer types.
NUMERIC_QUESTION = rf"(?i){LEFT}(?:how (?:many|much)|how old|what (?:percentage|percent|fraction)){RIGHT}"
TEMPORAL_QUESTION = rf"(?i)^when{RIGHT}|{LEFT}when (?:did|was|were|is|are|does|do|will|won't|wasn't|weren't){RIGHT}|{LEFT}what (?:year|date|day|month|time){RIGHT}"
NUMBER_WORDS = bounded(
    "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|"
    "sixty|seventy|eighty|ninety|hundred|thousand|million|billion|dozen|couple|few|several"
).replace(LEFT, "(?:^|[^A-Za-z])").replace(RIGHT, "(?:$|[^A-Za-z])")
DATE_WORDS = bounded(
    "january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday|"
    "century|decade|ad|bc|ce|bce|o'clock|am|pm|ago|yesterday|today|tomorrow"
)
DIGIT = r"\p{Nd}"


def check_input(c: Column, max_chars: int = 512) -> Column:
    """Reason code of the first check that a question fails, in fixed order, or allowed. Null counts as empty."""
    c = F.coalesce(c, F.lit(""))
    bare = strip(c)
    distinct = F.size(F.array_distinct(F.filter(F.split(bare, ""), lambda x: x != "")))
    return (
        F.when(bare == "", "empty_input").when(F.length(c) > max_chars, "input_too_long").when((distinct <= 3) & (F.length(bare) > 10), "degenerate_input")
        .when(c.rlike(UNSAFE), "unsafe").when(c.rlike(CREDENTIAL), "credential_request").when(c.rlike(INJECTION), "prompt_injection")
        .when(bare.rlike(GREETING), "greeting").when(c.rlike(CURRENT_STATE), "current_state").otherwise("allowed")
    )


def guard_decision(reason: Column) -> Column:
    """refuse for what must not be answered, abstain for what can't, null for what goes on."""
    return F.when(reason.isin("unsafe", "credential_request", "prompt_injection"), "refuse").when(reason != "allowed", "abstain")


def has_number(c: Column) -> Column:
    return c.rlike(DIGIT) | c.rlike(NUMBER_WORDS)


def has_temporal_signal(c: Column) -> Column:
    return c.rlike(DIGIT) | c.rlike(DATE_WORDS)


def answer_type_mismatch(query: Column, answer: Column) -> Column:
    """The question asks for a number or a time and the answer has none."""
    return F.when(query.rlike(NUMERIC_QUESTION), ~has_number(answer)).when(query.rlike(TEMPORAL_QUESTION), ~has_temporal_signal(answer)).otherwise(False)


def clean_answer(answer: Column) -> Column:
    return F.lower(F.regexp_replace(strip(answer), r"[.?!।॥]+$", ""))


def support(answer: Column, passages: Column) -> Column:
    """1 if the passages contain the answer, else the part of its words that they have."""
    clean, text = clean_answer(answer), F.lower(F.array_join(passages, " "))
    words = lambda x: F.array_distinct(F.filter(F.split(x, f"{WS}+"), lambda t: t != ""))
    part = F.size(F.array_intersect(words(clean), words(text))) / F.greatest(F.size(words(clean)), F.lit(1))
    return F.when((clean != "") & F.contains(text, clean), 1.0).otherwise(part)


def query_overlap(query: Column, answer: Column) -> Column:
    """The part of the question's content words that the answer has; 1 if the question has none."""
    q = content_tokens(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, content_tokens(answer))) / F.size(q)).otherwise(1.0)


def verify_grounding(query: Column, answer: Column, passages: Column, least_support: float = 0.45, least_overlap: float = 0.25) -> Column:
    """struct(grounded, confidence). No answer, no passages, junk or an answer of the wrong type: (false, 0)."""
    s, o = support(answer, passages), query_overlap(query, answer)
    out = (
        F.coalesce(answer, F.lit("")) == ""
    ) | F.coalesce(F.size(passages) <= 0, F.lit(True)) | is_enumerator_stub(answer) | is_truncated_fragment(answer) | is_navigation_junk(answer) | answer_type_mismatch(query, answer) | (clean_answer(answer) == "")
    return F.struct(
        F.when(out, False).otherwise((s >= least_support) & (o >= least_overlap)).alias("grounded"),
        F.when(out, 0.0).otherwise(F.round(F.least(s, o), 4)).alias("confidence"),
    )
