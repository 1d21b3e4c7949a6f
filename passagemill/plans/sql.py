"""Pieces of SQL that the oracle queries share."""

from __future__ import annotations

from ..functions.text import STOPWORDS, WS


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def sub(column: str, pattern: str, by: str) -> str:
    return f"regexp_replace({column}, {q(pattern)}, {q(by)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def norm(x: str) -> str:
    return f"coalesce(trim({sub(f'nfc_normalize({x})', f'{WS}+', ' ')}), '')"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), {q(f'{WS}+')}), lambda t: t <> '')"


def words(x: str) -> str:
    """White space words in their own case."""
    return f"list_filter(regexp_split_to_array({x}, {q(f'{WS}+')}), lambda t: t <> '')"


STOP = "[" + ", ".join(q(w) for w in STOPWORDS) + "]"


def ctoks(x: str) -> str:
    return f"list_filter(list_distinct({toks(x)}), lambda t: NOT list_contains({STOP}, t))"


def common(a: str, b: str) -> str:
    """Number of distinct members of a that b has."""
    return f"len(list_filter({a}, lambda m: list_contains({b}, m)))"


def trimmed(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: s <> '')"


def keep_marks(x: str) -> str:
    marked = sub(x, rf"([.?!।॥]){WS}+", "\\1\n")
    return trimmed(f"regexp_split_to_array({marked}, '\n+')")


def first_sentences(x: str, n: int = 6) -> str:
    s = f"list_slice({trimmed(f'regexp_split_to_array({x}, {q(chr(91) + '.!?।॥' + chr(10) + chr(93) + '+')})')}, 1, {n})"
    return f"(CASE WHEN len({s}) > 0 THEN {s} ELSE [{x}] END)"


def overlap_score(query: str, chunk: str) -> str:
    c, k = toks(chunk), toks(query)
    return f"(len(list_filter({c}, lambda t: list_contains({k}, t))) / (ln(len({c}) + 1.0) + 1.0))"
