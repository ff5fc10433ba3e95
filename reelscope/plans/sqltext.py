"""Fragments of oracle SQL: the word lists and text rules again, written for DuckDB."""

from __future__ import annotations

SPACE = r"\s\x0b\p{Z}\x1c-\x1f\x{85}"
WORD = r"[\p{L}\p{N}_]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(terms) -> str:
    return "[" + ", ".join(q(t.lower()) for t in dict.fromkeys(terms)) + "]"


def hits(text: str, terms) -> str:
    return f"len(list_filter({lst(terms)}, lambda t: contains(lower({text}), t)))"


def flag(text: str, terms) -> str:
    return f"CAST({hits(text, terms)} > 0 AS INTEGER)"


def n_match(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def words_n(text: str) -> str:
    return n_match(text, WORD)


def tokens_n(text: str) -> str:
    return n_match(text, f"[^{SPACE}]+")


def clean(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{SPACE}]+', ' ', 'g'))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def split(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{SPACE}]+'), lambda w: w <> '')"


def clip(x: str, lo, hi) -> str:
    return f"greatest(CAST({lo} AS DOUBLE), least(CAST({hi} AS DOUBLE), {x}))"


def case(key: str, table: dict, default: str) -> str:
    def val(v):
        return q(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)"

    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {val(v)}" for k, v in table.items()) + f" ELSE {default} END"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def bround(x: str) -> str:
    """Half-even rounding of a double to an integer."""
    return f"round_even({x}, 0)"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' | ')"
