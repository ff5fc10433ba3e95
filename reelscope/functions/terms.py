"""Case-insensitive substring search for word lists.

The union of several lists is compiled into one multi-pattern automaton, each text is read once, and only the ids of the
words found travel on. Everything after that (counts, flags, categories) is plain column arithmetic on small integer
arrays. Reading a text once instead of once per word is what keeps corpus scans bound by I/O rather than by the number
of words. All scans of one projection share one Python stage; a worker builds each automaton once.
"""

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from reelscope.functions.numeric import col


@lru_cache(64)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, i)
    out.make_automaton()
    return out


def _scanner(terms):
    """Arrow UDF text -> sorted ids of the terms it contains."""
    words = tuple(terms)

    def scan(texts: pd.Series) -> pd.Series:
        found = _automaton(words)
        return texts.map(lambda t: sorted({i for _, i in found.iter(t.lower())}) if t else [])

    return F.pandas_udf(scan, ArrayType(IntegerType()))


class TermIndex:
    """Several named word lists searched together."""

    def __init__(self, lists):
        self.lists = {name: tuple(dict.fromkeys(t.lower() for t in terms)) for name, terms in lists.items()}
        self.terms = tuple(dict.fromkeys(t for terms in self.lists.values() for t in terms))
        self._id = {t: i for i, t in enumerate(self.terms)}

    def scan(self, text) -> Column:
        """``array<int>``: ids of all terms contained in the text (empty for null)."""
        return _scanner(self.terms)(col(text))

    def _ids(self, name) -> str:
        return "array(" + ",".join(str(self._id[t]) for t in self.lists[name]) + ")"

    def hits(self, found: str, name) -> Column:
        """Number of distinct terms of the list among the found ids (a column name)."""
        return F.expr(f"size(array_intersect({found}, {self._ids(name)}))")

    def any(self, found: str, name) -> Column:
        """1 when at least one term of the list is among the found ids, else 0."""
        return F.expr(f"cast(arrays_overlap({found}, {self._ids(name)}) AS int)")

    def words(self, found, name) -> Column:
        """The terms found, in list order."""
        table = "array(" + ",".join(sql_text(t) for t in self.terms) + ")"
        return F.expr(f"transform(array_intersect({self._ids(name)}, {found}), i -> {table}[i])")


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(text, terms) -> Column:
    """0/1: does any term occur (case-insensitive substring)?"""
    return (term_hits(text, terms) > 0).cast("int")


def term_hits(text, terms) -> Column:
    """Number of distinct terms that occur (case-insensitive substring)."""
    return F.size(TermIndex({"t": terms}).scan(text))


def starts_with_any(text, terms) -> Column:
    condition = None
    for t in terms:
        one = text.startswith(t)
        condition = one if condition is None else condition | one
    return condition
