"""Nested-collection helpers shared by the rule operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelscope.functions.numeric import col

EMPTY_TEXT_ARRAY = "array<string>"


def text_array(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast(EMPTY_TEXT_ARRAY)


def build_array(*conditions) -> Column:
    """Ordered list of messages; each item is ``(condition, message)`` or a plain message."""
    parts = []
    for item in conditions:
        if isinstance(item, tuple):
            condition, message = item
            parts.append(F.when(condition, message if isinstance(message, Column) else F.lit(message)))
        else:
            parts.append(item if isinstance(item, Column) else F.lit(item))
    return F.array_compact(F.array(*parts)).cast(EMPTY_TEXT_ARRAY)


def or_default(items: Column, default: str) -> Column:
    """The array itself, or a single default message when it is empty."""
    return F.when(F.size(items) > 0, items).otherwise(text_array(default))


def append_unique(items, extra, *, take: int = 2, keep: int = 5) -> Column:
    """First ``keep`` items, then up to ``take`` of ``extra`` that are not there yet, cut to ``keep``."""
    base = F.slice(col(items), 1, keep)
    return F.slice(F.concat(base, F.array_except(F.slice(col(extra), 1, take), base)), 1, keep)


def token_overlap(a, b) -> Column:
    """Share of the tokens of ``a`` that also occur in ``b``; 0 when either set is empty."""
    x, y = col(a), col(b)
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(both, F.size(F.array_intersect(x, y)) / F.size(F.array_distinct(x))).otherwise(F.lit(0.0))


def flag_union(*flags) -> Column:
    """1 when any of the 0/1 flags is set."""
    xs = [F.coalesce(col(f).cast("int"), F.lit(0)) for f in flags]
    return F.greatest(*xs) if len(xs) > 1 else xs[0]
