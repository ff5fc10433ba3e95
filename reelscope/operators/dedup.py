"""Row and line de-duplication, set operations on tables."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from reelscope.functions.numeric import col
from reelscope.functions.text import normal_line_quality, ocr_normalize


def dedup_latest(df: DataFrame, key: str = "video_id", order: str = "views", ties=()) -> DataFrame:
    """The row with the largest ``order`` per key; ties go to the smallest tie-breaker columns.

    The rank filter is applied before the shuffle as well, so a key with very
    many copies contributes one row per task.
    """
    if key not in df.columns:
        return df
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), *[F.col(t).asc() for t in ties])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def top_per_group(df: DataFrame, keys: list[str], orders, k: int) -> DataFrame:
    """First k rows per group.

    For small k the rank filter also runs before the shuffle, so that a group sends k rows per task; for a k in the
    thousands a group's rows meet in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*orders)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def union_by_name(frames) -> DataFrame:
    """Outer union by column name; columns missing on one side are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def recombine(train: DataFrame, val: DataFrame) -> DataFrame:
    return train.unionByName(val)


def exact_line_dedup(df: DataFrame, key: str, line: str, orders: list[str]) -> DataFrame:
    """First occurrence of every line per key, ignoring case."""
    w = Window.partitionBy(key, F.lower(line)).orderBy(*orders)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def clean_lines(lines) -> Column:
    """Normalised lines of sufficient quality, in order."""
    normal = F.transform(col(lines), ocr_normalize)
    return F.filter(normal, lambda x: normal_line_quality(x) >= 0.38)


#: So many kept lines are compared one by one; beyond, they are found by their first PREFIX characters.
FEW_KEPT, PREFIX, BREAK = 64, 8, "\0"


class KeptLines:
    """The lower-cased lines kept so far; tells whether a line stands in one of them or holds one of them."""

    def __init__(self):
        self.lows, self.joined, self.short, self.long = [], "", [], {}

    def add(self, low: str) -> None:
        self.joined += BREAK + low
        self.lows.append(low)
        if len(low) < PREFIX:
            self.short.append(low)
        else:
            self.long.setdefault(low[:PREFIX], []).append(low)

    def meets(self, low: str) -> bool:
        if not self.lows:
            return False
        if (low in self.joined) if BREAK not in low else any(low in e for e in self.lows):
            return True
        if len(self.lows) <= FEW_KEPT:
            return any(e in low for e in self.lows)
        if any(e in low for e in self.short):
            return True
        for i in range(len(low) - PREFIX + 1):
            starts = self.long.get(low[i : i + PREFIX])
            if starts and any(low.startswith(e, i) for e in starts):
                return True
        return False


@F.pandas_udf(ArrayType(StringType()))
def _kept_lines(lines: pd.Series, lows: pd.Series) -> pd.Series:
    def keep(items, lows):
        kept, out = KeptLines(), []
        for item, low in zip(items, lows, strict=True):
            if low is None:
                out.append(item)
            elif not kept.meets(low):
                kept.add(low)
                out.append(item)
        return out

    return pd.Series([None if x is None else keep(x, y) for x, y in zip(lines, lows, strict=True)], dtype=object)


def containment_dedup(lines) -> Column:
    """Greedy fold over an ordered array: drop a line contained in, or containing, one kept before; null lines stay.

    Lower-cased once per line, not once per pair. Hand in a column, not an expression: it is read twice.
    """
    return _kept_lines(col(lines), F.transform(col(lines), F.lower))


def _common_subsequence(place: dict[str, int], n: int, other: str, need: float) -> bool:
    """Can a common subsequence of a text (bits of the places of its characters) and ``other`` reach ``need``?"""
    full = free = (1 << n) - 1
    for at in range(0, len(other), 64):
        for c in other[at : at + 64]:
            hit = free & place.get(c, 0)
            free = ((free + hit) | (free - hit)) & full
        if n - free.bit_count() + len(other) - at - 64 < need and at + 64 < len(other):
            return False
    return n - free.bit_count() >= need


class NearLines:
    """Kept lines that may be close to a line, by bounds no close pair misses.

    Matching blocks with M characters in all, of a pair of T characters, are a common subsequence. At least one character
    stands unmatched between two of them, so there are at most T - 2M + 1 blocks, and 3M - T - 1 pairs of neighbouring
    characters are common. Pairs are counted in BUCKETS cells, which only adds common ones.
    """

    BUCKETS = 512

    def __init__(self, threshold: float):
        self.threshold, self.lows = threshold, []
        self.size, self.pairs = np.zeros(8, np.int64), np.zeros((8, self.BUCKETS), np.int32)

    def counted(self, low: str) -> np.ndarray:
        c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.bincount((c[:-1] * 31 + c[1:]) % self.BUCKETS, minlength=self.BUCKETS).astype(np.int32)

    def add(self, low: str, pairs: np.ndarray) -> None:
        k = len(self.lows)
        if k == len(self.size):
            self.size, self.pairs = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.pairs))
        self.size[k], self.pairs[k] = len(low), pairs
        self.lows.append(low)

    def close(self, low: str, pairs: np.ndarray) -> bool:
        """Does the full ratio to a kept line reach the threshold? It is taken only where it still can."""
        k, n = len(self.lows), len(low)
        size = self.size[:k]
        need = self.threshold * (size + n) / 2 - 1e-6
        on = np.flatnonzero(np.minimum(size, n) >= need)
        on = on[np.minimum(self.pairs[on], pairs).sum(1) >= 3 * need[on] - size[on] - n - 1]
        if not len(on):
            return False
        place: dict[str, int] = {}
        for i, c in enumerate(low):
            place[c] = place.get(c, 0) | 1 << i
        matcher = SequenceMatcher(None, low, "")
        for j in on.tolist():
            if _common_subsequence(place, n, self.lows[j], need[j]):
                matcher.set_seq2(self.lows[j])
                if matcher.ratio() >= self.threshold:
                    return True
        return False


def _fuzzy(threshold: float):
    def dedup(lines: pd.Series) -> pd.Series:
        def keep(items):
            out, kept, near = [], KeptLines(), NearLines(threshold)
            for item in items if items is not None else []:
                low = item.lower()
                if kept.meets(low):
                    continue
                pairs = near.counted(low)
                if not near.close(low, pairs):
                    out.append(item)
                    kept.add(low)
                    near.add(low, pairs)
            return out

        return lines.map(keep)

    return F.pandas_udf(dedup, ArrayType(StringType()))


def fuzzy_line_dedup(lines, threshold: float = 0.86) -> Column:
    """Greedy fold that also drops lines whose matching-block similarity reaches the threshold."""
    return _fuzzy(threshold)(col(lines))
