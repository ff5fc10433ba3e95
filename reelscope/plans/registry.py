"""Named queries and, where SQL can say the same, their independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(c, name: str):
    """Double rounded to six decimals: sums in another order still compare equal."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6).alias(name)


def joined(c, name: str):
    """Text arrays leave a query as one string."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, " | ").alias(name)
