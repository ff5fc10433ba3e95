"""Shared by the operators of this package: words of a text as bytes, ordered positions, connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.session import materialize

#: A-Z become a-z; every ASCII byte that is neither a digit nor a letter becomes a space; bytes from 0x80 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text (UTF-8 bytes); none for null."""
    return text.translate(FOLD).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text (UTF-8 bytes), unchanged; none for null."""
    return text.split() if text else []


def texts_in(df: DataFrame) -> DataFrame:
    """The table, to be read in Arrow batches of 1,000 rows: texts are long, and a batch lies in memory on both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def utf8(name: str) -> Column:
    """Text as bytes: Python then needs no decoding, and word offsets are byte offsets."""
    return F.col(name).cast("binary")


def running_totals(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Add ``<value>_before`` for every value: its sum over the rows of the same keys that come earlier in ``order``.

    ``order[0]`` is an evenly spread hex string (md5). Rows meet in slices of its first digits, so no key, however
    frequent, is one task's: slice sums are added up in two small steps, and only the rows of a slice are sorted
    together. The number of slices follows the number of rows (about 500 to 120,000 rows a slice).
    """
    digits = min(6, max(1, math.ceil(math.log(max(df.count(), 1) / 500 + 1, 256))))
    df = df.withColumns({"_hi": F.substring(order[0], 1, digits), "_lo": F.substring(order[0], digits + 1, digits)})
    sums = df.groupBy(*keys, "_hi", "_lo").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    coarse = sums.groupBy(*keys, "_hi").agg(*(F.sum(f"_s_{v}").alias(f"_c_{v}") for v in values))
    up_to = lambda w, v: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_hi")
    coarse = coarse.select(*keys, "_hi", *(up_to(w, f"_c_{v}").alias(f"_c_{v}") for v in values))
    w = Window.partitionBy(*keys, "_hi").orderBy("_lo")
    fine = sums.select(*keys, "_hi", "_lo", *(up_to(w, f"_s_{v}").alias(f"_f_{v}") for v in values)).alias("f")
    c = coarse.alias("c")
    fine = fine.join(c, [*(F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys), F.col("f._hi") == F.col("c._hi")]).select(
        *(F.col(f"f.{k}").alias(f"_k_{k}") for k in keys), F.col("f._hi").alias("_k_hi"), F.col("f._lo").alias("_k_lo"),
        *((F.col(f"f._f_{v}") + F.col(f"c._c_{v}")).alias(f"_b_{v}") for v in values),
    )
    w = Window.partitionBy(*keys, "_hi", "_lo").orderBy(*order)
    within = df.withColumns({f"_w_{v}": up_to(w, v) for v in values})
    on = [*(within[k].eqNullSafe(fine[f"_k_{k}"]) for k in keys), within["_hi"] == fine["_k_hi"], within["_lo"] == fine["_k_lo"]]
    joined = within.join(fine, on)
    gone = ["_hi", "_lo", "_k_hi", "_k_lo", *(f"_k_{k}" for k in keys), *(f"_{x}_{v}" for x in "wb" for v in values)]
    return joined.withColumns({f"{v}_before": F.col(f"_w_{v}") + F.col(f"_b_{v}") for v in values}).drop(*gone)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the smallest node of its component.

    Alternating star steps: each node hands its larger neighbours to its smallest one, then keeps one link down. Every
    step is an aggregate and a join on the nodes, written to the shared folder; a hub is only ever a join key.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u now hang on u's smallest neighbour
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the neighbours below u, and u, hang on the smallest of them
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = now


def if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """The table marked for broadcast if it has no more than so many (narrow) rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_counted(rows: DataFrame, facts: DataFrame, key: str, count: str, part: int = 1000) -> DataFrame:
    """Rows with the facts of their key; ``facts`` has one row for each key and says how many rows hold it.

    A key of more than one in ``part`` rows is joined by broadcast: there are fewer than ``part`` of them. The others are
    shuffled.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * part > total
    hot = F.broadcast(facts.where(often))
    names = [*rows.columns, *(c for c in facts.columns if c not in (key, count))]
    alike = rows.join(hot, key).select(*names)
    return alike.unionByName(rows.join(hot.select(key), key, "left_anti").join(facts.where(~often), key).select(*names))
