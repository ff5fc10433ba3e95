"""Sharding by sampled splitters: range partitions of a key order, cut into shards of near equal bytes.

Keys are drawn with a chance that grows with a record's size, and every few of them in order make a boundary. Ranges that
still hold too much are sampled again and subdivided. Records are sorted within their range only; range totals then give
each record its place in the whole order, and the shards are equal parts of it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.session import materialize

PER_RANGE = 8
MAX_RANGES = 1 << 14
#: A group of equal texts at a boundary stays whole if it is no more than this part of a shard.
WHOLE = 0.05


def text_key(text: Column, id_: Column) -> Column:
    """Key of 32 hex digits: equal texts (null is as empty) stand together, in the order of a hash of their ids."""
    half = lambda c: F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 16)
    return F.concat(half(text), half(id_))


def range_of(key: Column, splitters: list[str]) -> Column:
    """Number of the key's range: how many splitters are not above it."""
    held = np.array(splitters, "S32")

    @F.pandas_udf("long")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held, keys.to_numpy().astype("S32"), side="right"))

    return find(key)


def drawn(keys: DataFrame, chance: Column) -> list[str]:
    """Keys drawn by a hash of the key, so that reruns draw the same."""
    u = F.pmod(F.xxhash64("_key", F.lit("draw")), F.lit(1 << 52)) / float(1 << 52)
    return sorted(r[0] for r in keys.where(u < chance).select("_key").distinct().collect())


def splitters_of(keys: DataFrame, total: int, rows: int) -> list[str]:
    """Boundaries such that no range holds over twice its fair part, as far as distinct keys allow.

    The driver sees drawn keys only: about PER_RANGE for each range, MAX_RANGES ranges.
    """
    ranges = min(MAX_RANGES, max(16, rows // 1000))
    weight = F.col("_size") / total + F.lit(1.0 / max(rows, 1))  # bytes and rows both count
    found = drawn(keys, weight * (ranges * PER_RANGE / 2))
    splitters = found[PER_RANGE - 1 :: PER_RANGE]
    for _ in range(8):
        held = keys.select("_size", range_of(F.col("_key"), splitters).alias("r"), "_key")
        load = held.groupBy("r").agg((F.sum("_size") / total + F.count("*") / rows).alias("w"), F.min("_key").alias("a"), F.max("_key").alias("b"))
        over = [(x.r, x.w) for x in load.where((F.col("w") > 4.0 / ranges) & (F.col("a") < F.col("b"))).collect()]
        if not over:
            break
        want = F.create_map(*(F.lit(v) for r, w in over for v in (int(r), PER_RANGE / w * math.ceil(w * ranges / 2))))
        again = held.where(F.col("r").isin([int(r) for r, _ in over])).withColumn("boost", want[F.col("r")])
        more = drawn(again, weight * F.col("boost"))
        new = sorted({*splitters, *more[PER_RANGE // 2 - 1 :: PER_RANGE // 2]})
        if len(new) == len(splitters):
            break
        splitters = new
    return splitters


def shard_by_bytes(keyed: DataFrame, shards: int = 8, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to rows with ``_key`` and ``_size`` (at least 1).

    Shards are equal parts of the key order by bytes; a record belongs where it starts. A group of equal texts (first half
    of the key) that a boundary would cut is kept whole on the nearer side if it is small; a large one, such as a third
    of all rows, is cut. Reruns agree. Repeated rows share a key and get slots of their own; an empty table gives none.
    """
    spark = keyed.sparkSession
    keys = materialize(keyed.select("_key", F.col("_size").cast("long"), *(c for c in order if c not in ("_key", "_size"))))
    total, rows = keys.agg(F.sum("_size"), F.count("*")).first()
    splitters = splitters_of(keys, total, rows) if rows else []
    by = ["_key", *order, "_size"]
    w = Window.partitionBy("_range").orderBy(*by)
    up_to = w.rowsBetween(Window.unboundedPreceding, -1)
    load = keys.groupBy(range_of(F.col("_key"), splitters).alias("_range")).agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).toPandas().sort_values("_range")
    start = {int(r): (int(b), int(n)) for r, b, n in zip(load["_range"], load["bytes"].cumsum() - load["bytes"], load["n"].cumsum() - load["n"], strict=True)}
    ranges = spark.createDataFrame([(r, *v) for r, v in start.items()], "_r long, _bytes long, _rows long")

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("_range", range_of(F.col("_key"), splitters)).withColumns({"_off": F.coalesce(F.sum("_size").over(up_to), F.lit(0)), "_row": F.row_number().over(w) - 1})
        df = df.join(F.broadcast(ranges), F.col("_range") == F.col("_r"))  # MAX_RANGES and what subdividing added
        return df.withColumns({"_off": F.col("_off") + F.col("_bytes"), "_row": F.col("_row") + F.col("_rows")}).drop("_r", "_bytes", "_rows")

    narrow = materialize(placed(keys))
    cuts = [k * (total or 0) // shards for k in range(1, shards)]
    group = F.substring("_key", 1, 16)
    at = narrow.where(" or ".join(f"(_off <= {c} and {c} < _off + _size)" for c in cuts)).select(group.alias("g")).distinct()
    spans = narrow.join(F.broadcast(at), group == at.g, "left_semi").groupBy(group.alias("g")).agg(F.min("_off").alias("a"), F.sum("_size").alias("n"))  # at most a row for each boundary
    spans = [(s.a, s.a + s.n) for s in spans.collect() if s.n <= WHOLE * total / shards]
    cuts = [next((a if c - a < b - c else b for a, b in spans if a <= c < b), c) for c in cuts]
    shard = sum((F.col("_off") >= c).cast("int") for c in cuts) if cuts else F.lit(0)
    firsts = {r[0]: r[1] for r in narrow.groupBy(shard).agg(F.min("_row")).collect()}
    first = F.coalesce(*(F.when(F.col("shard") == k, F.lit(v)) for k, v in firsts.items()), F.lit(0))
    out = placed(keyed.withColumn("_size", F.col("_size").cast("long"))).withColumn("shard", shard.cast("int"))
    return out.withColumn("slot", (F.col("_row") - first).cast("long")).drop("_range", "_off", "_row")
