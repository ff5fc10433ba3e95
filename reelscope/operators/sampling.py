"""Exact stratified samples, splits and folds in hash order.

A hash of key and seed replaces the random generator, so the same row always
lands in the same part.  Selections compare each row with one cut-off hash per
stratum; the wide rows themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.operators.ordering import hash_cutoffs, hash_order, hash_rank
from reelscope.session import few

ALL = "all"


def _class_sizes(df: DataFrame, stratum: Column) -> DataFrame:
    return df.groupBy(F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum")).agg(F.count("*").alias("n"))


def _with_total(sizes: DataFrame) -> DataFrame:
    return sizes.withColumn("total", sizes.agg(F.sum("n")).scalar())


def _selected(df: DataFrame, key, seed, stratum: Column, targets: DataFrame, flag: str, among: DataFrame | None = None) -> DataFrame:
    """Adds a boolean column: among the first k rows of the stratum in hash order (of the rows of ``among``, if given).

    Cut-offs have a row per class. If the classes are few, they are sent to the rows; only for very many classes, which
    are then no hot keys, are the rows shuffled.
    """
    order = hash_order(key, seed)
    small = few(targets)
    cut = hash_cutoffs(df if among is None else among, order, stratum, targets, small)
    if small:
        cut = F.broadcast(cut)
    keyed = df.withColumn("_s", F.coalesce(stratum.cast("string"), F.lit(""))).withColumn("_h", order)
    return (
        keyed.join(cut.withColumnRenamed("stratum", "_s"), "_s", "left")
        .withColumn(flag, F.coalesce(F.col("_h") <= F.col("cutoff"), F.lit(False)))
        .drop("_s", "_h", "cutoff")
    )


def stratified_split(df: DataFrame, key: str, stratum: str, fraction: float = 0.20, seed=42) -> DataFrame:
    """Adds ``is_test``: per class exactly ``round(n * fraction)`` rows."""
    s = F.col(stratum)
    targets = _class_sizes(df, s).select(
        "stratum", F.bround(F.col("n") * F.lit(float(fraction))).cast("bigint").alias("k")
    )
    return _selected(df, key, seed, s, targets, "is_test")


def three_way_split(df: DataFrame, key: str, stratum: str, test: float = 0.15, val: float = 0.15, seed=42) -> DataFrame:
    """Adds ``part`` (test / val / train) with exact class shares."""
    first = stratified_split(df, key, stratum, test, seed)
    s, rest = F.col(stratum), first.where(~F.col("is_test"))
    targets = _class_sizes(rest, s).select("stratum", F.bround(F.col("n") * F.lit(val / (1 - test))).cast("bigint").alias("k"))
    return (
        _selected(first, key, f"{seed}v", s, targets, "_val", rest)
        .withColumn(
            "part",
            F.when(F.col("is_test"), F.lit("test")).when(F.col("_val"), F.lit("val")).otherwise(F.lit("train")),
        )
        .drop("is_test", "_val")
    )


def stratified_subsample(df: DataFrame, key: str, stratum: str, max_rows: int, seed=42) -> DataFrame:
    """At most ``max_rows`` rows with the class shares kept; smaller tables pass unchanged."""
    if max_rows <= 0:
        return df
    s = F.col(stratum)
    n, total = F.col("n"), F.col("total")
    share = F.bround(n * (F.lit(float(max_rows)) / total)).cast("bigint")
    targets = _with_total(_class_sizes(df, s)).select(
        "stratum", F.when(total <= max_rows, n).otherwise(F.greatest(share, F.lit(1))).alias("k")
    )
    return _selected(df, key, seed, s, targets, "_keep").where("_keep").drop("_keep")


def kfold_stratified(df: DataFrame, key: str, stratum: str, k: int = 5, seed=42) -> DataFrame:
    """Adds ``fold`` in [0, k); classes are dealt out evenly."""
    ranked = hash_rank(df, hash_order(key, seed), F.col(stratum), "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def shuffle_split(df: DataFrame, key: str, ratio: float = 0.12, seed=42, small_is_one: bool = True) -> DataFrame:
    """Adds ``is_val``: ``max(1, floor(n * ratio))`` rows, a single one for tables of at most eight rows."""
    s = F.lit(ALL)
    size = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(ratio)))).cast("bigint")
    if small_is_one:
        size = F.when(F.col("n") > 8, size).otherwise(F.lit(1).cast("bigint"))
    targets = _class_sizes(df, s).select("stratum", size.alias("k"))
    return _selected(df, key, seed, s, targets, "is_val")


def curve_subset(df: DataFrame, key: str, stratum: str, size: int, seed=42, minimum: int = 20) -> DataFrame:
    """Nested training subset: per class ``max(minimum, round(size * share))`` rows, capped by the class."""
    s = F.col(stratum)
    want = F.greatest(F.lit(minimum), F.bround(F.lit(float(size)) * (F.col("n") / F.col("total")))).cast("bigint")
    targets = _with_total(_class_sizes(df, s)).select("stratum", F.least(want, F.col("n")).alias("k"))
    return _selected(df, key, seed, s, targets, "_keep").where("_keep").drop("_keep")


def capped_validation(df: DataFrame, key: str, stratum: str, caps: dict, seed=42) -> DataFrame:
    """At most ``caps[class]`` rows per class (the diagnostic validation set of the learning curve)."""
    s = F.col(stratum)
    cap = None
    for value, n in caps.items():
        hit = F.col("stratum") == str(value)
        cap = F.when(hit, F.lit(n)) if cap is None else cap.when(hit, F.lit(n))
    targets = _class_sizes(df, s).select("stratum", F.least(F.coalesce(cap, F.col("n")), F.col("n")).alias("k"))
    return _selected(df, key, seed, s, targets, "_keep").where("_keep").drop("_keep")


def bootstrap_subset(df: DataFrame, key: str, n: int = 300, seed=42) -> DataFrame:
    """Uniform sample of ``min(n, rows)`` rows without replacement."""
    s = F.lit(ALL)
    targets = _class_sizes(df, s).select("stratum", F.least(F.lit(n), F.col("n")).cast("bigint").alias("k"))
    return _selected(df, key, seed, s, targets, "_keep").where("_keep").drop("_keep")


def top_k(df: DataFrame, order, k: int, ties=()) -> DataFrame:
    """The k best rows (descending), ties broken by further ascending columns."""
    return df.orderBy(F.col(order).desc(), *[F.col(t).asc() for t in ties]).limit(k)
