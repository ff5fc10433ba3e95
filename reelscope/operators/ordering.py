"""Exact order statistics and ranks without a single-task sort.

Values (or hashes) are first counted per coarse, order-preserving bucket.
The small table of bucket counts tells which bucket holds each wanted rank;
only the rows of those buckets are then ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANTISSA_STEPS = 2048
HASH_PREFIX = 3  # 16 ** 3 hash buckets per stratum


def value_bucket(x: Column) -> Column:
    """Monotone bucket number of a double: binary exponent plus ``MANTISSA_STEPS`` slices of the mantissa."""
    a = F.abs(x)
    e = F.floor(F.log2(a))
    slot = F.floor((a / F.pow(F.lit(2.0), e) - 1.0) * MANTISSA_STEPS)
    magnitude = ((e + 1100) * MANTISSA_STEPS + slot).cast("bigint") + 1
    return F.when(a == 0, F.lit(0).cast("bigint")).otherwise(F.signum(x).cast("bigint") * magnitude)


def exact_quantiles(df: DataFrame, columns, probabilities) -> DataFrame:
    """Linear-interpolation quantiles, one row per (column, probability); nulls are ignored.

    ``columns`` maps an output name to a Column (or is a list of names);
    ``probabilities`` is a list of numbers or an array Column.
    """
    spec = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    names = list(spec)
    # A guarded log: zero has no exponent and is handled by the bucket function itself.
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), spec[n].cast("double").alias("value")) for n in names])
    long = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.column", F.col("p.value").alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("bucket", value_bucket(F.col("value")))
    )
    return _quantiles_from_long(long, probabilities)


def _quantiles_from_long(long: DataFrame, probabilities) -> DataFrame:
    counts = long.groupBy("column", "bucket").agg(F.count("*").alias("n"))
    by_bucket = Window.partitionBy("column").orderBy("bucket")
    running = counts.select(
        "column",
        "bucket",
        (F.sum("n").over(by_bucket) - F.col("n")).alias("before"),
        "n",
        F.sum("n").over(Window.partitionBy("column")).alias("total"),
    )
    probs = probabilities
    if not isinstance(probs, Column):
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
    at = F.col("prob") * (F.col("total") - 1)
    wanted = running.select("*", F.explode(probs).alias("prob")).select(
        "column", "bucket", "before", "n", "prob", (at - F.floor(at)).alias("part"),
        F.floor(at).alias("k0"), F.ceil(at).alias("k1"),
    )
    ranks = wanted.select(
        "column", "bucket", "before", "n", "prob", "part",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("k0").alias("k")),
                          F.struct(F.lit(1).alias("side"), F.col("k1").alias("k")))).alias("r"),
    ).select("column", "bucket", "before", "prob", "part", "r.side", "r.k", "n").where(
        (F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n"))
    )
    targets = ranks.groupBy("column", "bucket").agg(
        F.first("before").alias("before"), F.collect_list(F.struct("prob", "part", "side", "k")).alias("ranks")
    )
    # At most two buckets per wanted quantile: the size of this side is fixed by the request.
    inside = long.join(F.broadcast(targets.select("column", "bucket")), ["column", "bucket"], "left_semi")
    values = inside.groupBy("column", "bucket", "value").agg(F.count("*").alias("n"))
    by_value = Window.partitionBy("column", "bucket").orderBy("value")
    ordered = values.withColumn("upto", F.sum("n").over(by_value)).join(
        F.broadcast(targets), ["column", "bucket"]
    )
    picked = ordered.select(
        "column", "value", (F.col("before") + F.col("upto") - F.col("n")).alias("low"),
        (F.col("before") + F.col("upto")).alias("high"), F.explode("ranks").alias("r"),
    ).where((F.col("r.k") >= F.col("low")) & (F.col("r.k") < F.col("high")))
    return picked.groupBy("column", F.col("r.prob").alias("prob")).agg(
        (
            F.max(F.when(F.col("r.side") == 0, F.col("value")))
            + F.max("r.part")
            * (F.max(F.when(F.col("r.side") == 1, F.col("value"))) - F.max(F.when(F.col("r.side") == 0, F.col("value"))))
        ).alias("quantile")
    )


def quantile_row(quantiles: DataFrame, wanted: dict) -> DataFrame:
    """One-row table from a long quantile table: ``{output name: (column, probability)}``."""
    return quantiles.agg(
        *[
            F.max(F.when((F.col("column") == c) & (F.col("prob") == float(p)), F.col("quantile"))).alias(name)
            for name, (c, p) in wanted.items()
        ]
    )


def with_scalars(df: DataFrame, stats: DataFrame, name: str = "stats") -> DataFrame:
    """Attach a one-row table as a struct column through a scalar subquery (evaluated once)."""
    return df.withColumn(name, stats.select(F.struct(*stats.columns).alias(name)).scalar())


def hash_order(key, seed) -> Column:
    """Deterministic pseudo-random order: hexadecimal MD5 of key and seed."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string") if isinstance(key, str) else key, F.lit(str(seed))))


def _stratum(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def hash_cutoffs(df: DataFrame, order: Column, stratum: Column, targets: DataFrame, small: bool = False) -> DataFrame:
    """Hash value of the k-th row of each stratum: (stratum, cutoff).

    ``targets`` has (stratum as text, k); k = 0 gives no row.  Only hash prefixes are
    counted for all rows and only one prefix per stratum is ordered. ``small``: the caller has checked that the strata
    are few, so that one row for each may be broadcast.
    """
    keyed = df.select(_stratum(stratum).alias("stratum"), order.alias("h")).withColumn("bucket", F.substring("h", 1, HASH_PREFIX))
    counts = keyed.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    running = counts.withColumn(
        "upto", F.sum("n").over(Window.partitionBy("stratum").orderBy("bucket"))
    ).withColumn("before", F.col("upto") - F.col("n"))
    edge = (
        running.join(F.broadcast(targets) if small else targets, "stratum")
        .where((F.col("k") > F.col("before")) & (F.col("k") <= F.col("upto")))
        .select("stratum", "bucket", (F.col("k") - F.col("before")).alias("rest"))
    )
    ranked = keyed.join(F.broadcast(edge) if small else edge, ["stratum", "bucket"]).withColumn(
        "r", F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h"))
    )
    return ranked.where(F.col("r") == F.col("rest")).select("stratum", F.col("h").alias("cutoff"))


def hash_rank(df: DataFrame, order: Column, stratum: Column, name: str = "rank") -> DataFrame:
    """Exact 1-based position in hash order per stratum, ranked bucket by bucket."""
    keyed = df.withColumn("_s", _stratum(stratum)).withColumn("_h", order).withColumn("_b", F.substring("_h", 1, HASH_PREFIX))
    counts = keyed.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        "_s", "_b", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_n")).alias("_o")
    )
    inner = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h")))
    return (
        inner.join(offsets, ["_s", "_b"])
        .withColumn(name, (F.col("_o") + F.col("_r")).cast("bigint"))
        .drop("_s", "_h", "_b", "_n", "_o", "_r")
    )


def running_totals(df: DataFrame, group: list[str], value: str, sums: list[str], *, descending: bool = False) -> DataFrame:
    """Inclusive running sums over the distinct values of a numeric column, per group.

    Expects one row per (group, value).  Adds ``cum_<name>`` per summed column.
    """
    sign = -1 if descending else 1
    keyed = df.withColumn("_b", value_bucket(F.col(value)) * sign)
    per_bucket = keyed.groupBy(*group, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    across = Window.partitionBy(*group).orderBy("_b")
    offsets = per_bucket.select(
        *group, "_b", *[(F.sum(f"_t_{c}").over(across) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in sums]
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    within = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = keyed.select("*", *[F.sum(c).over(within).alias(f"_w_{c}") for c in sums])
    return inner.join(offsets, [*group, "_b"]).select(
        *df.columns, *[(F.col(f"_o_{c}") + F.col(f"_w_{c}")).alias(f"cum_{c}") for c in sums]
    )


def previous_value(df: DataFrame, keys: list[str], order: str, value: str, name: str, *, chunk: int = 512) -> DataFrame:
    """``lag(value)`` by a numeric order, computed per chunk of the order so that no key fills one task."""
    keyed = df.withColumn("_c", F.floor(F.col(order) / F.lit(chunk)).cast("bigint"))
    last = keyed.groupBy(*keys, "_c").agg(F.max_by(value, order).alias("_last"))
    carry = last.select(
        *keys, "_c", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_c")).alias("_carry")
    )
    inner = keyed.withColumn("_p", F.lag(value).over(Window.partitionBy(*keys, "_c").orderBy(order)))
    first = F.row_number().over(Window.partitionBy(*keys, "_c").orderBy(order)) == 1
    return (
        inner.withColumn("_f", first)
        .join(carry, [*keys, "_c"])
        .withColumn(name, F.when(F.col("_f"), F.col("_carry")).otherwise(F.col("_p")))
        .drop("_c", "_p", "_f", "_carry")
    )
