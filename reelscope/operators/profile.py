"""Descriptive profiles of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.operators.ordering import exact_quantiles


def _coerced(c):
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def profile_stats(df: DataFrame, columns=fv.PROFILE_COLUMNS) -> DataFrame:
    """Per column: count, mean, sample deviation, minimum, three quartiles, maximum (long form)."""
    columns = [c for c in columns if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _coerced(c).alias("value")) for c in columns])
    basic = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.column", F.col("p.value").alias("value"))
        .groupBy("column")
        .agg(
            F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max"),
        )
        .where(F.col("count") > 0)
    )
    q = exact_quantiles(df, {c: _coerced(c) for c in columns}, [0.25, 0.5, 0.75]).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    )
    return basic.join(q, "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with nulls: number and share, most first."""
    one = df.agg(
        F.count("*").alias("_rows"), *[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns]
    )
    long = one.unpivot(["_rows"], list(df.columns), "column", "nulls")
    return (
        long.where(F.col("nulls") > 0)
        .select("column", "nulls", (F.col("nulls") / F.col("_rows")).alias("null_fraction"))
        .orderBy(F.col("nulls").desc(), "column")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each fully identical group (one row)."""
    # A 256-bit digest stands for the row, so that wide rows are not shuffled; a row copied very often is counted first.
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    per_row = df.groupBy(row.alias("_row")).agg(F.count("*").alias("_n"))
    return per_row.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def top_share(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """Most frequent values and their share of the non-null rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count("*").alias("n")
    )
    shares = counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())
    return shares.orderBy(F.col("n").desc(), "value").limit(k)


def class_balance(df: DataFrame, target: str = fv.TARGET, flags=("cta_flag", "promo_flag")) -> DataFrame:
    """Share of each class and mean of the flags within it."""
    per = df.groupBy(target).agg(
        F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias(f"{f}_mean") for f in flags if f in df.columns]
    )
    return per.withColumn("share", F.col("n") / per.agg(F.sum("n")).scalar())


def dataset_kind(df: DataFrame, file_column: str = "source_file", override=None) -> DataFrame:
    """One row: provenance inferred from the file names, unless overridden."""
    if override in ("synthetic", "real", "real_kaggle", "real_or_mixed"):
        return df.sparkSession.range(1).select(F.lit(override).alias("dataset_kind"))
    name = F.lower(F.col(file_column))
    marked = None
    for m in fv.REAL_SOURCE_MARKERS:
        marked = name.contains(m) if marked is None else marked | name.contains(m)
    facts = df.agg(
        F.count(file_column).alias("n"), F.bool_and(name.contains("demo")).alias("demo"), F.bool_or(marked).alias("real")
    )
    return facts.select(
        F.when(F.col("n") == 0, F.lit("unknown"))
        .when(F.col("demo"), F.lit("synthetic"))
        .when(F.col("real"), F.lit("real_kaggle"))
        .otherwise(F.lit("real_or_mixed"))
        .alias("dataset_kind")
    )


def downsample_manifest(before: DataFrame, after: DataFrame, dataset: str) -> DataFrame:
    """Per dataset: original rows, kept rows and columns preserved."""
    left = before.groupBy(F.col(dataset).alias("dataset")).agg(F.count("*").alias("original_rows"))
    right = after.groupBy(F.col(dataset).alias("dataset")).agg(F.count("*").alias("kept_rows"))
    kept = len(set(before.columns) & set(after.columns))
    return left.join(right, "dataset", "left").select(
        "dataset", "original_rows", F.coalesce("kept_rows", F.lit(0)).alias("kept_rows"),
        F.lit(kept).alias("columns_preserved"),
    )


def dataset_summary(df: DataFrame, *, target: str = fv.TARGET, percentile: float = 0.70) -> DataFrame:
    """One nested row: size, provenance, duplicates, nulls, statistics, flags, categories and label balance."""
    stats = profile_stats(df)
    nulls = null_profile(df)
    top = top_share(df, "category_id")
    balance = class_balance(df, target)
    head = df.agg(
        F.count("*").alias("rows"),
        F.round(F.avg(F.col("cta_flag").cast("double")), 4).alias("cta_flag_mean"),
        F.round(F.avg(F.col("promo_flag").cast("double")), 4).alias("promo_flag_mean"),
        F.max("target_threshold").alias("target_threshold"),
        # One entry per input file, bounded by the number of sources.
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
    )

    def packed(table, key, value):
        entry = F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))
        return table.agg(F.map_from_entries(F.array_sort(F.collect_list(entry)))).scalar()

    return head.select(
        dataset_kind(df).scalar().alias("dataset_kind"),
        "source_files",
        "rows",
        F.lit(len(df.columns)).alias("cols"),
        F.lit(df.columns).alias("columns"),
        duplicate_count(df).scalar().alias("duplicates"),
        packed(nulls, "column", F.col("nulls")).alias("missing"),
        packed(stats, "column", F.struct(*[c for c in stats.columns if c != "column"])).alias("stats"),
        "cta_flag_mean",
        "promo_flag_mean",
        packed(top, "value", F.col("share")).alias("category_top_share"),
        F.lit(target).alias("target"),
        "target_threshold",
        F.lit(float(percentile)).alias("target_percentile"),
        packed(balance, target, F.col("share")).alias("target_balance"),
    )
