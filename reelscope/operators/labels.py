"""Scores and labels that depend on quantiles of the whole corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions.numeric import clip, safe_float, steps
from reelscope.operators.ordering import exact_quantiles, quantile_row, with_scalars


def robust_minmax(df: DataFrame, columns, low: float = 0.02, high: float = 0.98, suffix: str = "_scaled") -> DataFrame:
    """Clip each column to two exact quantiles and scale to [0, 1]; a constant column becomes 0.

    All quantiles of all columns come out of the same passes over the table.
    """
    columns = list(columns)
    q = exact_quantiles(df, {c: safe_float(c) for c in columns}, [low, high])
    wanted = {f"{c}_{side}": (c, p) for c in columns for side, p in (("lo", low), ("hi", high))}
    return with_scalars(df, quantile_row(q, wanted), "_q").withColumns(
        {f"{c}{suffix}": _scaled(c) for c in columns}
    ).drop("_q")


def _scaled(c):
    lo, hi = F.col(f"_q.{c}_lo"), F.col(f"_q.{c}_hi")
    return F.when(hi - lo == 0, F.lit(0.0)).otherwise((clip(safe_float(c), lo, hi) - lo) / (hi - lo))


def organic_score_label(df: DataFrame, percentile: float = 0.70, weights=fv.LABEL_WEIGHTS) -> DataFrame:
    """Weighted score of robustly scaled metrics, its exact percentile and the 0/1 label.

    The input is read several times: hand in a materialised table.
    """
    scaled = robust_minmax(df, weights)
    score = reduce(lambda a, b: a + b, [F.col(f"{c}_scaled") * F.lit(w) for c, w in weights.items()])
    scored = scaled.withColumn("organic_performance_score", score).drop(*[f"{c}_scaled" for c in weights])
    cut = quantile_row(
        exact_quantiles(scored, ["organic_performance_score"], [percentile]),
        {"threshold": ("organic_performance_score", percentile)},
    )
    return (
        with_scalars(scored, cut, "_t")
        .withColumn("target_threshold", F.col("_t.threshold"))
        .withColumn(fv.TARGET, (F.col("organic_performance_score") >= F.col("_t.threshold")).cast("int"))
        .drop("_t")
    )


def performance_tercile(df: DataFrame, *, skip="skip_rate", full="full_watch_rate", log_views="log_viewCount", digits: int | None = None) -> DataFrame:
    """Performance score, right-closed tercile label and the binary upper-tercile label.

    With ``digits`` the score is rounded before the cuts are taken, so that equal scores whose last bits differ share a side.
    """
    top = df.agg(F.max(log_views).alias("m"))
    score = (
        (F.lit(1.0) - clip(F.col(skip), 0.0, 1.0)) * 0.40
        + clip(F.col(full), 0.0, 1.0) * 0.40
        + F.col(log_views) / F.col("_m.m") * 0.20
    )
    score = score if digits is None else F.round(score, digits)
    scored = with_scalars(df, top, "_m").withColumn("perf_score", score).drop("_m")
    q = quantile_row(
        exact_quantiles(scored, ["perf_score"], [0.333, 0.666]),
        {"p33": ("perf_score", 0.333), "p66": ("perf_score", 0.666)},
    )
    s = F.col("perf_score")
    return (
        with_scalars(scored, q, "_q")
        .withColumn("performance_potential", steps(s, ((F.col("_q.p33"), "bajo"), (F.col("_q.p66"), "medio")), "alto"))
        .withColumn("high_performance", (s >= F.col("_q.p66")).cast("int"))
        .drop("_q")
    )
