"""Paid-campaign niche, cost and funnel estimates over a table of videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions import text as T
from reelscope.functions.numeric import clip, lookup, safe_float
from reelscope.functions.temporal import as_timestamp, calendar_parts, season
from reelscope.functions.terms import TermIndex
from reelscope.operators import messages as msg
from reelscope.operators.normalize import category_map
from reelscope.session import few

_NICHES = TermIndex(fv.NICHE_TERMS)


def ad_niche(df: DataFrame, *, forced: str | None = "ad_category", name: str = "ad_niche") -> DataFrame:
    """Chosen category if valid, else the niche with most term hits (first wins ties), else general."""
    have = set(df.columns)
    parts = [c for c in ("title", "description", "transcript_text", "ocr_text") if c in have]
    base = df.withColumn("_f", _NICHES.scan(T.corpus_text(*parts)))
    ranked = F.array(*[
        F.struct(_NICHES.hits("_f", k).alias("hits"), F.lit(-i).alias("pos"), F.lit(k).alias("niche"))
        for i, k in enumerate(fv.NICHE_TERMS)
    ])
    base = base.withColumn("_best", F.array_max(ranked))
    inferred = F.when(F.col("_best.hits") > 0, F.col("_best.niche")).otherwise(F.lit(fv.NICHE_DEFAULT))
    own = category_map(forced) if forced and forced in have else F.lit(None).cast("string")
    return base.withColumn(name, F.coalesce(own, inferred)).drop("_f", "_best")


def ad_channel(niche: Column) -> Column:
    return F.when(
        niche.isin("retail/ecommerce", "entretenimiento", "gastronomía"), F.lit("Instagram")
    ).otherwise(F.lit("Facebook"))


def ad_type(niche: Column, promo_flag: Column, price_flag: Column) -> Column:
    discount = (safe_float(promo_flag) != 0) | (safe_float(price_flag) != 0)
    return (
        F.when(
            niche.isin("retail/ecommerce", "servicios", "gastronomía", "inmobiliario"),
            F.when(discount, F.lit("Discount")).otherwise(F.lit("Collection")),
        )
        .when(niche == "educación", F.lit("Story"))
        .when(niche == "entretenimiento", F.lit("Video"))
        .otherwise(F.lit("Brand"))
    )


def niche_cpm(df: DataFrame, table: DataFrame | None = None, niche: str = "ad_niche") -> DataFrame:
    """Base cost per mille of the niche; a dimension table (niche, base_cpm) may replace the fixed one."""
    default = fv.NICHE_BASE_CPM[fv.NICHE_DEFAULT]
    if table is None:
        return df.withColumn("base_cpm", lookup(F.col(niche), fv.NICHE_BASE_CPM, default))
    side = table.select(F.col("niche").alias(niche), "base_cpm")
    joined = df.join(F.broadcast(side) if few(side) else side, niche, "left")
    return joined.withColumn("base_cpm", F.coalesce("base_cpm", F.lit(default)))


def _live_rates(df: DataFrame) -> dict[str, Column]:
    """Counts and rates shared by the feature row and the cost rule."""
    v, l, c = (F.greatest(safe_float(x), F.lit(0.0)) for x in ("views", "likes", "comments"))
    er = safe_float("engagement_rate")
    er = F.when((er <= 0) & (v > 0), (l + c) / v).otherwise(er)
    hours = F.greatest(safe_float("hours_since_publication", 24.0), F.lit(1.0))
    return {
        "v": v, "l": l, "c": c, "er": er, "ret": safe_float("retention_rate"), "hours": hours,
        "vph": F.when(v != 0, v / hours).otherwise(F.lit(0.0)),
    }


def paid_feature_table(df: DataFrame, as_of) -> DataFrame:
    """Campaign row per video: model inputs, priors and live signals; expects ``ad_niche``."""
    r = _live_rates(df)
    have = set(df.columns)
    parts = calendar_parts(as_timestamp(as_of))
    niche = F.col("ad_niche")

    def opt(c):
        return safe_float(c) if c in have else F.lit(0.0)

    picked = F.coalesce(F.nullif(T.text("ad_category"), F.lit("")), F.lit("auto")) if "ad_category" in have else F.lit("auto")
    row = {
        "source_dataset": F.lit("onyx_marketing_campaign"),
        "campaign": season(parts["month"]),
        "channel": ad_channel(niche),
        "device": F.lit("Mobile"),
        "ad_type": ad_type(niche, F.col("promo_flag"), F.col("price_flag")),
        "age": F.lit("unknown"),
        "gender": F.lit("unknown"),
        "city": F.lit("unknown"),
        "campaign_numeric_id": F.lit(0.0),
        "ad_numeric_id": F.lit(0.0),
        "interest": F.lit(0.0),
        "month": parts["month"].cast("double"),
        "weekday": parts["iso_weekday"].cast("double"),
        "ctr_prior": clip(r["er"], 0.001, 0.20),
        "cvr_prior": clip(r["ret"] * 0.12, 0.001, 0.30),
        "ad_niche": niche,
        "selected_ad_category": picked,
        "views": r["v"],
        "likes": r["l"],
        "comments": r["c"],
        "engagement_rate": r["er"],
        "retention_rate": clip(r["ret"], 0.0, 1.0),
        "hours_since_publication": r["hours"],
        "views_per_hour": r["vph"],
        "duration_seconds": F.greatest(safe_float("duration_seconds"), F.lit(0.0)),
        "followers_count": opt("followers_count"),
        "avg_channel_reach": opt("avg_channel_reach"),
    }
    return df.select("video_id", *[v.alias(k) for k, v in row.items()])


def paid_quality(probability, engagement, retention, views_per_hour, duration) -> Column:
    return (
        clip(probability, 0.0, 1.0) * 0.42
        + clip(engagement / 0.075, 0.0, 1.0) * 0.23
        + clip(retention / 0.62, 0.0, 1.0) * 0.22
        + clip(views_per_hour / 700.0, 0.0, 1.0) * 0.09
        + clip((F.lit(75.0) - F.least(duration, F.lit(75.0))) / 75.0, 0.0, 1.0) * 0.04
    )


def cost_fingerprint(df_columns=None) -> Column:
    """Canonical text of the inputs that seeds the deterministic jitter."""
    v, h = F.col("_v"), F.col("_hours")
    views = F.when(v >= 100, F.format_string("%.1f", F.bround(v, -2))).otherwise(v.cast("string"))
    return F.concat_ws(
        "|",
        T.text("title"), T.text("description"), F.col("ad_niche"),
        F.concat(F.lit("v"), views),
        F.format_string("e%.4f", F.col("_er")),
        F.format_string("r%.4f", F.col("_ret")),
        F.format_string("h%.1f", h),
        F.format_string("p%.4f", F.col("probability")),
    )


def dynamic_cpm(df: DataFrame) -> DataFrame:
    """Adds ``quality`` (0-1) and ``rules_cpm_raw``: base cost times quality, threshold factors and jitter.

    Expects probability, budget, the feature columns, ``ad_niche`` and ``base_cpm``.
    """
    r = _live_rates(df)
    base = df.withColumns(
        {
            "_v": r["v"],
            "_er": clip(r["er"], 0.0, 0.25),
            "_ret": clip(r["ret"], 0.0, 1.0),
            "_hours": r["hours"],
            "_vph": r["vph"],
            "_dur": F.greatest(safe_float("duration_seconds", 30.0), F.lit(1.0)),
            "_budget": safe_float("budget"),
        }
    )
    p, er, ret, vph, b = (F.col(c) for c in ("probability", "_er", "_ret", "_vph", "_budget"))
    base = base.withColumn("quality", paid_quality(p, er, ret, vph, F.col("_dur")))
    one = F.lit(1.0)
    factors = (
        F.when(p >= 0.75, 0.93).when(p < 0.40, 1.10).otherwise(one),
        F.when(er >= 0.08, 0.92).when(er < 0.015, 1.13).otherwise(one),
        F.when(ret >= 0.60, 0.93).when((ret != 0) & (ret < 0.25), 1.12).otherwise(one),
        F.when(vph >= 1000, 0.94).when(vph < 50, 1.06).otherwise(one),
        F.when(b >= 100, 1.06).when((b > 0) & (b <= 20), 0.97).otherwise(one),
        F.when(F.col("_v") < 100, 1.08).otherwise(one),
    )
    cpm = F.col("base_cpm") * (F.lit(1.30) - clip(F.col("quality"), 0.0, 1.0) * 0.42)
    for f in factors:
        cpm = cpm * f
    base = base.withColumn("rules_jitter", T.stable_jitter(cost_fingerprint(), fv.CPM_JITTER_SPAN, "general"))
    return base.withColumn(
        "rules_cpm_raw", clip(cpm * F.col("rules_jitter"), fv.CPM_FLOOR, fv.CPM_CEILING)
    )


def paid_funnel(df: DataFrame) -> DataFrame:
    """View-through and click rates, impressions, paid views, clicks and the 0-100 rule score."""
    q, er, b, cpm = F.col("quality"), F.col("_er"), F.col("_budget"), F.col("rules_cpm_raw")
    vtr = clip(q * 0.34 + 0.10, 0.08, 0.48)
    ctr = clip(er * 0.40 + q * 0.020 + 0.004, 0.003, 0.085)
    impressions = F.when(b > 0, b / cpm * 1000).otherwise(F.lit(0.0))
    score = clip(F.col("probability") * 44 + q * 30 - cpm / 18.0 * 7 + 32, 0.0, 100.0)
    return df.withColumns(
        {
            "rules_quality_score": F.round(q * 100, 2),
            "rules_cpm": F.round(cpm, 4),
            "rules_paid_performance_score": F.round(score, 2),
            "estimated_view_through_rate": F.round(vtr, 4),
            "estimated_ctr": F.round(ctr, 4),
            "rules_budget_impressions": F.round(impressions, 0),
            "rules_paid_views": F.round(impressions * vtr, 0),
            "rules_clicks": F.round(impressions * ctr, 0),
        }
    )


def paid_blend(df: DataFrame, *, model_score: str | None = None, model_cpm: str | None = None, name: str = "paid") -> DataFrame:
    """Adds a struct: gate, blended score and cost, per-dollar metrics and advice.

    Null model columns (or none at all) fall back to the rules.
    """
    ms = F.col(model_score).cast("double") if model_score else F.lit(None).cast("double")
    mc = F.col(model_cpm).cast("double") if model_cpm else F.lit(None).cast("double")
    rs, rc = F.col("rules_paid_performance_score"), F.col("rules_cpm")
    both, score_only = ms.isNotNull() & mc.isNotNull(), ms.isNotNull()
    raw_s, raw_c = clip(ms, 0.0, 100.0), clip(mc, 1.0, 25.0)
    base = df.withColumns(
        {
            "_score": F.when(both, clip(raw_s * 0.55 + rs * 0.45, 0.0, 100.0))
            .when(score_only, clip(raw_s * 0.60 + rs * 0.40, 0.0, 100.0))
            .otherwise(rs),
            "_cpm": F.when(both, clip(raw_c * 0.35 + rc * 0.65, fv.CPM_FLOOR, fv.CPM_CEILING)).otherwise(rc),
            "_method": F.when(both, F.lit("modelo_dos_objetivos+reglas"))
            .when(score_only, F.lit("modelo_puntaje+reglas"))
            .otherwise(F.lit("reglas")),
        }
    )
    p, s, c = F.col("probability"), F.col("_score"), F.col("_cpm")
    gate = p >= fv.GATE_THRESHOLD
    b = F.greatest(F.col("_budget"), F.lit(0.0))
    vtr, ctr = F.col("estimated_view_through_rate"), F.col("estimated_ctr")
    impressions = F.when((b > 0) & (c > 0), b / c * 1000).otherwise(F.lit(0.0))
    per_dollar = F.when(c > 0, F.lit(1000.0) / c).otherwise(F.lit(0.0))
    block = F.struct(
        gate.alias("eligible_for_paid"),
        gate.alias("gate_passed"),
        F.lit(fv.GATE_THRESHOLD).alias("gate_threshold"),
        F.round(p, 4).alias("logistic_probability"),
        F.col("ad_niche").alias("ad_niche"),
        F.round(ms, 4).alias("raw_paid_performance_score"),
        F.round(mc, 4).alias("raw_cpm"),
        rc.alias("rules_cpm"),
        F.col("rules_quality_score").alias("rules_quality_score"),
        rs.alias("rules_paid_performance_score"),
        F.round(s, 2).alias("predicted_paid_performance_score"),
        F.round(c, 4).alias("predicted_cpm"),
        F.round(c, 4).alias("estimated_cost_per_1000_impressions"),
        F.round(per_dollar, 2).alias("estimated_impressions_per_dollar"),
        F.round(per_dollar * vtr, 2).alias("estimated_paid_views_per_dollar"),
        F.round(impressions, 0).alias("estimated_budget_impressions"),
        F.round(impressions * vtr, 0).alias("estimated_paid_views"),
        F.round(impressions * ctr, 0).alias("estimated_clicks"),
        vtr.alias("estimated_view_through_rate"),
        ctr.alias("estimated_ctr"),
        paid_advice(gate, s, c, F.col("rules_quality_score")).alias("recommendation"),
        F.col("_method").alias("calibration_method"),
    )
    return base.withColumn(name, block).drop("_score", "_cpm", "_method")


def paid_advice(gate: Column, score: Column, cpm: Column, quality: Column) -> Column:
    return (
        F.when(~gate, F.lit(msg.PAID_NOT_YET))
        .when((score >= 70) & (cpm <= 8), F.lit(msg.PAID_VIABLE))
        .when(score >= 58, F.lit(msg.PAID_MODERATE))
        .when(quality >= 55, F.lit(msg.PAID_CREATIVE))
        .otherwise(F.lit(msg.PAID_RISK))
    )


def paid_estimate(df: DataFrame, *, model_score=None, model_cpm=None) -> DataFrame:
    """Niche, base cost, dynamic cost, funnel and blend in one projection chain."""
    chain = paid_funnel(dynamic_cpm(niche_cpm(ad_niche(df))))
    out = paid_blend(chain, model_score=model_score, model_cpm=model_cpm)
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])
