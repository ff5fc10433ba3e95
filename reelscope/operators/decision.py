"""Probability, hybrid score, final action, projections and executive views."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions import text as T
from reelscope.functions.arrays import append_unique, build_array, flag_union, or_default, text_array
from reelscope.functions.numeric import avg_positive, clip, clip_probability, clip_rate, lookup, minmax_clip, safe_float
from reelscope.operators import messages as msg

REVIEW = "REVISIÓN HUMANA"
ADJUST = "AJUSTAR ANTES DE IMPULSAR"
BOOST = "IMPULSAR"
NO = "NO IMPULSAR"


def heuristic_probability(df: DataFrame) -> Column:
    """Fall-back probability from text power, engagement, pace, duration fit and screen-text coverage."""
    p = (
        safe_float("text_power_score") * 0.30
        + F.least(safe_float("engagement_rate") / 0.10, F.lit(1.0)) * 0.22
        + F.least(safe_float("views_per_day") / 1000.0, F.lit(1.0)) * 0.18
        + safe_float("duration_fit_score", 0.5) * 0.08
        + (F.least(safe_float("ocr_frame_coverage"), F.lit(1.0)) * 0.04 if "ocr_frame_coverage" in df.columns else F.lit(0.0))
        + 0.18
    )
    return F.round(clip_probability(p), 4)


def probability_level(p: Column) -> Column:
    chain = None
    for name, cut in fv.LEVEL_CUTS:
        chain = F.when(p >= cut, F.lit(name)) if chain is None else chain.when(p >= cut, F.lit(name))
    return chain.otherwise(F.lit("bajo"))


def score_videos(df: DataFrame, model=None) -> DataFrame:
    """Adds probability, level and ``model_available``; without a model the heuristic answers."""
    if model is None:
        p, available = heuristic_probability(df), False
        out = df.withColumn("probability", p)
    else:
        from pyspark.ml.functions import vector_to_array

        from reelscope.operators.normalize import ensure_columns

        kept = df.columns
        scored = model.transform(ensure_columns(df.drop("probability")))
        p = F.round(clip_probability(vector_to_array("probability")[1]), 4)
        out = scored.select(*[c for c in kept if c != "probability"], p.alias("probability"))
        available = True
    return out.withColumns(
        {"level": probability_level(F.col("probability")), "model_available": F.lit(available)}
    )


def reach_per_dollar(level: Column, cpm) -> dict[str, Column]:
    c = F.greatest(safe_float(cpm, fv.DEFAULT_CPM), F.lit(0.01))
    base = F.lit(1000.0) / c
    mult = lookup(level, fv.LEVEL_MULTIPLIER, 1.0)
    return {
        "cpm_estimado": F.round(c, 4),
        "multiplicador_potencial": mult,
        "alcance_base_por_dolar": F.round(base, 2),
        "alcance_estimado_por_dolar": F.round(base * mult, 2),
    }


def hybrid_score(probability, engagement_rate, retention_rate, views_per_hour, policy_level, share_rate=None, weights=fv.HYBRID_WEIGHTS) -> Column:
    """struct(score_base, policy_penalty, hybrid_score, components)."""
    p = clip(safe_float(probability), 0.0, 1.0)
    er = minmax_clip(safe_float(engagement_rate), 0.0, 0.15)
    rr = minmax_clip(safe_float(retention_rate), 0.0, 1.0)
    vph = minmax_clip(F.log1p(F.greatest(safe_float(views_per_hour), F.lit(0.0))), 0.0, math.log1p(1000.0))
    share_weight = weights["share_rate"]
    sr = clip(safe_float(share_rate), 0.0, 1.0) if share_rate is not None and share_weight else F.lit(0.0)
    base = (
        p * weights["model_probability"] + er * weights["engagement_rate"] + rr * weights["retention_rate"]
        + vph * weights["views_per_hour"]
    )
    if share_weight:
        base = base + sr * share_weight
    penalty = lookup(policy_level, fv.SCORE_PENALTY, fv.SCORE_PENALTY_DEFAULT)
    return F.struct(
        F.round(base, 4).alias("score_base"),
        penalty.alias("policy_penalty"),
        F.round(base * penalty, 4).alias("hybrid_score"),
        F.struct(
            F.round(p, 4).alias("model_probability"),
            F.round(er, 4).alias("engagement_rate_norm"),
            F.round(sr, 4).alias("share_rate_norm"),
            F.round(rr, 4).alias("retention_rate_norm"),
            F.round(vph, 4).alias("views_per_hour_norm"),
        ).alias("components"),
    )


def final_action(score, policy_level, requires_adjustments, missing_transcript=None, has_text=None) -> Column:
    """Priority rules with four reachable outcomes."""
    s = safe_float(score)
    missing = missing_transcript if missing_transcript is not None else F.lit(False)
    text = has_text if has_text is not None else F.lit(True)
    return (
        F.when((policy_level == "revisión humana") | (missing & ~text), F.lit(REVIEW))
        .when(policy_level == "alto", F.lit(NO))
        .when((s >= 0.65) & ~requires_adjustments & (policy_level == "bajo"), F.lit(BOOST))
        .when((s >= 0.55) & policy_level.isin("bajo", "medio"), F.lit(ADJUST))
        .when(s >= 0.42, F.lit(ADJUST))
        .otherwise(F.lit(NO))
    )


def _on(c) -> Column:
    return safe_float(c) != 0


def required_adjustments() -> Column:
    """Up to five ordered messages from the feature columns."""
    return build_array(
        (~_on("cta_flag") & ~_on("ocr_cta_flag"), msg.ADJUST_CTA),
        ((safe_float("ocr_word_count") > 35) & (safe_float("duration_seconds") <= 10), msg.ADJUST_SCREEN_TEXT),
        (~_on("benefit_flag"), msg.ADJUST_BENEFIT),
        (safe_float("duration_seconds") > 60, msg.ADJUST_LENGTH),
        ((T.text("transcript_text") == "") & (T.text("ocr_text") == ""), msg.ADJUST_TRANSCRIPT),
    )


def public_recommendation(level: Column, adjust: Column) -> tuple[Column, Column]:
    high = level.isin("alto", "muy_alto")
    label = (
        F.when(high & ~adjust, F.lit("impulsar"))
        .when(high | (level == "medio"), F.lit("ajustar antes de impulsar"))
        .otherwise(F.lit("no impulsar"))
    )
    priority = F.when(high, F.lit("alta")).when(level == "medio", F.lit("media")).otherwise(F.lit("baja"))
    return label, priority


def recommendation(df: DataFrame, *, cpm="cpm", budget="budget", policy="policy", name: str = "recommendation") -> DataFrame:
    """Adds the full recommendation struct.

    Expects probability, level, features, ops (retention_rate, views_per_hour),
    the policy struct, ``transcript_ok`` and ``has_text``.
    """
    base = df.withColumn("_adj", required_adjustments())
    adjust = F.size("_adj") > 0
    level = F.col("level")
    pl = F.col(f"{policy}.policy_risk_level")
    base = base.withColumn(
        "_h", hybrid_score("probability", "engagement_rate", "retention_rate", "views_per_hour", pl)
    )
    reach = reach_per_dollar(level, cpm)
    b = F.greatest(safe_float(budget), F.lit(0.0))
    label, priority = public_recommendation(level, adjust)
    action = final_action(F.col("_h.hybrid_score"), pl, adjust, ~F.col("transcript_ok"), F.col("has_text"))
    base = base.withColumns({f"_{k}": v for k, v in reach.items()})
    why = F.concat_ws(
        " ",
        F.concat(
            F.lit("Nivel "), level, F.lit(", probabilidad "),
            F.format_string("%.2f%%", F.col("probability") * 100), F.lit("."),
        ),
        F.when(T.text("transcript_text") != "", F.lit("Con transcripción.")),
        F.when(T.text("ocr_text") != "", F.lit("Con texto en pantalla.")),
        F.when(adjust, F.lit("Hay ajustes pendientes.")).otherwise(F.lit("Sin ajustes pendientes.")),
        F.concat(F.lit("Riesgo de política: "), pl, F.lit(" ("), F.col(f"{policy}.youtube_ad_status_estimate"), F.lit(").")),
        F.concat(
            F.lit("Puntaje "), F.format_string("%.2f", F.col("_h.hybrid_score")),
            F.lit(", penalización x"), F.col("_h.policy_penalty").cast("string"), F.lit("."),
        ),
    )
    block = F.struct(
        level.alias("prediccion_rendimiento"),
        F.round("probability", 4).alias("probabilidad_rendimiento"),
        label.alias("recomendacion_impulso"),
        adjust.alias("requiere_ajustes"),
        priority.alias("nivel_prioridad"),
        F.col("_adj").alias("ajustes_sugeridos"),
        *[F.col(f"_{k}").alias(k) for k in reach],
        F.when(b != 0, F.round(F.col("_alcance_estimado_por_dolar") * b, 2)).otherwise(F.lit(0.0)).alias("alcance_estimado_total"),
        action.alias("accion_final"),
        F.col("_h.hybrid_score").alias("score_hibrido"),
        F.col("_h").alias("score_hibrido_detalle"),
        pl.alias("policy_risk_level"),
        F.col(f"{policy}.youtube_ad_status_estimate").alias("youtube_ad_status_estimate"),
        why.alias("justificacion"),
    )
    return base.withColumn(name, block).drop("_adj", "_h", *[f"_{k}" for k in reach])


def expected_metrics(df: DataFrame, predicted: dict | None = None) -> dict[str, Column]:
    """Model outputs where given, else current rates; 0 counts as missing."""
    if predicted:
        return {
            "expected_views_per_day": F.greatest(safe_float(predicted["views_per_day"]), F.lit(0.0)),
            "expected_engagement_rate": clip_rate(predicted["engagement_rate"]),
            "expected_like_rate": clip_rate(predicted["like_rate"]),
            "expected_comment_rate": clip_rate(predicted["comment_rate"]),
        }
    have = set(df.columns)

    def rate(c, default):
        own = F.nullif(F.col(c).try_cast("double"), F.lit(0.0)) if c in have else F.lit(None).cast("double")
        return clip_rate(F.coalesce(own, default))

    er = rate("engagement_rate", F.lit(0.015))
    vpd = safe_float("views_per_day", 250.0) if "views_per_day" in have else F.lit(250.0)
    return {
        "expected_views_per_day": F.greatest(vpd, F.lit(0.0)),
        "expected_engagement_rate": er,
        "expected_like_rate": rate("like_rate", er * 0.75),
        "expected_comment_rate": rate("comment_rate", er * 0.06),
    }


def boost_projection(
    df: DataFrame, *, budget="budget", cpm="cpm", policy_level="policy.policy_risk_level", predicted=None,
    name: str = "projection",
) -> DataFrame:
    """Adds a struct of paid impressions and projected views, likes, comments and shares."""
    e = expected_metrics(df, predicted)
    base = df.withColumns({f"_{k}": v for k, v in e.items()})
    er, lr, cr = (F.col(f"_expected_{k}_rate") for k in ("engagement", "like", "comment"))
    c = F.greatest(safe_float(cpm, fv.DEFAULT_CPM), F.lit(0.1))
    b = F.greatest(safe_float(budget), F.lit(0.0))
    impressions = b / c * 1000.0
    penalty = lookup(F.col(policy_level), fv.PROJECTION_PENALTY, fv.PROJECTION_PENALTY_DEFAULT)
    quality = clip(F.col("probability"), 0.0, 1.0) * 0.5 + 0.75
    hold = clip(safe_float("retention_rate", 0.35), 0.0, 1.0) * 0.5 + 0.75
    share = safe_float("share_rate") if "share_rate" in df.columns else F.lit(0.0)
    views = impressions * 0.35 * quality * hold * penalty

    def whole(x):
        return F.bround(F.round(x, 6)).cast("bigint")

    block = F.struct(
        F.round(b, 2).alias("budget_usd"),
        F.round(c, 2).alias("cpm_usd"),
        whole(impressions).alias("paid_impressions_estimate"),
        whole(views).alias("projected_views_after_boost"),
        whole(views * F.greatest(lr, er * 0.65)).alias("projected_likes_after_boost"),
        whole(views * F.greatest(cr, er * 0.05)).alias("projected_comments_after_boost"),
        whole(views * F.greatest(share, er * 0.04)).alias("projected_shares_after_boost"),
        penalty.alias("risk_penalty_applied"),
        F.round(quality, 3).alias("performance_multiplier"),
        F.round(hold, 3).alias("retention_multiplier"),
        F.struct(*[F.col(f"_{k}").alias(k) for k in e], F.lit(bool(predicted)).alias("metric_model_available")).alias(
            "metric_prediction"
        ),
    )
    return base.withColumn(name, block).drop(*[f"_{k}" for k in e])


def unify_impressions(first, second, budget, vtr=None) -> Column:
    """struct: mean of the positive estimates, per-dollar value, paid views and the method used."""
    a, x = safe_float(first), safe_float(second)
    b = F.greatest(safe_float(budget), F.lit(0.0))
    total = F.bround(avg_positive(a, x)).cast("bigint")
    rate = clip(safe_float(vtr, 0.18), 0.0, 1.0) if vtr is not None else F.lit(0.18)
    views = F.bround(F.round(total * rate, 6)).cast("bigint")
    method = F.when((a > 0) & (x > 0), F.lit("promedio de ambos modelos")).otherwise(F.lit("modelo disponible"))

    def per_dollar(v):
        return F.when(b > 0, F.round(v / b, 2)).otherwise(F.lit(0.0))

    return F.struct(
        total.alias("impresiones_unificadas"),
        per_dollar(total).alias("impresiones_por_dolar"),
        views.alias("vistas_pagadas"),
        per_dollar(views).alias("vistas_pagadas_por_dolar"),
        F.when(total > 0, method).otherwise(F.lit("sin estimación")).alias("metodo"),
    )


def decision_label(action: Column, policy_level: Column, gate: Column, score: Column) -> Column:
    """review / no / yes / adjust code of the summary decision."""
    a = F.upper(action)
    return (
        F.when(a.contains("REVIS") | policy_level.isin("alto", "revisión humana", "revision humana"), F.lit("review"))
        .when(a.contains("NO") & a.contains("IMPUL"), F.lit("no"))
        .when(gate & ((score >= 0.60) | a.contains("IMPULSAR")), F.lit("yes"))
        .otherwise(F.lit("adjust"))
    )


def decision_text(code: Column) -> Column:
    return lookup(code, msg.DECISION, "")


def report_decision(action: Column, policy_level: Column, gate: Column, score: Column) -> Column:
    """Decision of the report: policy, then action, then gate, then score."""
    a = F.upper(action)
    return (
        F.when(
            F.lower(policy_level).isin("alto", "high", "revisión humana", "revision humana")
            | a.contains("REVIS") | a.contains("HUMAN"),
            F.lit("review"),
        )
        .when((a.contains("NO") & (a.contains("IMPUL") | a.contains("PAUT"))) | a.contains("DESCART"), F.lit("no"))
        .when(~gate | a.contains("AJUSTAR") | a.contains("MONIT"), F.lit("adjust"))
        .when((a.contains("IMPULSAR") | a.contains("PAUTAR")) & (gate | (score >= 0.60)), F.lit("invest"))
        .otherwise(F.lit("monitor"))
    )


def message_rules(df: DataFrame, *, level="level", policy_level="policy.policy_risk_level", name: str = "message") -> DataFrame:
    """Adds the rule-based message struct: clarity, CTA strength, coherence, complexity, type, risk, lists."""
    base = df.withColumn("_w", T.token_count("text_total"))
    w = F.col("_w")
    cta, promo, trust = (flag_union(f"{k}_flag", f"ocr_{k}_flag") == 1 for k in ("cta", "promo", "trust"))
    benefit = _on("benefit_flag")
    has_t, has_o = T.text("transcript_text") != "", T.text("ocr_text") != ""
    clarity = (
        F.when(w < 6, 45).when(w > 140, 58).otherwise(70)
        + F.when(benefit, 8).otherwise(0) + F.when(cta, 7).otherwise(0)
    )
    strength = F.when(_on("cta_flag"), 35).otherwise(0) + F.when(_on("ocr_cta_flag"), 25).otherwise(0) + 30
    pl = F.col(policy_level)
    severe = pl.isin("alto", "revisión humana")
    wk, st = msg.MESSAGE_WEAK, msg.MESSAGE_STRONG
    weak = build_array(
        (~cta, wk["cta"]),
        (~benefit, wk["benefit"]),
        ((safe_float("ocr_word_count") > 35) & (safe_float("duration_seconds") <= 10), wk["saturation"]),
        (safe_float("duration_seconds") > 60, wk["long"]),
    )
    base = base.withColumn("_weak", weak)
    weak_n = F.size("_weak") > 0
    risk = (
        F.when(severe | (weak_n & F.col(level).isin("bajo", "medio")), F.lit("alto"))
        .when(weak_n, F.lit("medio"))
        .otherwise(F.lit("bajo"))
    )
    all_weak = F.concat(
        F.col("_weak"), F.when(severe, F.array(F.concat(F.lit(wk["policy"]), pl))).otherwise(F.expr("cast(array() as array<string>)"))
    )
    strong = build_array((trust, st["trust"]), (promo, st["promo"]), (benefit, st["benefit"]), (cta, st["cta"]))
    have = set(df.columns)
    block = F.struct(
        F.least(clarity, F.lit(100)).alias("claridad_mensaje"),
        F.least(strength, F.lit(100)).alias("fuerza_cta"),
        F.when(has_t & has_o, 75).when(has_t | has_o, 65).otherwise(60).alias("coherencia_semantica"),
        F.when(w > 130, F.lit("alta")).when(w > 45, F.lit("media")).otherwise(F.lit("baja")).alias("complejidad_sintactica"),
        F.when(promo, F.lit("promocional"))
        .when(trust, F.lit("testimonial"))
        .when(benefit, F.lit("informativo/promocional"))
        .otherwise(F.lit("informativo"))
        .alias("tipo_contenido"),
        risk.alias("riesgo_comunicacional"),
        or_default(strong, st["none"]).alias("fortalezas"),
        or_default(all_weak, wk["none"]).alias("debilidades"),
        (F.col("recommendation.ajustes_sugeridos") if "recommendation" in have else F.expr("cast(array() as array<string>)")).alias("ajustes_sugeridos"),
        (F.col("recommendation.recomendacion_impulso") if "recommendation" in have else F.lit("monitorear")).alias("recomendacion_llm"),
        F.lit(msg.MESSAGE_BASIS).alias("justificacion"),
    )
    return base.withColumn(name, block).drop("_w", "_weak")


def local_explanation(df: DataFrame, name: str = "explanation") -> DataFrame:
    """Adds favourable and risk factors read off the main features."""
    power, er, fit = safe_float("text_power_score"), safe_float("engagement_rate"), safe_float("duration_fit_score")
    good = build_array(
        (power >= 0.5, msg.FACTOR_TEXT_GOOD),
        (er >= 0.05, msg.FACTOR_ENGAGEMENT_GOOD),
        (fit >= 0.8, msg.FACTOR_DURATION_GOOD),
        (safe_float("ocr_frame_coverage") > 0, msg.FACTOR_SCREEN_TEXT),
        (T.text("transcript_text") != "", msg.FACTOR_TRANSCRIPT),
    )
    bad = build_array(
        (power < 0.5, msg.FACTOR_TEXT_WEAK),
        ((er < 0.05) & (safe_float("views") > 0), msg.FACTOR_ENGAGEMENT_LOW),
        (fit < 0.8, msg.FACTOR_DURATION_LONG),
        (F.coalesce("visual_text_density", F.lit("")) == "alta", msg.FACTOR_SATURATION),
    )
    return df.withColumn(name, F.struct(good.alias("factores_favorables"), bad.alias("factores_de_riesgo")))


def executive_summary(df: DataFrame, name: str = "summary") -> DataFrame:
    """Adds headline, 0-100 scores, at most five reasons and five steps, and the forecast."""
    r = "recommendation"
    action, pl = F.col(f"{r}.accion_final"), F.col("policy.policy_risk_level")
    prob, score = F.col(f"{r}.probabilidad_rendimiento"), F.col(f"{r}.score_hibrido")
    pct = F.bround(F.round(prob * 100, 6)).cast("int")
    er = safe_float("engagement_rate")
    visual_ok = F.coalesce("visual_ok", F.lit(False))
    vs = F.floor(F.coalesce("composition_score", F.lit(0.0)) * 100).cast("string")
    cats = F.array_join(F.slice("policy.policy_risk_categories", 1, 3), ", ")
    v = F.coalesce("composition_score", F.lit(0.0))
    reasons = build_array(
        F.concat(F.lit("Probabilidad "), pct.cast("string"), F.lit("%, nivel "), lookup(F.col("level"), msg.LEVEL_NAME, F.col("level")), F.lit(".")),
        F.when(pl == "bajo", F.lit("Sin alertas de política."))
        .when(pl == "medio", F.concat(F.lit("Señales moderadas de política: "), cats, F.lit(".")))
        .when(pl == "alto", F.concat(F.lit("Categorías sensibles: "), cats, F.lit(".")))
        .otherwise(F.concat(F.size("policy.policy_risk_categories").cast("string"), F.lit(" categorías delicadas."))),
        (visual_ok, F.concat(
            F.when(v >= 0.55, F.lit("Composición sólida (")).when(v >= 0.35, F.lit("Composición aceptable (")).otherwise(F.lit("Composición débil (")),
            vs, F.lit("/100)."))),
        (er > 0, F.concat(
            F.when(er > 0.05, F.lit("Interacción alta (")).when(er > 0.02, F.lit("Interacción sana (")).otherwise(F.lit("Interacción baja (")),
            F.format_string("%.1f%%", er * 100), F.lit(")."))),
    )
    tips = F.when(visual_ok, F.coalesce("visual_recommendations", F.expr("cast(array() as array<string>)"))).otherwise(F.expr("cast(array() as array<string>)"))
    steps = or_default(append_unique(F.col(f"{r}.ajustes_sugeridos"), tips), msg.NOTHING_TO_DO)

    def whole(c):
        return safe_float(c).cast("bigint")

    block = F.struct(
        lookup(action, msg.HEADLINE, msg.HEADLINE_OTHER).alias("headline"),
        action.alias("action"),
        F.bround(F.round(score * 100, 6)).cast("int").alias("score_global_0_100"),
        pct.alias("probabilidad_pct"),
        lookup(F.col("level"), msg.LEVEL_NAME, F.col("level")).alias("nivel_humano"),
        lookup(pl, msg.POLICY_STATUS, pl).alias("policy_status_human"),
        F.col("policy.policy_risk_categories").alias("policy_categories"),
        F.slice(reasons, 1, 5).alias("por_que"),
        F.slice(steps, 1, 5).alias("que_hacer_ahora"),
        F.struct(
            F.col(f"{r}.cpm_estimado").alias("cpm_usd"),
            safe_float("budget").alias("budget_usd"),
            whole(F.col(f"{r}.alcance_estimado_total")).alias("impresiones_esperadas"),
            whole(F.col(f"{r}.alcance_estimado_por_dolar")).alias("impresiones_por_dolar"),
            F.col(f"{r}.multiplicador_potencial").alias("multiplicador_potencial"),
            whole("views").alias("current_views"),
            whole("likes").alias("current_likes"),
            whole("comments").alias("current_comments"),
        ).alias("forecast"),
    )
    return df.withColumn(name, block)


def chart_data(df: DataFrame, name: str = "chart") -> DataFrame:
    """Adds the numbers behind the charts: five diagnosis bars, actual against expected, the risk bar."""
    pl = F.col("policy.policy_risk_level")
    risk = lookup(pl, fv.RISK_BAR, fv.RISK_BAR_DEFAULT).cast("double")
    keys = ("views", "likes", "comments")
    actual = {k: safe_float(k).cast("bigint") for k in keys}
    projected = {k: F.coalesce(F.col(f"projection.projected_{k}_after_boost"), F.lit(0).cast("bigint")) for k in keys}
    none = (projected["views"] == 0) & (projected["likes"] == 0) & (projected["comments"] == 0)
    mult = F.coalesce(F.col("recommendation.multiplicador_potencial"), F.lit(1.3))
    expected = {
        k: F.when(none, (actual[k] * mult * 1.5).cast("bigint")).otherwise(projected[k]) for k in keys
    }
    block = F.struct(
        F.struct(
            (F.col("recommendation.probabilidad_rendimiento") * 100).alias("potencial"),
            (safe_float("retention_rate") * 100).alias("retencion"),
            F.least(safe_float("engagement_rate") * 1000, F.lit(100.0)).alias("engagement"),
            safe_float(F.col("script.script_quality_score")).alias("guion"),
            risk.alias("riesgo_politica"),
        ).alias("diagnostico"),
        F.struct(*[v.alias(k) for k, v in actual.items()]).alias("actual"),
        F.struct(*[v.alias(k) for k, v in expected.items()]).alias("esperado"),
    )
    return df.withColumn(name, block)


def campaign_recommendation(df: DataFrame, probability="probability", threshold=fv.NOTEBOOK_THRESHOLD) -> DataFrame:
    """Notebook rule: level, one of the lever families, factors, action and indicator."""
    p = F.col(probability)
    d = F.coalesce(F.nullif(F.col("duration_seconds").try_cast("double"), F.lit(0.0)), F.lit(60.0))
    cta, trust = safe_float("cta_flag") != 0, safe_float("trust_flag") != 0
    urgency = safe_float("urgency_score") if "urgency_score" in df.columns else F.lit(0.0)
    level = F.when(p >= 0.60, F.lit("alto")).when(p >= threshold, F.lit("medio")).otherwise(F.lit("bajo"))
    family = (
        F.when((p >= 0.60) & cta & trust, F.lit("potenciar"))
        .when(d > 120, F.lit("reducir_duracion"))
        .when(~cta, F.lit("agregar_cta"))
        .when(~trust, F.lit("mejorar_confianza"))
        .when(urgency < 0.05, F.lit("fortalecer_gancho"))
        .otherwise(F.lit("monitorear"))
    )
    factors = build_array(
        (d > 120, F.concat(F.lit("duracion_excesiva ("), F.format_string("%.0f", d), F.lit("s)"))),
        (~cta, "sin_cta"),
        (~trust, "baja_confianza"),
        (urgency < 0.05, "urgencia_baja"),
    )
    out = df.withColumns(
        {
            "proba_alto_rendimiento": F.round(p, 4), "nivel": level, "familia": family,
            "factores": or_default(factors, "perfil_favorable"),
        }
    )
    texts = ("titulo_recomendacion", "accion", "kpi")
    return out.withColumns(
        {t: lookup(F.col("familia"), {k: v[i] for k, v in msg.CAMPAIGN.items()}, "") for i, t in enumerate(texts)}
    )


def diagnostic_struct(df: DataFrame, name: str = "diagnostic") -> DataFrame:
    """Adds the nested business diagnosis: whole percents, bounded texts and short lists."""
    r = "recommendation"
    none_s = F.lit(None).cast("string")
    have = set(df.columns)

    def opt(c, kind="string"):
        return F.col(c) if c.split(".")[0] in have else F.lit(None).cast(kind)

    def pct(c, digits=0):
        x = safe_float(c) * 100
        return F.bround(F.round(x, 6)).cast("int") if digits == 0 else F.round(x, digits)

    def whole(c):
        return (safe_float(c) if c.split(".")[0] in have else F.lit(0.0)).cast("bigint")

    intent = F.coalesce(F.col("script.content_intent"), F.col("content_intent"), F.lit(fv.NICHE_DEFAULT))
    block = F.struct(
        T.text("title").alias("titulo"),
        intent.alias("content_intent"),
        F.col(f"{r}.accion_final").alias("accion"),
        pct(F.col(f"{r}.probabilidad_rendimiento")).alias("probabilidad_pct"),
        pct(F.col(f"{r}.score_hibrido")).alias("score_0_100"),
        F.struct(
            whole("views").alias("views"), whole("likes").alias("likes"), whole("comments").alias("comments"),
            pct("engagement_rate", 2).alias("engagement_pct"),
        ).alias("metricas_publicas"),
        F.struct(
            whole("shares").alias("shares"), pct("retention_rate", 1).alias("retention_pct"),
            whole("average_watch_time").alias("average_watch_time"),
            whole("hours_since_publication").alias("hours_since_publication"),
            T.age_label("hours_since_publication").alias("published_age_label"),
        ).alias("metricas_privadas"),
        F.struct(
            F.col("policy.policy_risk_level").alias("nivel"),
            F.col("policy.youtube_ad_status_estimate").alias("estado"),
            F.col("policy.policy_risk_categories").alias("categorias"),
        ).alias("politica"),
        F.struct(
            F.col("script.script_quality_score").alias("score"), F.col("script.tone").alias("tono"),
            F.col("script.hook_type").alias("hook_type"),
            F.col("script.transcript_interpretation").alias("interpretacion"),
            F.col("script.recommended_script_improvements").alias("mejoras"),
        ).alias("guion"),
        F.struct(
            F.substring(T.text("transcript_text"), 1, 1200).alias("preview"),
            whole("transcript_word_count").alias("word_count"),
        ).alias("transcripcion"),
        F.struct(
            F.substring(T.text("ocr_text"), 1, 800).alias("text"), F.col("ocr_role").alias("role"),
            pct("ocr_relevance_score", 1).alias("relevance_pct"), pct("ocr_context_overlap", 1).alias("overlap_pct"),
        ).alias("ocr"),
        F.struct(
            F.when(F.coalesce("visual_ok", F.lit(False)), pct("composition_score")).alias("score_0_100"),
            opt("visual_summary").alias("resumen"),
            (F.slice("visual_recommendations", 1, 4) if "visual_recommendations" in have else none_s.cast("array<string>")).alias("sugerencias"),
        ).alias("visual"),
        F.struct(
            opt("sentimiento_dominante").alias("sentimiento_dominante"),
            opt("pct_positivo", "double").alias("pct_positivo"),
            opt("pct_negativo", "double").alias("pct_negativo"),
        ).alias("sentimiento"),
        F.struct(
            F.col(f"{r}.cpm_estimado").alias("cpm"), safe_float("budget").alias("presupuesto"),
            F.col("projection.projected_views_after_boost").alias("views_esperadas"),
            F.col("projection.projected_likes_after_boost").alias("likes_esperados"),
            F.col("projection.projected_comments_after_boost").alias("comments_esperados"),
            F.col("projection.projected_shares_after_boost").alias("shares_esperados"),
        ).alias("proyeccion"),
    )
    return df.withColumn(name, block)


def rule_recommendation(df: DataFrame, diagnostic: str = "diagnostic", name: str = "rule_text") -> DataFrame:
    """Adds headline, at most four reasons and four steps, and the projection sentence."""
    d = diagnostic
    cats = F.col(f"{d}.politica.categorias")
    intent = F.lower(F.coalesce(f"{d}.content_intent", F.lit("")))
    light = intent.contains("humor") | intent.contains("entreten")
    visual = F.col(f"{d}.visual.score_0_100")
    mood = F.col(f"{d}.sentimiento.sentimiento_dominante")
    reasons = build_array(
        F.concat(F.lit("Probabilidad estimada: "), F.col(f"{d}.probabilidad_pct").cast("string"), F.lit("%.")),
        F.when(
            F.size(cats) > 0,
            F.concat(F.lit("Política: "), F.array_join(F.slice(cats, 1, 3), ", "), F.lit(" ("), F.col(f"{d}.politica.nivel"), F.lit(").")),
        ).otherwise(F.lit("Política: sin categorías sensibles.")),
        (visual.isNotNull(), F.concat(F.lit("Composición: "), visual.cast("string"), F.lit("/100."))),
        (mood.isNotNull(), F.concat(
            F.lit("Comentarios: "), mood, F.lit(" ("), F.format_string("%.0f", F.coalesce(f"{d}.sentimiento.pct_positivo", F.lit(0.0))), F.lit("% / "),
            F.format_string("%.0f", F.coalesce(f"{d}.sentimiento.pct_negativo", F.lit(0.0))), F.lit("%)."))),
    )
    better = F.slice(F.coalesce(f"{d}.guion.mejoras", F.expr("cast(array() as array<string>)")), 1, 3)
    steps = (
        F.when(light, text_array(*msg.RULE_NEXT_HUMOR))
        .when(F.size(better) > 0, better)
        .otherwise(text_array(*msg.RULE_NEXT_DEFAULT))
    )
    views = F.col(f"{d}.proyeccion.views_esperadas")
    budget = F.col(f"{d}.proyeccion.presupuesto")
    sentence = F.when(
        (budget != 0) & (views != 0),
        F.concat(F.lit("Con USD "), budget.cast("string"), F.lit(": "), F.format_number(views, 0), F.lit(" vistas.")),
    ).otherwise(F.lit(""))
    block = F.struct(
        lookup(F.col(f"{d}.accion"), msg.HEADLINE, msg.HEADLINE_OTHER).alias("headline"),
        F.slice(reasons, 1, 4).alias("reasons"),
        F.slice(steps, 1, 4).alias("steps"),
        sentence.alias("projection"),
    )
    return df.withColumn(name, block)


def stable_recommendation_text(code: Column, probability: Column, cpm: Column, impressions: Column, paid_views: Column, policy_level: Column) -> Column:
    """Rule text that replaces an unusable generated one: verdict, figures and standing advice."""
    return F.concat_ws(
        "\n",
        decision_text(code),
        F.concat(F.lit("Probabilidad: "), F.format_string("%.1f", probability * 100), F.lit("%")),
        F.concat(F.lit("CPM: $"), F.format_string("%.2f", cpm)),
        F.concat(F.lit("Impresiones: "), F.format_number(impressions, 0)),
        F.concat(F.lit("Vistas pagadas: "), F.format_number(paid_views, 0)),
        F.concat(F.lit("Riesgo de política: "), policy_level),
        *[F.lit(t) for t in msg.RULE_NEXT_DEFAULT],
    )
