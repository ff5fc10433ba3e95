"""Queries over decision, paid-campaign and summary scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.operators import decision as D
from reelscope.operators import messages as msg
from reelscope.operators import normalize as B
from reelscope.operators import paid as P
from reelscope.plans import sqltext as s
from reelscope.plans import views as V
from reelscope.plans.analysis import analyze_batch, video_with_signals
from reelscope.plans.registry import joined, query, r6
from reelscope.plans.scalars_queries import jitter_sql, with_videos
from reelscope.session import table

# Every event is a decision case: the columns are spread over all branches.
CASES_SQL = """cases AS MATERIALIZED (SELECT event_id, CAST(event_id AS VARCHAR) AS video_id, event_type || ' ' || event_id AS title, props AS description,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE props || ' ' || event_type END AS transcript_text, CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END AS ocr_text,
  (event_id % 97) / 96.7::DOUBLE AS probability, value / 170.0::DOUBLE AS engagement_rate, value / 190.0::DOUBLE AS like_rate,
  value / 990.0::DOUBLE AS comment_rate, floor(value * 13)::DOUBLE AS views, floor(value * 2)::DOUBLE AS likes, floor(value)::DOUBLE AS comments,
  (user_id % 101) / 101.0::DOUBLE AS retention_rate, round(value * 17, 4) AS views_per_hour, value * 9 / 0.7::DOUBLE AS views_per_day, (event_id % 90)::DOUBLE AS duration_seconds,
  ln(1 + event_id % 130) * 27 AS budget, (1 + event_id % 29)::DOUBLE AS hours_since_publication, CAST(event_id % 2 AS INTEGER) AS cta_flag, CAST(event_id % 3 = 0 AS INTEGER) AS benefit_flag,
  CAST(event_id % 4 = 1 AS INTEGER) AS promo_flag, CAST(event_id % 6 = 1 AS INTEGER) AS trust_flag, CAST(event_id % 7 = 0 AS INTEGER) AS price_flag, CAST(event_id % 11 = 0 AS INTEGER) AS ocr_cta_flag,
  0 AS ocr_promo_flag, 0 AS ocr_trust_flag, CAST(event_id % 60 AS INTEGER) AS ocr_word_count, (event_id % 10) / 9.1::DOUBLE AS text_power_score, (event_id % 11) / 10.7::DOUBLE AS duration_fit_score,
  (event_id % 4) / 4.3::DOUBLE AS ocr_frame_coverage, ['bajo', 'medio', 'alto', 'revisión humana', 'otro'][CAST((event_id // 7) % 5 AS INTEGER) + 1] AS policy_level,
  CASE WHEN (event_id % 97) / 96.7::DOUBLE >= 0.85 THEN 'muy_alto' WHEN (event_id % 97) / 96.7::DOUBLE >= 0.65 THEN 'alto'
       WHEN (event_id % 97) / 96.7::DOUBLE >= 0.4 THEN 'medio' ELSE 'bajo' END AS level,
  ['retail', 'auto', 'salud', 'zzz'][CAST(event_id % 4 AS INTEGER) + 1] AS ad_category, round(2 + (event_id % 37) / 3.0::DOUBLE, 4) AS cpm FROM events)"""


def cases(spark, sf):
    e = table(spark, sf, "events")
    i, v = F.col("event_id"), F.col("value")

    def flag(m, r):
        return (i % m == r).cast("int")

    p = (i % 97) / F.lit(96.7)
    cols = {
        "video_id": i.cast("string"),
        "title": F.concat("event_type", F.lit(" "), i.cast("string")),
        "description": F.col("props"),
        "transcript_text": F.when(i % 3 == 0, F.lit("")).otherwise(F.concat("props", F.lit(" "), "event_type")),
        "ocr_text": F.when(i % 5 == 0, F.col("event_type")).otherwise(F.lit("")),
        "probability": p,
        "engagement_rate": v / 170.0,
        "like_rate": v / 190.0,
        "comment_rate": v / 990.0,
        "views": F.floor(v * 13).cast("double"),
        "likes": F.floor(v * 2).cast("double"),
        "comments": F.floor(v).cast("double"),
        "retention_rate": (F.col("user_id") % 101) / 101.0,
        "views_per_hour": F.round(v * 17, 4),
        "views_per_day": v * 9 / 0.7,
        "duration_seconds": (i % 90).cast("double"),
        "budget": F.log1p(i % 130) * 27,
        "hours_since_publication": (i % 29 + 1).cast("double"),
        "cta_flag": flag(2, 1), "benefit_flag": flag(3, 0), "promo_flag": flag(4, 1), "trust_flag": flag(6, 1),
        "price_flag": flag(7, 0), "ocr_cta_flag": flag(11, 0), "ocr_promo_flag": F.lit(0), "ocr_trust_flag": F.lit(0),
        "ocr_word_count": (i % 60).cast("int"),
        "text_power_score": (i % 10) / 9.1,
        "duration_fit_score": (i % 11) / 10.7,
        "ocr_frame_coverage": (i % 4) / 4.3,
        "policy_level": F.get(F.array(*[F.lit(x) for x in ("bajo", "medio", "alto", "revisión humana", "otro")]), (F.floor(i / 7) % 5).cast("int")),
        "level": D.probability_level(p),
        "ad_category": F.get(F.array(*[F.lit(x) for x in ("retail", "auto", "salud", "zzz")]), (i % 4).cast("int")),
        "cpm": F.round((i % 37) / 3.0 + 2, 4),
    }
    out = e.select("event_id", *[c.alias(k) for k, c in cols.items()])
    policy = F.struct(
        F.col("policy_level").alias("policy_risk_level"), F.lit("apto").alias("youtube_ad_status_estimate"),
        F.array(F.lit("c1"), F.lit("c2")).alias("policy_risk_categories"),
    )
    return out.withColumns({"policy": policy, "transcript_ok": F.col("transcript_text") != "", "has_text": i % 9 != 0})


def with_cases(select: str) -> str:
    return f"WITH {CASES_SQL} {select}"


HEUR_SQL = f"""round({s.clip('0.18::DOUBLE + 0.3::DOUBLE * text_power_score + 0.22::DOUBLE * least(engagement_rate / 0.1::DOUBLE, 1) + 0.18::DOUBLE * least(views_per_day / 1000, 1) + 0.08::DOUBLE * duration_fit_score + 0.04::DOUBLE * ocr_frame_coverage', 0.02, 0.98)}, 4)"""


@query("heuristic_probability", with_cases(f"SELECT event_id, {HEUR_SQL} AS p FROM cases"))
def heuristic(spark, sf):
    c = cases(spark, sf)
    return c.select("event_id", D.heuristic_probability(c).alias("p"))


@query("probability_level", with_cases("SELECT event_id, level FROM cases"))
def level(spark, sf):
    return cases(spark, sf).select("event_id", D.probability_level(F.col("probability")).alias("level"))


@query("score_videos", with_cases(f"SELECT event_id, {HEUR_SQL} AS probability, false AS model_available FROM cases"))
def score_videos(spark, sf):
    return D.score_videos(cases(spark, sf).drop("probability", "level")).select("event_id", "probability", "model_available")


MULT_SQL = s.case("level", fv.LEVEL_MULTIPLIER, "1.0::DOUBLE")


@query(
    "reach_per_dollar",
    with_cases(f"SELECT event_id, cpm AS cpm_estimado, {MULT_SQL} AS multiplicador_potencial, round(1000.0::DOUBLE / cpm, 2) AS alcance_base_por_dolar, round(1000.0::DOUBLE / cpm * {MULT_SQL}, 2) AS alcance_estimado_por_dolar FROM cases"),
)
def reach(spark, sf):
    out = D.reach_per_dollar(F.col("level"), "cpm")
    return cases(spark, sf).select("event_id", *[c.alias(k) for k, c in out.items()])


PENALTY_SQL = s.case("policy_level", fv.SCORE_PENALTY, "0.85::DOUBLE")
BASE_SQL = (
    f"(0.5::DOUBLE * probability + 0.18::DOUBLE * {s.clip('engagement_rate / 0.15::DOUBLE', 0, 1)} + 0.17::DOUBLE * retention_rate"
    f" + 0.15::DOUBLE * {s.clip(f'ln(1 + views_per_hour) / {math.log1p(1000.0)!r}::DOUBLE', 0, 1)})"
)
HYBRID_SQL = f"round({BASE_SQL} * {PENALTY_SQL}, 4)"


@query("hybrid_score", with_cases(f"SELECT event_id, round({BASE_SQL}, 4) AS score_base, {PENALTY_SQL} AS policy_penalty, {HYBRID_SQL} AS hybrid_score FROM cases"))
def hybrid(spark, sf):
    h = D.hybrid_score("probability", "engagement_rate", "retention_rate", "views_per_hour", F.col("policy_level"))
    return cases(spark, sf).withColumn("h", h).select("event_id", "h.score_base", "h.policy_penalty", "h.hybrid_score")


NEEDS_SQL = """(CASE WHEN cta_flag = 0 AND ocr_cta_flag = 0 THEN 1 ELSE 0 END + CASE WHEN ocr_word_count > 35 AND duration_seconds <= 10 THEN 1 ELSE 0 END
  + CASE WHEN benefit_flag = 0 THEN 1 ELSE 0 END + CASE WHEN duration_seconds > 60 THEN 1 ELSE 0 END + CASE WHEN transcript_text = '' AND ocr_text = '' THEN 1 ELSE 0 END)"""


def action_sql(score: str) -> str:
    return f"""CASE WHEN policy_level = 'revisión humana' OR (transcript_text = '' AND event_id % 9 = 0) THEN 'REVISIÓN HUMANA' WHEN policy_level = 'alto' THEN 'NO IMPULSAR'
      WHEN {score} >= 0.65 AND {NEEDS_SQL} = 0 AND policy_level = 'bajo' THEN 'IMPULSAR' WHEN {score} >= 0.55 AND policy_level IN ('bajo', 'medio') THEN 'AJUSTAR ANTES DE IMPULSAR'
      WHEN {score} >= 0.42 THEN 'AJUSTAR ANTES DE IMPULSAR' ELSE 'NO IMPULSAR' END"""


@query("final_action", with_cases(f"SELECT event_id, {action_sql('probability')} AS action FROM cases"))
def final_action(spark, sf):
    adjust = F.size(D.required_adjustments()) > 0
    a = D.final_action("probability", F.col("policy_level"), adjust, ~F.col("transcript_ok"), F.col("has_text"))
    return cases(spark, sf).select("event_id", a.alias("action"))


@query("required_adjustments", with_cases(f"SELECT event_id, CAST({NEEDS_SQL} AS INTEGER) AS n FROM cases"))
def adjustments(spark, sf):
    return cases(spark, sf).select("event_id", F.size(D.required_adjustments()).alias("n"))


@query(
    "recommendation",
    with_cases(f"""SELECT event_id, {action_sql(HYBRID_SQL)} AS accion_final, {HYBRID_SQL} AS score_hibrido,
      CASE WHEN level IN ('alto', 'muy_alto') AND {NEEDS_SQL} = 0 THEN 'impulsar' WHEN level IN ('alto', 'muy_alto', 'medio') THEN 'ajustar antes de impulsar' ELSE 'no impulsar' END AS recomendacion_impulso,
      CASE level WHEN 'bajo' THEN 'baja' WHEN 'medio' THEN 'media' ELSE 'alta' END AS nivel_prioridad,
      round(round(1000.0::DOUBLE / cpm * {MULT_SQL}, 2) * budget, 2) AS alcance_estimado_total FROM cases"""),
)
def recommendation(spark, sf):
    r = "recommendation."
    return D.recommendation(cases(spark, sf)).select(
        "event_id", f"{r}accion_final", f"{r}score_hibrido", f"{r}recomendacion_impulso", f"{r}nivel_prioridad", f"{r}alcance_estimado_total"
    )


ER_SQL = s.clip("CASE WHEN engagement_rate = 0 THEN 0.015::DOUBLE ELSE engagement_rate END", 0, 0.35)
LR_SQL = s.clip(f"CASE WHEN like_rate = 0 THEN {ER_SQL} * 0.75::DOUBLE ELSE like_rate END", 0, 0.35)
CR_SQL = s.clip(f"CASE WHEN comment_rate = 0 THEN {ER_SQL} * 0.06::DOUBLE ELSE comment_rate END", 0, 0.35)


@query("expected_metrics", with_cases(f"SELECT event_id, {s.r6(ER_SQL)} AS er, {s.r6(LR_SQL)} AS lr, {s.r6(CR_SQL)} AS cr, views_per_day AS vpd FROM cases"))
def expected(spark, sf):
    c = cases(spark, sf)
    e = D.expected_metrics(c)
    return c.select(
        "event_id", r6(e["expected_engagement_rate"], "er"), r6(e["expected_like_rate"], "lr"), r6(e["expected_comment_rate"], "cr"),
        e["expected_views_per_day"].alias("vpd"),
    )


PROJ_SQL = f"(budget / cpm * 1000.0::DOUBLE) * 0.35::DOUBLE * (0.75::DOUBLE + 0.5::DOUBLE * probability) * (0.75::DOUBLE + 0.5::DOUBLE * retention_rate) * {s.case('policy_level', fv.PROJECTION_PENALTY, '0.75::DOUBLE')}"


def whole_sql(x: str) -> str:
    return f"CAST({s.bround(f'round({x}, 6)')} AS BIGINT)"


@query(
    "boost_projection",
    with_cases(f"""SELECT event_id, {whole_sql('budget / cpm * 1000.0::DOUBLE')} AS impressions, {whole_sql(PROJ_SQL)} AS views,
      {whole_sql(f'({PROJ_SQL}) * greatest({LR_SQL}, {ER_SQL} * 0.65::DOUBLE)')} AS likes, {whole_sql(f'({PROJ_SQL}) * greatest({CR_SQL}, {ER_SQL} * 0.05::DOUBLE)')} AS comments,
      {whole_sql(f'({PROJ_SQL}) * greatest(0.0::DOUBLE, {ER_SQL} * 0.04::DOUBLE)')} AS shares FROM cases"""),
)
def projection(spark, sf):
    p = "projection."
    return D.boost_projection(cases(spark, sf)).select(
        "event_id", F.col(f"{p}paid_impressions_estimate").alias("impressions"), F.col(f"{p}projected_views_after_boost").alias("views"),
        F.col(f"{p}projected_likes_after_boost").alias("likes"), F.col(f"{p}projected_comments_after_boost").alias("comments"),
        F.col(f"{p}projected_shares_after_boost").alias("shares"),
    )


MEAN2 = "CASE WHEN views > 0 AND likes > 0 THEN (views + likes) / 2 WHEN views > 0 THEN views WHEN likes > 0 THEN likes ELSE 0 END"


@query(
    "unify_impressions",
    with_cases(f"""SELECT event_id, CAST(t AS BIGINT) AS total, CASE WHEN budget > 0 THEN round(t / budget, 2) ELSE 0 END AS per_dollar,
      {whole_sql('t * 0.18::DOUBLE')} AS paid_views FROM (SELECT *, {s.bround(MEAN2)} AS t FROM cases)"""),
)
def unify(spark, sf):
    u = cases(spark, sf).withColumn("u", D.unify_impressions("views", "likes", "budget"))
    return u.select("event_id", F.col("u.impresiones_unificadas").alias("total"), F.col("u.impresiones_por_dolar").alias("per_dollar"), F.col("u.vistas_pagadas").alias("paid_views"))


@query(
    "decision_label",
    with_cases(f"""SELECT event_id, CASE WHEN contains(a, 'REVIS') OR policy_level IN ('alto', 'revisión humana') THEN 'review' WHEN contains(a, 'NO') AND contains(a, 'IMPUL') THEN 'no'
      WHEN probability >= 0.51 AND (probability >= 0.6 OR contains(a, 'IMPULSAR')) THEN 'yes' ELSE 'adjust' END AS summary,
      CASE WHEN policy_level IN ('alto', 'revisión humana') OR contains(a, 'REVIS') THEN 'review' WHEN contains(a, 'NO') AND contains(a, 'IMPUL') THEN 'no'
      WHEN probability < 0.51 OR contains(a, 'AJUSTAR') THEN 'adjust' WHEN contains(a, 'IMPULSAR') THEN 'invest' ELSE 'monitor' END AS report
      FROM (SELECT *, {action_sql('probability')} AS a FROM cases)"""),
)
def decisions(spark, sf):
    adjust = F.size(D.required_adjustments()) > 0
    a = D.final_action("probability", F.col("policy_level"), adjust, ~F.col("transcript_ok"), F.col("has_text"))
    gate = F.col("probability") >= fv.GATE_THRESHOLD
    c = cases(spark, sf).withColumn("a", a)
    return c.select(
        "event_id", D.decision_label(F.col("a"), F.col("policy_level"), gate, F.col("probability")).alias("summary"),
        D.report_decision(F.col("a"), F.col("policy_level"), gate, F.col("probability")).alias("report"),
    )


WEAK_N = "(CASE WHEN cta_flag = 0 AND ocr_cta_flag = 0 THEN 1 ELSE 0 END + CASE WHEN benefit_flag = 0 THEN 1 ELSE 0 END + CASE WHEN ocr_word_count > 35 AND duration_seconds <= 10 THEN 1 ELSE 0 END + CASE WHEN duration_seconds > 60 THEN 1 ELSE 0 END)"
BODY = "title || ' ' || description || ' ' || transcript_text"


@query(
    "message_rules",
    with_cases(f"""SELECT event_id, CAST(least(100, CASE WHEN w < 6 THEN 45 WHEN w > 140 THEN 58 ELSE 70 END + 8 * benefit_flag + CASE WHEN cta_flag + ocr_cta_flag > 0 THEN 7 ELSE 0 END) AS INTEGER) AS clarity,
      CAST(30 + 35 * cta_flag + 25 * ocr_cta_flag AS INTEGER) AS strength,
      CAST(CASE WHEN transcript_text <> '' AND ocr_text <> '' THEN 75 WHEN transcript_text <> '' OR ocr_text <> '' THEN 65 ELSE 60 END AS INTEGER) AS coherence,
      CASE WHEN promo_flag = 1 THEN 'promocional' WHEN trust_flag = 1 THEN 'testimonial' WHEN benefit_flag = 1 THEN 'informativo/promocional' ELSE 'informativo' END AS kind,
      CASE WHEN policy_level IN ('alto', 'revisión humana') OR ({WEAK_N} > 0 AND level IN ('bajo', 'medio')) THEN 'alto' WHEN {WEAK_N} > 0 THEN 'medio' ELSE 'bajo' END AS risk,
      CAST(greatest(1, {WEAK_N} + CASE WHEN policy_level IN ('alto', 'revisión humana') THEN 1 ELSE 0 END) AS INTEGER) AS weak FROM (SELECT *, {s.tokens_n(BODY)} AS w FROM cases)"""),
)
def messages(spark, sf):
    c = cases(spark, sf).withColumn("text_total", F.concat_ws(" ", "title", "description", "transcript_text"))
    m = "message."
    return D.message_rules(c).select(
        "event_id", F.col(f"{m}claridad_mensaje").alias("clarity"), F.col(f"{m}fuerza_cta").alias("strength"), F.col(f"{m}coherencia_semantica").alias("coherence"),
        F.col(f"{m}tipo_contenido").alias("kind"), F.col(f"{m}riesgo_comunicacional").alias("risk"), F.size(f"{m}debilidades").alias("weak"),
    )


@query(
    "local_explanation",
    with_cases("""SELECT event_id, CAST(CASE WHEN text_power_score >= 0.5 THEN 1 ELSE 0 END + CASE WHEN engagement_rate >= 0.05 THEN 1 ELSE 0 END + CASE WHEN duration_fit_score >= 0.8 THEN 1 ELSE 0 END
      + CASE WHEN ocr_frame_coverage > 0 THEN 1 ELSE 0 END + CASE WHEN transcript_text <> '' THEN 1 ELSE 0 END AS INTEGER) AS good,
      CAST(CASE WHEN text_power_score < 0.5 THEN 1 ELSE 0 END + CASE WHEN engagement_rate < 0.05 AND views > 0 THEN 1 ELSE 0 END + CASE WHEN duration_fit_score < 0.8 THEN 1 ELSE 0 END AS INTEGER) AS bad FROM cases"""),
)
def explanation(spark, sf):
    c = cases(spark, sf).withColumn("visual_text_density", F.lit("baja"))
    return D.local_explanation(c).select(
        "event_id", F.size("explanation.factores_favorables").alias("good"), F.size("explanation.factores_de_riesgo").alias("bad")
    )


def summarised(spark, sf):
    c = D.boost_projection(D.recommendation(cases(spark, sf)))
    return c.withColumns(
        {
            "visual_ok": F.col("event_id") % 2 == 0, "composition_score": (F.col("event_id") % 10) / 10.0,
            "visual_recommendations": F.array(F.lit("v1"), F.lit("v2"), F.lit("v3")),
            "script": F.struct((F.col("event_id") % 100).cast("int").alias("script_quality_score")),
        }
    )


@query(
    "executive_summary",
    with_cases(f"""SELECT event_id, {s.case('a', msg.HEADLINE, "''")} AS headline, CAST({s.bround(f'round({HYBRID_SQL} * 100, 6)')} AS INTEGER) AS score,
      CAST({s.bround('round(probability * 100, 6)')} AS INTEGER) AS pct, CAST(2 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN engagement_rate > 0 THEN 1 ELSE 0 END AS INTEGER) AS reasons,
      CAST(greatest(1, least(5, {NEEDS_SQL} + CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END)) AS INTEGER) AS steps FROM (SELECT *, {action_sql(HYBRID_SQL)} AS a FROM cases)"""),
)
def executive(spark, sf):
    x = "summary."
    return D.executive_summary(summarised(spark, sf)).select(
        "event_id", f"{x}headline", F.col(f"{x}score_global_0_100").alias("score"), F.col(f"{x}probabilidad_pct").alias("pct"),
        F.size(f"{x}por_que").alias("reasons"), F.size(f"{x}que_hacer_ahora").alias("steps"),
    )


@query(
    "chart_data",
    with_cases(f"""SELECT event_id, {s.r6('round(probability, 4) * 100')} AS potencial, {s.r6('retention_rate * 100')} AS retencion, {s.r6('least(engagement_rate * 1000, 100)')} AS engagement,
      (event_id % 100)::DOUBLE AS guion, {s.case('policy_level', fv.RISK_BAR, '50::DOUBLE')} AS riesgo,
      CASE WHEN pv = 0 AND pl = 0 AND pc = 0 THEN CAST(floor(views * {MULT_SQL} * 1.5::DOUBLE) AS BIGINT) ELSE pv END AS views_expected
      FROM (SELECT *, {whole_sql(PROJ_SQL)} AS pv, {whole_sql(f'({PROJ_SQL}) * greatest({LR_SQL}, {ER_SQL} * 0.65::DOUBLE)')} AS pl,
        {whole_sql(f'({PROJ_SQL}) * greatest({CR_SQL}, {ER_SQL} * 0.05::DOUBLE)')} AS pc FROM cases)"""),
)
def charts(spark, sf):
    c = "chart.diagnostico."
    return D.chart_data(summarised(spark, sf)).select(
        "event_id", r6(f"{c}potencial", "potencial"), r6(f"{c}retencion", "retencion"), r6(f"{c}engagement", "engagement"), f"{c}guion",
        F.col(f"{c}riesgo_politica").alias("riesgo"), F.col("chart.esperado.views").alias("views_expected"),
    )


@query(
    "campaign_recommendation",
    with_cases("""SELECT event_id, CASE WHEN probability >= 0.6 THEN 'alto' WHEN probability >= 0.4 THEN 'medio' ELSE 'bajo' END AS nivel,
      CASE WHEN probability >= 0.6 AND cta_flag = 1 AND trust_flag = 1 THEN 'potenciar' WHEN d > 120 THEN 'reducir_duracion' WHEN cta_flag = 0 THEN 'agregar_cta'
        WHEN trust_flag = 0 THEN 'mejorar_confianza' WHEN engagement_rate < 0.05 THEN 'fortalecer_gancho' ELSE 'monitorear' END AS familia,
      CASE WHEN f = '' THEN 'perfil_favorable' ELSE f END AS factores FROM (SELECT *, array_to_string(list_filter([CASE WHEN d > 120 THEN 'duracion_excesiva (' || CAST(d AS INTEGER) || 's)' END,
        CASE WHEN cta_flag = 0 THEN 'sin_cta' END, CASE WHEN trust_flag = 0 THEN 'baja_confianza' END, CASE WHEN engagement_rate < 0.05 THEN 'urgencia_baja' END], lambda x: x IS NOT NULL), ' | ') AS f
        FROM (SELECT *, CASE WHEN duration_seconds = 0 THEN 60 ELSE duration_seconds * 2 END AS d FROM cases))"""),
)
def campaign(spark, sf):
    c = cases(spark, sf).withColumns({"duration_seconds": F.col("duration_seconds") * 2, "urgency_score": F.col("engagement_rate")})
    return D.campaign_recommendation(c).select("event_id", "nivel", "familia", joined("factores", "factores"))


# --- paid campaigns ---------------------------------------------------------------


def niche_sql(body: str) -> str:
    ranked = ", ".join(f"{{'h': {s.hits(body, t)}, 'p': {-i}, 'n': {s.q(k)}}}" for i, (k, t) in enumerate(fv.NICHE_TERMS.items()))
    return f"list_max([{ranked}])"


@query(
    "ad_niche",
    with_videos(f"""SELECT video_id, CASE WHEN b.h > 0 THEN b.n ELSE 'general/branding' END AS ad_niche
      FROM (SELECT video_id, {niche_sql('body')} AS b FROM (SELECT video_id, title || ' ' || description || ' ' || transcript_text || ' ' || ocr_text AS body FROM videos))"""),
)
def ad_niche(spark, sf):
    return P.ad_niche(V.videos(spark, sf), forced=None).select("video_id", "ad_niche")


PICK_SQL = "CASE event_id % 4 WHEN 0 THEN 'retail/ecommerce' WHEN 2 THEN 'salud/bienestar' ELSE 'general/branding' END"


def niched(spark, sf):
    return P.ad_niche(cases(spark, sf))


@query(
    "ad_channel_and_type",
    with_cases(f"""SELECT event_id, n AS ad_niche, CASE WHEN n = 'retail/ecommerce' THEN 'Instagram' ELSE 'Facebook' END AS channel,
      CASE WHEN n = 'retail/ecommerce' THEN CASE WHEN promo_flag = 1 OR price_flag = 1 THEN 'Discount' ELSE 'Collection' END ELSE 'Brand' END AS ad_type
      FROM (SELECT *, {PICK_SQL} AS n FROM cases)"""),
)
def channel_and_type(spark, sf):
    n = F.col("ad_niche")
    return niched(spark, sf).select("event_id", "ad_niche", P.ad_channel(n).alias("channel"), P.ad_type(n, F.col("promo_flag"), F.col("price_flag")).alias("ad_type"))


@query(
    "paid_feature_table",
    with_cases(f"""SELECT video_id, 'Winter' AS campaign, 2.0::DOUBLE AS month, 4.0::DOUBLE AS weekday, {s.r6(s.clip('er', 0.001, 0.2))} AS ctr_prior, {s.r6(s.clip('retention_rate * 0.12::DOUBLE', 0.001, 0.3))} AS cvr_prior,
      {s.r6('views / hours_since_publication')} AS views_per_hour, ad_category AS selected_ad_category
      FROM (SELECT *, CASE WHEN engagement_rate <= 0 AND views > 0 THEN (likes + comments) / views ELSE engagement_rate END AS er FROM cases)"""),
)
def paid_features(spark, sf):
    out = P.paid_feature_table(niched(spark, sf), V.AS_OF)
    return out.select("video_id", "campaign", "month", "weekday", r6("ctr_prior", "ctr_prior"), r6("cvr_prior", "cvr_prior"), r6("views_per_hour", "views_per_hour"), "selected_ad_category")


CPM_SQL = f"""paid0 AS (SELECT *, {PICK_SQL} AS n, CASE WHEN engagement_rate <= 0 AND views > 0 THEN (likes + comments) / views ELSE engagement_rate END AS er0 FROM cases),
paid1 AS (SELECT *, {s.clip('er0', 0, 0.25)} AS er, CASE WHEN views <> 0 THEN views / hours_since_publication ELSE 0 END AS vph, greatest(duration_seconds, 1) AS dur, {s.case('n', fv.NICHE_BASE_CPM, '5.6::DOUBLE')} AS base FROM paid0),
paid2 AS (SELECT *, probability * 0.42::DOUBLE + {s.clip('er / 0.075::DOUBLE', 0, 1)} * 0.23::DOUBLE + {s.clip('retention_rate / 0.62::DOUBLE', 0, 1)} * 0.22::DOUBLE + {s.clip('vph / 700.0::DOUBLE', 0, 1)} * 0.09::DOUBLE
  + {s.clip('(75 - least(dur, 75)) / 75.0::DOUBLE', 0, 1)} * 0.04::DOUBLE AS quality FROM paid1),
paid3 AS (SELECT *, title || '|' || description || '|' || n || '|v' || CASE WHEN views >= 100 THEN printf('%.1f', round_even(views / 100, 0) * 100) ELSE CAST(views AS VARCHAR) END || '|e' || printf('%.4f', er)
  || '|r' || printf('%.4f', retention_rate) || '|h' || printf('%.1f', hours_since_publication) || '|p' || printf('%.4f', probability) AS fp FROM paid2),
paid4 AS MATERIALIZED (SELECT *, {s.clip(f'''base * (1.3::DOUBLE - 0.42::DOUBLE * {s.clip('quality', 0, 1)}) * CASE WHEN probability >= 0.75 THEN 0.93 WHEN probability < 0.4 THEN 1.1 ELSE 1 END::DOUBLE
  * CASE WHEN er >= 0.08 THEN 0.92 WHEN er < 0.015 THEN 1.13 ELSE 1 END::DOUBLE * CASE WHEN retention_rate >= 0.6 THEN 0.93 WHEN retention_rate <> 0 AND retention_rate < 0.25 THEN 1.12 ELSE 1 END::DOUBLE
  * CASE WHEN vph >= 1000 THEN 0.94 WHEN vph < 50 THEN 1.06 ELSE 1 END::DOUBLE * CASE WHEN budget >= 100 THEN 1.06 WHEN budget > 0 AND budget <= 20 THEN 0.97 ELSE 1 END::DOUBLE
  * CASE WHEN views < 100 THEN 1.08 ELSE 1 END::DOUBLE * ({jitter_sql('fp', 0.115)})''', 2.2, 18)} AS rcpm FROM paid3)"""


@query("paid_quality", with_cases("") .rstrip() + f", {CPM_SQL} SELECT event_id, {s.r6('quality')} AS quality FROM paid4")
def paid_quality(spark, sf):
    return P.dynamic_cpm(P.niche_cpm(niched(spark, sf))).select("event_id", r6("quality", "quality"))


@query("dynamic_cpm", with_cases("").rstrip() + f", {CPM_SQL} SELECT event_id, {s.r6('rcpm')} AS cpm FROM paid4")
def dynamic_cpm(spark, sf):
    return P.dynamic_cpm(P.niche_cpm(niched(spark, sf))).select("event_id", r6("rules_cpm_raw", "cpm"))


FUNNEL_SQL = f"""funnel AS MATERIALIZED (SELECT *, round({s.clip('quality * 0.34::DOUBLE + 0.1::DOUBLE', 0.08, 0.48)}, 4) AS vtr, round({s.clip('er * 0.4::DOUBLE + quality * 0.02::DOUBLE + 0.004::DOUBLE', 0.003, 0.085)}, 4) AS ctr,
  round({s.clip('probability * 44 + quality * 30 - rcpm / 18.0::DOUBLE * 7 + 32', 0, 100)}, 2) AS rscore, round(rcpm, 4) AS rc FROM paid4)"""


@query(
    "paid_funnel",
    with_cases("").rstrip() + f", {CPM_SQL}, {FUNNEL_SQL} SELECT event_id, vtr, ctr, rscore, rc, round(CASE WHEN budget > 0 THEN budget / rcpm * 1000 ELSE 0 END, 0) AS impressions FROM funnel",
)
def paid_funnel(spark, sf):
    out = P.paid_funnel(P.dynamic_cpm(P.niche_cpm(niched(spark, sf))))
    return out.select(
        "event_id", F.col("estimated_view_through_rate").alias("vtr"), F.col("estimated_ctr").alias("ctr"), F.col("rules_paid_performance_score").alias("rscore"),
        F.col("rules_cpm").alias("rc"), F.col("rules_budget_impressions").alias("impressions"),
    )


BLEND_SQL = f"""blend0 AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 120 END::DOUBLE AS ms, CASE WHEN event_id % 3 = 1 THEN 1.1::DOUBLE + (event_id % 30) / 1.3::DOUBLE END AS mc FROM funnel),
blend AS MATERIALIZED (SELECT *, CASE WHEN mc IS NOT NULL THEN {s.clip("greatest(0.0, least(100.0, ms)) * 0.55::DOUBLE + rscore * 0.45::DOUBLE", 0, 100)}
  WHEN ms IS NOT NULL THEN {s.clip("greatest(0.0, least(100.0, ms)) * 0.6::DOUBLE + rscore * 0.4::DOUBLE", 0, 100)} ELSE rscore END AS score,
  CASE WHEN mc IS NOT NULL THEN {s.clip("greatest(1.0, least(25.0, mc)) * 0.35::DOUBLE + rc * 0.65::DOUBLE", 2.2, 18)} ELSE rc END AS bc FROM blend0)"""


def blended(spark, sf):
    i = F.col("event_id")
    chain = P.paid_funnel(P.dynamic_cpm(P.niche_cpm(niched(spark, sf)))).withColumns(
        {"ms": F.when(i % 3 != 0, (i % 120).cast("double")), "mc": F.when(i % 3 == 1, (i % 30) / 1.3 + 1.1)}
    )
    return P.paid_blend(chain, model_score="ms", model_cpm="mc")


@query(
    "paid_blend",
    with_cases("").rstrip() + f""", {CPM_SQL}, {FUNNEL_SQL}, {BLEND_SQL} SELECT event_id, probability >= 0.51 AS gate, {s.r6('round(bc, 4)')} AS cpm, round(1000.0::DOUBLE / bc, 2) AS per_dollar,
      round(CASE WHEN budget > 0 THEN budget / bc * 1000 ELSE 0 END, 0) AS impressions FROM blend""",
)
def paid_blend(spark, sf):
    p = "paid."
    return blended(spark, sf).select(
        "event_id", F.col(f"{p}gate_passed").alias("gate"), r6(f"{p}predicted_cpm", "cpm"), F.col(f"{p}estimated_impressions_per_dollar").alias("per_dollar"),
        F.col(f"{p}estimated_budget_impressions").alias("impressions"),
    )


@query(
    "paid_advice",
    with_cases("").rstrip() + f""", {CPM_SQL}, {FUNNEL_SQL}, {BLEND_SQL} SELECT event_id, CASE WHEN probability < 0.51 THEN {s.q(msg.PAID_NOT_YET)} WHEN score >= 70 AND bc <= 8 THEN {s.q(msg.PAID_VIABLE)}
      WHEN score >= 58 THEN {s.q(msg.PAID_MODERATE)} WHEN round(quality * 100, 2) >= 55 THEN {s.q(msg.PAID_CREATIVE)} ELSE {s.q(msg.PAID_RISK)} END AS advice FROM blend""",
)
def paid_advice(spark, sf):
    return blended(spark, sf).select("event_id", F.col("paid.recommendation").alias("advice"))


# --- whole chain and its blocks -----------------------------------------------------


def analysed(spark, sf):
    return analyze_batch(V.videos(spark, sf).withColumn("retention_input", F.lit(0.35)), V.AS_OF, comments=V.comments(spark, sf), reports=False)


@query("analyze_batch")
def batch(spark, sf):
    r = "recommendation."
    return analysed(spark, sf).select(
        "video_id", f"{r}accion_final", f"{r}score_hibrido", f"{r}probabilidad_rendimiento", "decision", "content_intent",
        F.col("policy.policy_risk_level").alias("policy_risk_level"), F.col("paid.predicted_cpm").alias("cpm"),
        F.col("projection.projected_views_after_boost").alias("projected_views"), "sentimiento_dominante",
    )


@query("analyze_batch_all_sides")
def batch_all(spark, sf):
    out = analyze_batch(
        V.videos(spark, sf), V.AS_OF, comments=V.comments(spark, sf), frames=V.frames(spark, sf), images=V.images(spark, sf)
    )
    return out.select(
        "video_id", "recommendation.accion_final", "ocr_engine", "frames_analyzed", "summary.headline", "analisis_ocr.cobertura",
        "rule_text.steps", "diagnostic.score_0_100",
    )


@query(
    "video_with_signals",
    f"""WITH {V.VIDEOS_SQL}, {V.COMMENTS_SQL}, c AS (SELECT video_id, count(*) AS total FROM comments WHERE {s.strip('text')} <> '' GROUP BY 1)
        SELECT video_id, coalesce(total, 0) AS total, total IS NULL AS silent FROM videos LEFT JOIN c USING (video_id)""",
)
def signals(spark, sf):
    out = video_with_signals(V.videos(spark, sf), comments=V.comments(spark, sf))
    return out.select("video_id", "total", (F.col("sentiment_warning") != "").alias("silent"))


@query(
    "metrics_block",
    with_cases("SELECT event_id, CAST(views AS BIGINT) AS views, round(engagement_rate, 6) AS engagement_rate, round(duration_seconds, 2) AS duration_seconds, round(text_power_score, 4) AS text_power_score, 'no_disponible' AS density FROM cases"),
)
def metrics_block(spark, sf):
    c = cases(spark, sf).withColumns(
        {k: F.lit(None).cast("string") for k in ("visual_text_density", "video_type", "content_intent")}
        | {k: F.lit(1) for k in ("title_word_count", "description_word_count", "transcript_word_count")}
        | {"ocr_relevance_score": F.lit(0.5)}
    )
    m = "metricas."
    return B.metrics_block(c).select("event_id", f"{m}views", f"{m}engagement_rate", f"{m}duration_seconds", f"{m}text_power_score", F.col(f"{m}visual_text_density").alias("density"))


@query(
    "transcript_block",
    with_videos(f"""SELECT video_id, {s.strip('transcript_text')} <> '' AS disponible, CAST(length(transcript_text) AS INTEGER) AS longitud, CAST({s.words_n('transcript_text')} AS INTEGER) AS palabras,
      CASE WHEN length(transcript_text) > 900 THEN substr(transcript_text, 1, 900) || '...' ELSE transcript_text END AS preview FROM videos"""),
)
def transcript_block(spark, sf):
    v = V.videos(spark, sf).withColumns({k: F.lit(1) for k in ("cta_flag", "benefit_flag", "urgency_flag", "trust_flag")} | {"content_intent": F.lit(None).cast("string")})
    b = "analisis_transcripcion."
    return B.transcript_block(v).select("video_id", f"{b}disponible", F.col(f"{b}longitud_caracteres").alias("longitud"), F.col(f"{b}cantidad_palabras").alias("palabras"), f"{b}preview")


@query(
    "ocr_block",
    with_cases("""SELECT event_id, ocr_text <> '' AS disponible, round(ocr_frame_coverage, 4) AS cobertura, CAST(ocr_word_count AS BIGINT) AS palabras, ocr_cta_flag = 1 AS tiene_cta, 'sin_texto' AS densidad,
      round(text_power_score * 100, 1) AS relevancia_pct FROM cases"""),
)
def ocr_block(spark, sf):
    c = cases(spark, sf).withColumns({"content_intent": F.lit("x"), "ocr_relevance_score": F.col("text_power_score")})
    b = "analisis_ocr."
    return B.ocr_block(c).select("event_id", f"{b}disponible", f"{b}cobertura", F.col(f"{b}cantidad_palabras").alias("palabras"), f"{b}tiene_cta", f"{b}densidad", f"{b}relevancia_pct")


def diagnosed(spark, sf):
    c = summarised(spark, sf).withColumn(
        "script",
        F.struct(
            (F.col("event_id") % 100).cast("int").alias("script_quality_score"), F.lit("t").alias("tone"), F.lit("h").alias("hook_type"), F.lit("i").alias("transcript_interpretation"),
            F.when(F.col("event_id") % 2 == 0, F.array(F.lit("m1"), F.lit("m2"))).otherwise(F.expr("cast(array() as array<string>)")).alias("recommended_script_improvements"),
            F.when(F.col("event_id") % 5 == 0, F.lit("humor/entretenimiento")).otherwise(F.lit("general/branding")).alias("content_intent"),
        ),
    )
    c = c.withColumns({"content_intent": F.lit("g"), "ocr_role": F.lit("r"), "ocr_relevance_score": F.lit(0.25), "ocr_context_overlap": F.lit(0.1), "shares": F.lit(1.0), "average_watch_time": F.lit(2.0), "transcript_word_count": F.lit(3), "visual_summary": F.lit("s")})
    return D.diagnostic_struct(c)


@query(
    "diagnostic_struct",
    with_cases(f"""SELECT event_id, CAST({s.bround('round(probability * 100, 6)')} AS INTEGER) AS pct, {s.r6('round(engagement_rate * 100, 2)')} AS engagement_pct, CAST(views AS BIGINT) AS views,
      CASE WHEN event_id % 5 = 0 THEN 'humor/entretenimiento' ELSE 'general/branding' END AS intent, substr(transcript_text, 1, 1200) AS preview, {whole_sql(PROJ_SQL)} AS views_esperadas FROM cases"""),
)
def diagnostic(spark, sf):
    d = "diagnostic."
    return diagnosed(spark, sf).select(
        "event_id", F.col(f"{d}probabilidad_pct").alias("pct"), r6(f"{d}metricas_publicas.engagement_pct", "engagement_pct"), f"{d}metricas_publicas.views",
        F.col(f"{d}content_intent").alias("intent"), f"{d}transcripcion.preview", f"{d}proyeccion.views_esperadas",
    )


@query(
    "rule_recommendation",
    with_cases(f"""SELECT event_id, {s.case('a', msg.HEADLINE, "''")} AS headline, CAST(2 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS reasons,
      CASE WHEN event_id % 5 = 0 THEN {s.q(' | '.join(msg.RULE_NEXT_HUMOR))} WHEN event_id % 2 = 0 THEN 'm1 | m2' ELSE {s.q(' | '.join(msg.RULE_NEXT_DEFAULT))} END AS steps
      FROM (SELECT *, {action_sql(HYBRID_SQL)} AS a FROM cases)"""),
)
def rule_text(spark, sf):
    return D.rule_recommendation(diagnosed(spark, sf)).select(
        "event_id", "rule_text.headline", F.size("rule_text.reasons").alias("reasons"), joined("rule_text.steps", "steps")
    )


