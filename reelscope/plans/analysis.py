"""The whole decision chain for a table of videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.functions import numeric as N
from reelscope.functions import text as T
from reelscope.functions.temporal import hours_since
from reelscope.operators import decision as D
from reelscope.operators import features as X
from reelscope.operators import normalize as B
from reelscope.operators import paid as P
from reelscope.operators import policy as K
from reelscope.operators import screen as O
from reelscope.operators import scripts as Q
from reelscope.operators import sentiment as M
from reelscope.operators import visual as W
from reelscope.session import settled


def video_with_signals(
    videos: DataFrame, *, comments: DataFrame | None = None, frames: DataFrame | None = None,
    images: DataFrame | None = None, channels: DataFrame | None = None,
) -> DataFrame:
    """One row per video with its comment, on-screen-text, frame and channel roll-ups (left joins on ``video_id``)."""
    out = videos
    if comments is not None:
        summary = M.sentiment_summary(M.score_comments(M.written_comments(comments)))
        out = out.join(summary, "video_id", "left")
        out = M.with_empty_sentiment(out).withColumnRenamed("warning", "sentiment_warning")
    if frames is not None:
        rolled = O.ocr_rollup(frames).join(O.first_text(frames), "video_id", "left")
        manual = F.nullif(T.strip("ocr_text"), F.lit("")) if "ocr_text" in videos.columns else F.lit(None).cast("string")
        out = out.withColumn("_manual", manual).drop("ocr_text").join(rolled, "video_id", "left")
        out = out.withColumn("ocr_text", F.coalesce("_manual", "ocr_text", F.lit(""))).drop("_manual")
    else:
        out = out.withColumn("ocr_text", T.text("ocr_text") if "ocr_text" in videos.columns else F.lit(""))
        out = out.withColumn(
            "visual_text_density", F.when(T.strip("ocr_text") == "", F.lit("sin_texto")).otherwise(F.lit("media"))
        )
    if images is not None:
        motion = W.frame_motion(images)
        rolled = W.visual_advice(W.visual_summary(W.visual_rollup(W.frame_scores_with(motion))))
        out = out.join(rolled.drop("ocr_text").withColumn("visual_ok", F.lit(True)), "video_id", "left")
    if channels is not None:
        out = out.join(channels, "channel_id", "left")
    defaults = {
        "ocr_frame_coverage": F.lit(0.0), "ocr_frame_count": F.lit(0), "ocr_frames_with_text": F.lit(0),
        "ocr_cta_flag": F.lit(0), "ocr_promo_flag": F.lit(0), "ocr_trust_flag": F.lit(0), "ocr_urgency_flag": F.lit(0),
        "visual_ok": F.lit(False), "composition_score": F.lit(0.0), "visual_summary": F.lit(None).cast("string"),
        "visual_recommendations": F.expr("cast(array() as array<string>)"),
        "visual_text_density": F.lit("sin_texto"), "retention_input": F.lit(0.0), "average_watch_time": F.lit(0.0),
        "shares": F.lit(0.0), "budget": F.lit(0.0),
    }
    have = set(out.columns)
    return out.withColumns({k: F.coalesce(k, v) if k in have else v for k, v in defaults.items()})


def analyze_batch(
    videos: DataFrame, as_of, *, model=None, predicted: dict | None = None, model_score: str | None = None,
    model_cpm: str | None = None, reports: bool = True, **sides: DataFrame,
) -> DataFrame:
    """Features, probability, script, policy, operations, paid estimate, recommendation, projection and summaries.

    After the side joins everything is projection: no further shuffle.
    ``reports=False`` stops at the decision and leaves the explanatory blocks out of the plan.
    """
    base = video_with_signals(videos, **sides)
    have = set(base.columns)
    for c in ("title", "description", "transcript_text"):
        base = base.withColumn(c, T.text(c) if c in have else F.lit(""))
    if "ad_category" not in have:
        base = base.withColumn("ad_category", F.lit("auto"))
    base = X.ocr_intent_fallback(base).withColumn(
        "ocr_text", F.when(F.col("ocr_corrected_text") != "", F.col("ocr_corrected_text")).otherwise(F.col("ocr_text"))
    )
    read = T.strip("ocr_text") != ""
    base = base.withColumns({
        "_oi": F.when(read, F.col("ocr_llm_content_intent")), "_or": F.when(read, F.col("ocr_llm_role")),
    })
    featured = X.feature_table(base, as_of, override_intent="_oi", override_role="_or").drop("_oi", "_or")
    scored = D.score_videos(settled(featured), model)
    scripted = Q.script_analysis(scored)
    spoken = T.strip("transcript_text") != ""
    screened = K.policy_risk(
        scripted.withColumn("_pt", T.strip(F.concat_ws(" ", "title", "description", "transcript_text"))), "_pt", spoken
    ).drop("_pt")
    hours = F.coalesce(hours_since("published_at", as_of), F.lit(24.0))
    ops = N.operational_metrics(
        "views", "shares", N.retention("average_watch_time", "duration_seconds", "retention_input"), hours
    )
    operated = screened.withColumns(ops).withColumns(
        {
            "transcript_ok": F.coalesce(F.col("transcript_ok"), spoken) if "transcript_ok" in have else spoken,
            "has_text": T.strip(F.concat_ws(" ", "title", "description", "transcript_text")) != "",
        }
    )
    paid = P.paid_estimate(operated, model_score=model_score, model_cpm=model_cpm)
    paid = paid.withColumn("cpm", F.col("paid.predicted_cpm"))
    decided = D.boost_projection(D.recommendation(paid), predicted=predicted)
    unified = decided.withColumn(
        "impressions",
        D.unify_impressions(
            F.col("recommendation.alcance_estimado_total"), F.col("paid.estimated_budget_impressions"), "budget",
            F.col("paid.estimated_view_through_rate"),
        ),
    )
    code = D.decision_label(
        F.col("recommendation.accion_final"), F.col("policy.policy_risk_level"), F.col("paid.eligible_for_paid"),
        F.col("recommendation.score_hibrido"),
    )
    decided = unified.withColumn("decision", code)
    if not reports:
        return decided
    told = D.message_rules(decided)
    told = D.chart_data(D.executive_summary(D.local_explanation(told)))
    told = D.rule_recommendation(D.diagnostic_struct(told))
    return B.ocr_block(B.transcript_block(B.metrics_block(told)))
