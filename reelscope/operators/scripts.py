"""Script (transcript) quality: corpus version, intent-aware version, reference patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions import text as T
from reelscope.functions.arrays import build_array, or_default, text_array
from reelscope.functions.numeric import safe_float
from reelscope.functions.terms import TermIndex, starts_with_any
from reelscope.operators import messages as msg
from reelscope.operators.policy import lexicon_match
from reelscope.operators.sampling import top_k
from reelscope.session import materialize, settled

S = msg.SCRIPT
_QUALITY = TermIndex(
    {
        "cta": fv.SCRIPT_CTA_TERMS, "benefit": fv.SCRIPT_BENEFIT_TERMS, "urgency": fv.SCRIPT_URGENCY_TERMS,
        "trust": fv.SCRIPT_TRUST_TERMS, "exaggerated": fv.SCRIPT_EXAGGERATED_TERMS,
    }
)
_HOOK = TermIndex({"benefit": fv.SCRIPT_BENEFIT_TERMS})
_OPENING = TermIndex({"generic": fv.SCRIPT_GENERIC_OPENINGS})


def bounded(score) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def claim_risk(n: Column) -> Column:
    return F.when(n >= 2, F.lit("alto")).when(n == 1, F.lit("medio")).otherwise(F.lit("bajo"))


def script_quality(df: DataFrame, transcript: str = "transcript") -> DataFrame:
    """Four component scores and the weighted quality score of every transcript."""
    base = df.withColumn("_t", T.clean(transcript)).withColumn("_h", T.first_words("_t", 30))
    base = base.withColumns(
        {
            "_f": _QUALITY.scan("_t"),
            "_hf": _HOOK.scan("_h"),
            "_of": _OPENING.scan(F.substring(F.lower("_h"), 1, 160)),
        }
    )
    low_hook = F.lower("_h")
    base = base.withColumns(
        {
            "transcript_word_count": T.token_count("_t"),
            "hook_first_30_words": F.col("_h"),
            "hook_has_question": (
                F.col("_h").contains("?") | starts_with_any(low_hook, fv.SCRIPT_QUESTION_STARTS)
            ).cast("int"),
            "hook_has_benefit": _HOOK.any("_hf", "benefit"),
            "generic_opening": _OPENING.any("_of", "generic"),
            "cta_count": _QUALITY.hits("_f", "cta"),
            "benefit_count": _QUALITY.hits("_f", "benefit"),
            "urgency_count": _QUALITY.hits("_f", "urgency"),
            "trust_count": _QUALITY.hits("_f", "trust"),
            "exaggerated_claim_count": _QUALITY.hits("_f", "exaggerated"),
            "_len": T.mean_sentence_length("_t"),
            "_bang": T.count_text(F.col("_t"), "!"),
        }
    )
    n = F.col("transcript_word_count")
    clarity = (
        F.lit(78)
        - F.when(n < 25, 15).otherwise(0)
        - F.when(n > 2500, 12).otherwise(0)
        - F.when(F.col("_len") > 28, 15).otherwise(0)
        - F.when(F.col("_bang") > 6, 6).otherwise(0)
    )
    base = base.withColumns(
        {
            "avg_sentence_length": F.round("_len", 2),
            "hook_score": bounded(
                F.col("hook_has_question") * 20 + F.col("hook_has_benefit") * 25 - F.col("generic_opening") * 20 + 50
            ),
            "cta_score": bounded(F.least("cta_count", F.lit(3)) * 20 + 35),
            "value_proposition_score": bounded(
                F.least("benefit_count", F.lit(4)) * 12 + F.least("trust_count", F.lit(2)) * 8 + 45
            ),
            "clarity_score": bounded(clarity),
            "policy_claim_risk": claim_risk(F.col("exaggerated_claim_count")),
        }
    )
    total = (
        F.col("hook_score") * 0.30 + F.col("clarity_score") * 0.25
        + F.col("value_proposition_score") * 0.25 + F.col("cta_score") * 0.20
    )
    return base.withColumn("script_quality_score", F.bround(F.round(total, 6)).cast("int")).drop(
        "_t", "_h", "_f", "_hf", "_of", "_len", "_bang"
    )


def transcript_features(documents: DataFrame, source: str = "transcripts") -> DataFrame:
    """Script features of every non-empty document (video_id, transcript)."""
    kept = documents.where(T.clean("transcript") != "").withColumn("transcript", T.clean("transcript"))
    return script_quality(kept).withColumns(
        {"source_dataset": F.lit(source), "title": F.lit(""), "views": F.lit(None).cast("double")}
    )


def pattern_terms(features: DataFrame, *, key: str = "video_id", top: int, n: int = 20) -> DataFrame:
    """Document frequency of hook, benefit and call-to-action terms in the best scripts: (kind, term, n, rank)."""
    from reelscope.operators.dedup import top_per_group

    best = top_k(features, "script_quality_score", top, [key]).select(key, "hook_first_30_words", "transcript")
    best = materialize(best)  # few rows, read twice: the corpus is scored once
    hooks = lexicon_match(best, key, "hook_first_30_words", {"hook": fv.SCRIPT_BENEFIT_TERMS})
    bodies = lexicon_match(best, key, "transcript", {"benefit": fv.SCRIPT_BENEFIT_TERMS, "cta": fv.SCRIPT_CTA_TERMS})
    counts = hooks.unionByName(bodies).groupBy(F.col("category").alias("kind"), "term").agg(F.count("*").alias("n"))
    return top_per_group(counts, ["kind"], [F.col("n").desc(), F.col("term").asc()], n)


def pattern_reference(features: DataFrame, *, key: str = "video_id", top: int, n: int = 20) -> DataFrame:
    """One row: size, mean and 75th percentile of quality, most frequent terms; defaults for an empty corpus."""
    terms = pattern_terms(features, key=key, top=top, n=n)
    # At most n terms per kind reach these lists.
    packed = terms.groupBy().agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "term")))), lambda s: s["term"]
            ).alias(k)
            for k in ("hook", "cta", "benefit")
        ]
    )
    # Quality is an integer from 0 to 100, so the exact percentile needs at most 101 counters.
    stats = features.agg(
        F.count("*").alias("n_transcripts"),
        F.round(F.avg("script_quality_score"), 2).alias("mean"),
        F.round(F.percentile("script_quality_score", 0.75), 2).alias("p75"),
    )
    lists = packed.select(F.struct("hook", "cta", "benefit").alias("p")).scalar()

    def or_sorted(found, fallback):
        return F.when(F.size(found) > 0, found).otherwise(text_array(*sorted(fallback)[:n]))

    benefit, cta = fv.SCRIPT_BENEFIT_TERMS, fv.SCRIPT_CTA_TERMS
    return stats.withColumn("p", lists).select(
        F.when(F.col("n_transcripts") > 0, F.lit("transcripts")).otherwise(F.lit("default_rules")).alias("source"),
        "n_transcripts",
        F.coalesce("mean", F.lit(0.0)).alias("quality_score_mean"),
        F.coalesce("p75", F.lit(70.0)).alias("quality_score_p75"),
        or_sorted(F.col("p.hook"), benefit).alias("top_hook_patterns"),
        or_sorted(F.col("p.cta"), cta).alias("top_cta_patterns"),
        or_sorted(F.col("p.benefit"), benefit).alias("top_benefit_patterns"),
        text_array(*sorted(fv.SCRIPT_EXAGGERATED_TERMS)).alias("risk_terms"),
        text_array(*sorted(fv.SCRIPT_GENERIC_OPENINGS)).alias("generic_openings"),
    )


# --- intent-aware analysis ---------------------------------------------------

_INTENT = TermIndex(
    {
        "commercial": fv.ANALYZER_COMMERCIAL_TERMS, "benefit": fv.SCRIPT_BENEFIT_TERMS, "cta": fv.SCRIPT_CTA_TERMS,
        "humor": fv.ANALYZER_HUMOR_TERMS, "edu": fv.ANALYZER_EDU_TERMS, "news": fv.ANALYZER_NEWS_TERMS,
        "lifestyle": fv.ANALYZER_LIFESTYLE_TERMS,
    }
)
_BODY = TermIndex(
    {
        "cta": fv.SCRIPT_CTA_TERMS, "benefit": fv.SCRIPT_BENEFIT_TERMS, "urgency": fv.SCRIPT_URGENCY_TERMS,
        "trust": fv.SCRIPT_TRUST_TERMS, "exaggerated": fv.SCRIPT_EXAGGERATED_TERMS,
        "commercial": fv.ANALYZER_COMMERCIAL_TERMS, "humor": fv.ANALYZER_HUMOR_TERMS, "edu": fv.ANALYZER_EDU_TERMS,
        "irony": fv.ANALYZER_IRONY_TERMS, "testimonial": fv.ANALYZER_TESTIMONIAL_TERMS,
        "humor_cues": fv.ANALYZER_HUMOR_FIT_CUES, "edu_cues": fv.ANALYZER_EDU_FIT_CUES,
    }
)
_LEAD = TermIndex(
    {
        "humor": fv.ANALYZER_HUMOR_TERMS, "situation": fv.ANALYZER_SITUATION_TERMS, "cues": fv.ANALYZER_HOOK_HUMOR_CUES,
        "benefit": fv.SCRIPT_BENEFIT_TERMS, "commercial": fv.ANALYZER_COMMERCIAL_TERMS,
    }
)


def full_intent(found) -> Column:
    """Intent from ids found by ``full_intent_scan``: humour, commercial, educational, news, lifestyle, general."""
    commercial = sum((_INTENT.hits(found, k) for k in ("benefit", "cta")), _INTENT.hits(found, "commercial"))
    return (
        F.when((_INTENT.hits(found, "humor") >= 1) & (commercial < 3), F.lit("humor/entretenimiento"))
        .when(commercial >= 3, F.lit("comercial/promocional"))
        .when(_INTENT.hits(found, "edu") >= 2, F.lit("educativo/tutorial"))
        .when(_INTENT.hits(found, "news") >= 1, F.lit("informativo/noticioso"))
        .when(_INTENT.any(found, "lifestyle") == 1, F.lit("entretenimiento/lifestyle"))
        .otherwise(F.lit(fv.NICHE_DEFAULT))
    )


def full_intent_scan(*parts) -> Column:
    return _INTENT.scan(T.corpus_text(*parts))


def script_tone(low_found, intent: Column) -> Column:
    """Ordered tone rule over ids found in the combined text."""
    h = lambda k: _BODY.hits(low_found, k)
    return (
        F.when(
            intent.startswith("humor"),
            F.when(h("irony") > 0, F.lit("humorístico/irónico")).otherwise(F.lit("humorístico/entretenimiento")),
        )
        .when((h("exaggerated") >= 2) | (h("urgency") >= 3), F.lit("sensacionalista/agresivo"))
        .when(h("testimonial") > 0, F.lit("testimonial"))
        .when(intent.startswith("educativo"), F.lit("educativo"))
        .when((h("cta") > 0) & (h("benefit") > 0), F.lit("promocional"))
        .when(h("trust") > 0, F.lit("informativo/confiable"))
        .otherwise(F.lit("informativo"))
    )


def hook_type(hook: Column, hook_found, intent: Column) -> Column:
    question = hook.contains("?") | starts_with_any(F.lower(hook), fv.ANALYZER_HOOK_STARTS)
    return (
        F.when(question, F.lit("pregunta/curiosidad"))
        .when(intent.startswith("humor") & (_LEAD.any(hook_found, "humor") == 1), F.lit("setup humorístico"))
        .when(_LEAD.any(hook_found, "situation") == 1, F.lit("situación/expectativa"))
        .when(_LEAD.any(hook_found, "benefit") == 1, F.lit("beneficio directo"))
        .when(_LEAD.any(hook_found, "commercial") == 1, F.lit("oferta/comercial"))
        .otherwise(F.lit("contextual"))
    )


def script_signals(df: DataFrame, category="category_id", topic="ad_category") -> DataFrame:
    """Intermediate columns of the intent-aware analysis (prefix ``_``)."""
    have = set(df.columns)
    t, d, tr = T.clean("title"), T.clean("description"), T.clean("transcript_text")
    cat = T.text(category) if category in have else F.lit("")
    top = T.text(topic) if topic in have else F.lit("")
    base = df.withColumns({"_title": t, "_desc": d, "_tr": tr, "_cat": cat, "_top": top})
    base = base.withColumn("_all", T.clean(F.concat_ws(" ", "_title", "_desc", "_tr")))
    lead = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("_tr", "_title", "_desc")], F.lit(""))
    base = base.withColumn("_hook", T.first_words(lead, 45))
    return base.withColumns(
        {
            "_if": full_intent_scan("_title", "_desc", "_tr", "_cat", "_top"),
            "_bf": _BODY.scan("_all"),
            "_lf": _LEAD.scan("_hook"),
            "_gf": _OPENING.scan(F.substring(F.lower("_hook"), 1, 180)),
            "_n": T.token_count("_tr"),
            "_len": T.mean_sentence_length("_tr", ".!?¿¡"),
            "_bang": T.count_text(F.col("_all"), "!"),
        }
    )


def script_analysis(df: DataFrame, *, category="category_id", topic="ad_category", name: str = "script") -> DataFrame:
    """Adds a struct with hook, clarity, intent-fit and CTA scores, tone, advice and suggestions.

    Without a transcript the scores are null and the texts say so.
    """
    base = settled(script_signals(df, category, topic))
    base = base.withColumn("_intent", full_intent("_if"))
    intent, n = F.col("_intent"), F.col("_n")
    b = lambda k: _BODY.hits("_bf", k)
    is_humor, is_sale, is_edu = (intent.startswith(p) for p in ("humor", "comercial", "educativo"))
    low_hook = F.lower("_hook")
    duration = safe_float("duration_seconds") if "duration_seconds" in df.columns else F.lit(0.0)

    hook = (
        F.lit(52)
        + F.when(F.col("_hook").contains("?") | starts_with_any(low_hook, fv.ANALYZER_HOOK_STARTS), 16).otherwise(0)
        + F.when(is_humor & ((b("humor") > 0) | (_LEAD.any("_lf", "cues") == 1)), 22)
        .when(is_sale & ((b("benefit") > 0) | (b("commercial") > 0)), 20)
        .when(is_edu & (b("edu") > 0), 18)
        .otherwise(0)
        - F.when(_OPENING.any("_gf", "generic") == 1, 12).otherwise(0)
        - F.when(n < 10, 12).otherwise(0)
    )
    clarity = (
        F.lit(76)
        - F.when(n < 12, 16).when((n > 600) & (duration <= 60), 12).otherwise(0)
        - F.when(F.col("_len") > 24, 12).otherwise(0)
        - F.when(F.col("_bang") > 9, 8).otherwise(0)
    )
    fit = F.lit(55) + F.when(
        is_humor,
        F.when(b("humor") > 0, 18).otherwise(6)
        + F.when(_BODY.any("_bf", "humor_cues") == 1, 10).otherwise(0)
        + F.when((n > 0) & (n <= 120), 8).otherwise(0),
    ).when(
        is_sale,
        F.least(b("commercial"), F.lit(4)) * 8 + F.least(b("benefit"), F.lit(3)) * 6 + F.least(b("trust"), F.lit(2)) * 4,
    ).when(
        is_edu, F.least(b("edu"), F.lit(4)) * 8 + F.when(_BODY.any("_bf", "edu_cues") == 1, 8).otherwise(0)
    ).otherwise(F.when(n >= 20, 10).otherwise(0))
    soft = is_humor | intent.startswith("entretenimiento")
    cta = (
        F.when(is_sale, F.least(b("cta"), F.lit(3)) * 20 + F.least(b("commercial"), F.lit(2)) * 8 + 35)
        .when(soft, F.when(b("cta") == 0, 68).otherwise(78))
        .otherwise(F.least(b("cta"), F.lit(2)) * 12 + 55)
    )
    base = base.withColumns(
        {
            "_hs": bounded(hook), "_cs": bounded(clarity), "_fs": bounded(fit), "_as": bounded(cta),
            "_risk": claim_risk(b("exaggerated")), "_cta_n": b("cta"), "_soft": soft,
        }
    )
    total = F.col("_hs") * 0.28 + F.col("_cs") * 0.26 + F.col("_fs") * 0.30 + F.col("_as") * 0.16
    base = base.withColumn("_score", F.bround(F.round(total, 6)).cast("int"))
    spoken = n > 0
    no = F.lit(msg.SCRIPT_MISSING)
    cta_clarity = (
        F.when(is_sale, F.when(F.col("_as") >= 70, F.lit("claro")).otherwise(F.lit("débil o ausente")))
        .when(F.col("_soft"), F.when(F.col("_cta_n") == 0, F.lit("no crítico para humor/entretenimiento")).otherwise(F.lit("presente")))
        .otherwise(F.when(F.col("_cta_n") > 0, F.lit("presente")).otherwise(F.lit("opcional según objetivo")))
    )
    advice = script_advice()
    missing = text_array(msg.SCRIPT_MISSING)

    def only(c):
        return F.when(spoken, c)

    block = F.struct(
        only(F.col("_score")).alias("script_quality_score"),
        only(F.col("_hs")).alias("hook_score"),
        only(F.col("_cs")).alias("clarity_score"),
        only(F.col("_fs")).alias("intent_fit_score"),
        only(F.col("_as")).alias("cta_score"),
        F.when(spoken, cta_clarity).otherwise(no).alias("cta_clarity"),
        F.when(spoken, F.col("_risk")).otherwise(F.lit("no_evaluable")).alias("policy_claim_risk"),
        F.when(spoken, script_tone("_bf", intent)).otherwise(no).alias("tone"),
        intent.alias("content_intent"),
        F.when(spoken, hook_type(F.col("_hook"), "_lf", intent)).otherwise(F.lit("no evaluable")).alias("hook_type"),
        n.alias("transcript_word_count"),
        T.clip_text("_tr", 900).alias("transcript_preview"),
        F.when(spoken, advice["summary"]).otherwise(no).alias("transcript_summary"),
        F.when(spoken, advice["reading"]).otherwise(no).alias("transcript_interpretation"),
        F.when(spoken, advice["strengths"]).otherwise(F.expr("cast(array() as array<string>)")).alias("main_strengths"),
        F.when(spoken, advice["weaknesses"]).otherwise(missing).alias("main_weaknesses"),
        F.when(spoken, advice["improvements"]).otherwise(missing).alias("recommended_script_improvements"),
        F.when(spoken, advice["hook"]).otherwise(no).alias("suggested_hook"),
        F.when(spoken, advice["cta"]).otherwise(no).alias("suggested_cta"),
        F.when(spoken, advice["copy"]).otherwise(no).alias("suggested_ad_copy"),
        spoken.alias("transcript_available"),
        F.when(spoken, F.lit("intencion_detectada_y_transcripcion")).otherwise(F.lit("sin_transcripcion")).alias("analysis_mode"),
    )
    keep = [c for c in df.columns]
    return base.withColumn(name, block).select(*keep, name)


def script_advice() -> dict[str, Column]:
    """Strengths, weaknesses, improvements and suggestions over the intermediate columns."""
    intent = F.col("_intent")
    is_humor, is_sale, is_edu = (intent.startswith(p) for p in ("humor", "comercial", "educativo"))
    other = ~(is_humor | is_sale | is_edu)
    hs, cs, fs, cta, risk = (F.col(c) for c in ("_hs", "_cs", "_fs", "_as", "_risk"))
    claims = risk.isin("medio", "alto")
    strengths = build_array(
        S["has_transcript"],
        (hs >= 70, S["hook_ok"]),
        (is_humor & (fs >= 68), S["humor_ok"]),
        (is_sale & (fs >= 70), S["value_ok"]),
        (is_edu, S["edu_ok"]),
        (other & (cs >= 70), S["clear_ok"]),
    )
    weaknesses = build_array(
        (hs < 70, S["hook_weak"]),
        (is_humor & (fs < 68), S["humor_weak"]),
        (is_sale & (fs < 70), S["value_weak"]),
        (is_sale & (cta < 70), S["cta_weak"]),
        (other & (cs < 70), S["clear_weak"]),
        (claims, S["claims_weak"]),
    )
    improvements = build_array(
        ((hs < 70) & is_humor, S["hook_humor"]),
        ((hs < 70) & is_sale, S["hook_commercial"]),
        ((hs < 70) & ~is_humor & ~is_sale, S["hook_other"]),
        (is_humor & (fs < 68), S["humor_fix"]),
        (is_humor & (cs < 65), S["humor_noise"]),
        (is_sale & (fs < 70), S["value_fix"]),
        (is_sale & (cta < 70), S["cta_fix"]),
        (is_edu & (cs < 70), S["edu_fix"]),
        (other & (cs < 70), S["clear_fix"]),
        (claims, S["claims_fix"]),
    )
    fallback = (
        F.when(is_humor, text_array(S["try_humor"]))
        .when(is_sale, text_array(S["try_commercial"]))
        .otherwise(text_array(S["try_other"]))
    )
    parts = T.sentences("_tr", ".!?¿¡")
    core = T.clip_text(F.array_join(F.slice(parts, 1, 3), " "), 420)
    lead = (
        F.when(is_humor, F.lit(msg.SCRIPT_SUMMARY["humor"]))
        .when(is_sale, F.lit(msg.SCRIPT_SUMMARY["comercial"]))
        .when(is_edu, F.lit(msg.SCRIPT_SUMMARY["educativo"]))
        .otherwise(F.lit(msg.SCRIPT_SUMMARY["other"]))
    )
    r, score = msg.SCRIPT_READING, F.col("_score")
    reading = (
        F.when(is_humor, F.when(score >= 70, F.lit(r["humor_good"])).otherwise(F.lit(r["humor_weak"])))
        .when(is_sale, F.when(score >= 70, F.lit(r["commercial_good"])).otherwise(F.lit(r["commercial_weak"])))
        .when(is_edu, F.lit(r["educational"]))
        .when(cs < 60, F.lit(r["ambiguous"]))
        .otherwise(F.lit(r["other"]))
    )
    title = F.col("_title")
    topic = F.coalesce(F.nullif(T.clean("_top"), F.lit("")), F.nullif(T.clean("_cat"), F.lit("")), F.lit("el contenido"))
    subject = F.coalesce(F.nullif(title, F.lit("")), topic)
    h, c, p = msg.SUGGEST_HOOK, msg.SUGGEST_CTA, msg.SUGGEST_COPY
    hook = (
        F.when(is_humor, F.lit(h["humor"]))
        .when(is_edu, F.concat(F.lit(h["educativo"]), topic))
        .when(is_sale & (title != ""), F.concat(F.lit(h["comercial_title"]), F.lower(title)))
        .when(is_sale, F.concat(F.lit(h["comercial"]), topic))
        .when(title != "", F.concat(F.lit(h["title"]), title))
        .otherwise(F.concat(F.lit(h["other"]), topic))
    )
    cta_text = (
        F.when(F.col("_soft"), F.lit(c["soft"]))
        .when(is_edu, F.lit(c["educativo"]))
        .when(is_sale, F.lit(c["comercial"]))
        .otherwise(F.lit(c["other"]))
    )
    copy = (
        F.when(is_humor, F.concat(F.lit(p["humor"]), subject))
        .when(claims, F.concat(F.lit(p["claims"]), subject))
        .when(is_sale, F.concat(F.lit(p["comercial"]), subject))
        .otherwise(F.concat(F.lit(p["other"]), subject))
    )
    return {
        "strengths": strengths,
        "weaknesses": or_default(weaknesses, S["no_weakness"]),
        "improvements": F.when(F.size(improvements) > 0, improvements).otherwise(fallback),
        "summary": F.when(F.size(parts) == 0, T.clip_text("_tr", 360)).otherwise(F.concat(lead, core)),
        "reading": reading,
        "hook": hook,
        "cta": cta_text,
        "copy": copy,
    }
