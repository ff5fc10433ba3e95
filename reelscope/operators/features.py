"""Feature tables: text signals, engagement, intent and on-screen-text relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions import arrays as A
from reelscope.functions import numeric as N
from reelscope.functions import text as T
from reelscope.functions.temporal import parse_ts
from reelscope.functions.terms import TermIndex
from reelscope.operators import messages as msg
from reelscope.operators.normalize import fill_defaults, rename_aliases

SIGNALS = {
    "cta": fv.CTA_TERMS, "urgency": fv.URGENCY_TERMS, "trust": fv.TRUST_TERMS,
    "promo": fv.PROMO_TERMS, "benefit": fv.BENEFIT_TERMS, "price": fv.PRICE_TERMS,
}
INTENTS = {
    "humor": fv.LIGHT_HUMOR_TERMS, "edu": fv.LIGHT_EDU_TERMS, "music": fv.LIGHT_MUSIC_TERMS,
    "commercial": fv.LIGHT_COMMERCIAL_TERMS, "news": fv.LIGHT_NEWS_TERMS,
}


def lexicon_flags(df: DataFrame, text="text_total", lexicons=SIGNALS) -> DataFrame:
    """One 0/1 column ``<name>_flag`` per word list."""
    index = TermIndex(lexicons)
    scanned = df.withColumn("_found", index.scan(text))
    return scanned.withColumns({f"{k}_flag": index.any("_found", k) for k in lexicons}).drop("_found")


def text_power(flags: dict[str, Column], n_words: Column, ocr_coverage=None) -> Column:
    """Weighted flags plus a length bonus, plus a bonus for on-screen text when coverage is known."""
    score = sum((flags[k] * F.lit(w) for k, w in fv.TEXT_POWER_WEIGHTS.items()), F.lit(0.0))
    score = score + F.when(n_words.between(8, 120), F.lit(0.10)).when(n_words > 120, F.lit(0.04)).otherwise(F.lit(0.0))
    if ocr_coverage is not None:
        score = score + F.when(N.safe_float(ocr_coverage) > 0, F.lit(0.07)).otherwise(F.lit(0.0))
    return F.round(F.least(score, F.lit(1.0)), 4)


def corpus_features(df: DataFrame, as_of) -> DataFrame:
    """Raw catalogue rows to the training feature table (aliases, defaults, text, engagement)."""
    base = fill_defaults(rename_aliases(df))
    if base.schema["published_at"].dataType.typeName() == "string":
        base = base.withColumn("published_at", parse_ts("published_at"))
    else:
        base = base.withColumn("published_at", F.col("published_at").cast("timestamp"))
    base = base.withColumn("text_total", T.corpus_text("title", "description", "tags"))
    base = base.withColumns(
        {
            "title_len": F.length("title"),
            "description_len": F.length("description"),
            "text_total_word_count": T.word_count("text_total"),
        }
        | N.engagement("views", "likes", "comments", "published_at", as_of, corpus=True)
    )
    flagged = lexicon_flags(base)
    flags = {k: F.col(f"{k}_flag") for k in SIGNALS}
    return flagged.withColumns(
        {
            "text_power_score": text_power(flags, F.col("text_total_word_count")),
            "duration_fit_score": N.duration_fit("duration_seconds"),
        }
    )


def intent_rules(humor, edu, music, commercial, news) -> Column:
    """Ordered light-intent rule over hit counts."""
    return (
        F.when((music >= 1) & (commercial < 3), F.lit("musical"))
        .when((humor >= 1) & (commercial < 3), F.lit("humor/entretenimiento"))
        .when(commercial >= 3, F.lit("comercial/promocional"))
        .when(edu >= 2, F.lit("educativo/tutorial"))
        .when(news >= 1, F.lit("informativo/noticioso"))
        .otherwise(F.lit(fv.NICHE_DEFAULT))
    )


_INTENT_INDEX = TermIndex(INTENTS | {k: SIGNALS[k] for k in ("cta", "promo", "price")})


def content_intent(found) -> Column:
    """Light intent from the ids found by ``intent_scan``."""
    hit = lambda k: _INTENT_INDEX.hits(found, k)
    commercial = hit("commercial") + sum(
        (_INTENT_INDEX.any(found, k) for k in ("promo", "price")), _INTENT_INDEX.any(found, "cta")
    )
    return intent_rules(hit("humor"), hit("edu"), hit("music"), commercial, hit("news"))


def intent_scan(*parts) -> Column:
    return _INTENT_INDEX.scan(T.corpus_text(*parts))


_SCREEN_INDEX = TermIndex(SIGNALS | {k: INTENTS[k] for k in ("humor", "edu", "commercial")})


def ocr_relevance(df: DataFrame, *, override_intent=None, override_role=None, coverage="ocr_frame_coverage") -> DataFrame:
    """Relevance, role and interpretation of on-screen text, weighted by the intent of the video."""
    have = set(df.columns)
    ocr = T.text("ocr_text")
    base = df.withColumns(
        {
            "_i": intent_scan("title", "description", "transcript_text", "ocr_text"),
            "_s": _SCREEN_INDEX.scan(ocr),
            "_a": T.relevance_tokens(ocr),
            "_b": T.relevance_tokens(T.corpus_text("title", "description", "transcript_text")),
            "_w": T.word_count(ocr),
        }
    )
    intent = content_intent("_i")
    if override_intent is not None:
        intent = F.coalesce(F.nullif(N.col(override_intent), F.lit("")), intent)
    s = "_s"
    flags = [_SCREEN_INDEX.any(s, k) for k in ("cta", "benefit", "urgency", "trust", "promo", "price", "commercial")]
    base = base.withColumns(
        {
            "content_intent": intent,
            "_overlap": A.token_overlap("_a", "_b"),
            "_market": sum(flags[1:], flags[0]) / F.lit(7.0),
            "_humor": F.least(_SCREEN_INDEX.hits(s, "humor") / 2, F.lit(1.0)),
            "_edu": F.least(_SCREEN_INDEX.hits(s, "edu") / 2, F.lit(1.0)),
            "_cover": F.least(N.safe_float(coverage), F.lit(1.0)) if coverage in have else F.lit(0.0),
            "_density": F.when(F.col("_w").between(2, 18), F.lit(1.0))
            .when(F.col("_w").between(19, 40), F.lit(0.65))
            .when(F.col("_w") > 40, F.lit(0.35))
            .otherwise(F.lit(0.45)),
        }
    )
    o, m, h, e, c, d = (F.col(x) for x in ("_overlap", "_market", "_humor", "_edu", "_cover", "_density"))
    kind = F.col("content_intent")
    score = (
        F.when(kind.startswith("musical"), o * 0.42 + c * 0.25 + d * 0.23 + F.greatest(h, e) * 0.10)
        .when(kind.startswith("humor"), o * 0.45 + h * 0.20 + c * 0.20 + d * 0.15)
        .when(kind.startswith("educativo"), o * 0.45 + e * 0.20 + c * 0.20 + d * 0.15)
        .when(kind.startswith("comercial"), o * 0.38 + m * 0.34 + c * 0.18 + d * 0.10)
        .otherwise(o * 0.50 + c * 0.20 + d * 0.20 + F.greatest(m, h, e) * 0.10)
    )
    blank = T.strip(ocr) == ""
    role = ocr_role(blank, kind, o, m, h)
    if override_role is not None:
        role = F.coalesce(F.nullif(N.col(override_role), F.lit("")), role)
    return base.withColumns(
        {
            "ocr_role": role,
            "ocr_context_overlap": F.round(o, 4),
            "ocr_marketing_signal": F.round(m, 4),
            "ocr_humor_signal": F.round(h, 4),
            "ocr_relevance_score": F.when(blank, F.lit(0.0)).otherwise(F.round(N.clip(score, 0.0, 1.0), 4)),
            "ocr_interpretation": _by_intent(kind, msg.SCREEN_TEXT, blank),
        }
    ).drop("_i", "_s", "_a", "_b", "_w", "_overlap", "_market", "_humor", "_edu", "_cover", "_density")


def ocr_role(blank, intent, overlap, marketing, humor) -> Column:
    return (
        F.when(blank, F.lit("sin_texto_detectado"))
        .when(
            intent.startswith("musical"),
            F.when(overlap >= 0.15, F.lit("letra_musical_o_rotulo")).otherwise(F.lit("texto_musical_poco_conectado")),
        )
        .when(
            intent.startswith("humor"),
            F.when((humor > 0) | (overlap >= 0.25), F.lit("apoya_contexto_o_remate"))
            .otherwise(F.lit("texto_desconectado_del_chiste")),
        )
        .when(
            intent.startswith("comercial"),
            F.when(marketing >= 0.34, F.lit("refuerza_oferta_cta_o_beneficio"))
            .when(overlap >= 0.25, F.lit("acompaña_mensaje_comercial"))
            .otherwise(F.lit("texto_comercial_poco_claro")),
        )
        .when(
            intent.startswith("educativo"),
            F.when(overlap >= 0.20, F.lit("apoyo_explicativo")).otherwise(F.lit("texto_explicativo_poco_conectado")),
        )
        .otherwise(
            F.when(overlap >= 0.20, F.lit("contexto_visual")).otherwise(F.lit("texto_visible_sin_funcion_clara"))
        )
    )


def _by_intent(intent, table, blank) -> Column:
    chain = F.when(blank, F.lit(table["blank"]))
    for prefix in ("musical", "humor", "comercial", "educativo"):
        chain = chain.when(intent.startswith(prefix), F.lit(table[prefix]))
    return chain.otherwise(F.lit(table["other"]))


def ocr_intent_fallback(df: DataFrame) -> DataFrame:
    """Keyword priority humour -> commercial -> educational -> general, with role, meaning and confidence."""
    raw = T.strip(F.coalesce(F.nullif(T.text("ocr_text"), F.lit("")), F.col("ocr_first_result") if "ocr_first_result" in df.columns else F.lit("")))
    base = df.withColumn("ocr_corrected_text", T.clean(raw))
    joined = T.corpus_text("title", "description", "transcript_text", "ocr_corrected_text")
    index = TermIndex({"h": fv.SCREEN_HUMOR_TERMS, "c": fv.SCREEN_COMMERCIAL_TERMS, "e": fv.SCREEN_EDU_TERMS})
    base = base.withColumn("_f", index.scan(joined))
    kind = (
        F.when(index.any("_f", "h") == 1, F.lit("h"))
        .when(index.any("_f", "c") == 1, F.lit("c"))
        .when(index.any("_f", "e") == 1, F.lit("e"))
        .otherwise(F.lit("g"))
    )
    base = base.withColumn("_k", kind)
    k = F.col("_k")
    intents = {"h": "humor/entretenimiento", "c": "comercial/promocional", "e": "educativo/tutorial"}
    roles = {"h": "caption_contexto_o_remate", "c": "oferta_beneficio_o_cta", "e": "apoyo_explicativo"}
    return base.withColumns(
        {
            "ocr_llm_content_intent": N.lookup(k, intents, fv.NICHE_DEFAULT),
            "ocr_llm_role": N.lookup(k, roles, "contexto_visual"),
            "ocr_llm_meaning": N.lookup(k, msg.SCREEN_MEANING, msg.SCREEN_MEANING_OTHER),
            "ocr_llm_confidence": F.when(F.col("ocr_corrected_text") != "", F.lit(0.35)).otherwise(F.lit(0.0)),
            "ocr_llm_source": F.lit("rules"),
        }
    ).drop("_f", "_k")


def feature_table(df: DataFrame, as_of, *, override_intent=None, override_role=None) -> DataFrame:
    """All inference features in projections over the video table; no shuffle."""
    have = set(df.columns)
    base = df
    for c in ("title", "description", "transcript_text", "ocr_text"):
        base = base.withColumn(c, T.text(c) if c in have else F.lit(""))
    if "ocr_frame_coverage" not in have:
        base = base.withColumn("ocr_frame_coverage", F.lit(0.0))
    kind = F.coalesce(F.col("video_type"), F.lit("auto")) if "video_type" in have else F.lit("auto")
    d = N.safe_float("duration_seconds")
    base = base.withColumn("text_total", T.text_total("title", "description", "transcript_text", "ocr_text"))
    base = base.withColumns(
        {
            "category_id": F.coalesce(F.nullif(F.col("category_id").cast("string"), F.lit("")), F.lit("unknown")),
            "duration_seconds": d,
            "duration_fit_score": N.duration_fit(d),
            "duration_bucket": N.duration_bucket(d),
            "video_type": F.when(
                kind == "auto",
                F.when((d != 0) & (d <= 8), F.lit("sin narrador")).otherwise(F.lit("con narrador/desconocido")),
            ).otherwise(kind),
            "title_len": F.length("title"),
            "description_len": F.length("description"),
            "transcript_len": F.length("transcript_text"),
            "ocr_text_len": F.length("ocr_text"),
            "title_word_count": T.word_count("title"),
            "description_word_count": T.word_count("description"),
            "transcript_word_count": T.word_count("transcript_text"),
            "ocr_word_count": T.word_count("ocr_text"),
            "text_total_word_count": T.word_count("text_total"),
            "uppercase_ratio": T.uppercase_ratio("text_total"),
        }
        | T.char_counts("text_total")
        | N.engagement("views", "likes", "comments", "published_at", as_of)
    )
    flagged = lexicon_flags(base)
    flags = {k: F.col(f"{k}_flag") for k in SIGNALS}
    scored = flagged.withColumn(
        "text_power_score", text_power(flags, F.col("text_total_word_count"), "ocr_frame_coverage")
    )
    return ocr_relevance(scored, override_intent=override_intent, override_role=override_role)


def notebook_features(df: DataFrame, published="published_at") -> DataFrame:
    """Densities, ratios and whole-word pattern flags of the advertisement table."""
    from reelscope.functions.temporal import calendar_parts

    low = F.lower(T.text("text"))
    parts = calendar_parts(published)
    return df.withColumns(
        {
            "duration_bucket": N.notebook_duration_bucket("duration_seconds"),
            "pub_hour": parts["pub_hour"],
            "is_weekend": parts["is_weekend"],
            "word_density": F.col("text_len") / F.greatest(F.col("duration_seconds").cast("double"), F.lit(1.0)),
            "question_ratio": F.col("question_count") / F.greatest(F.col("title_word_count").cast("double"), F.lit(1.0)),
            "emotional_score": N.clip(F.col("exclamation_count") * 0.5 + F.col("uppercase_ratio") * 0.5, 0.0, 1.0),
            "value_proposition_flag": whole_word(low, fv.NOTEBOOK_VALUE_WORDS),
            "promotional_flag": whole_word(low, fv.NOTEBOOK_PROMO_WORDS),
        }
    )


def whole_word(low, terms) -> Column:
    """0/1: one of the terms occurs between non-word characters (Unicode)."""
    inner = "|".join(terms)
    return low.rlike(r"(?:^|[^\p{L}\p{N}_])(?:" + inner + r")(?:$|[^\p{L}\p{N}_])").cast("int")


def prepub_features(df: DataFrame, mode: str = "prepublicacion") -> DataFrame:
    """Notebook features for an item that may not be published yet; later counts are zeroed before publication."""
    title, description = T.text("title"), T.text("description")
    post = mode == "postpublicacion"
    base = df.withColumn("text", T.strip(F.concat_ws(" ", title, description)))
    low = F.lower("text")
    upper = F.regexp_count(title, F.lit(r"\p{Lu}")) / F.greatest(F.length(title), F.lit(1))
    marks = F.regexp_count("text", F.lit("!"))
    plain_value = tuple(w for w in fv.NOTEBOOK_VALUE_WORDS if w != "garantía")
    plain_promo = tuple(w for w in fv.NOTEBOOK_PROMO_WORDS if w not in ("últimas", "último"))
    views = N.safe_float("views") if post else F.lit(0.0)
    return base.withColumns(
        {
            "modo": F.lit(mode),
            "duration_minutes": N.safe_float("duration_seconds") / 60,
            "title_len": F.length(title),
            "desc_len": F.length(description),
            "text_len": F.length("text"),
            "title_word_count": T.token_count(title),
            "desc_word_count": T.token_count(description),
            "exclamation_count": marks,
            "question_count": F.regexp_count("text", F.lit(r"\?")),
            "digit_count": F.regexp_count("text", F.lit(r"\p{Nd}")),
            "uppercase_ratio": upper,
            "viewCount": views,
            "log_viewCount": F.log1p(views),
            "exhibitions": N.safe_float("exhibitions", 1.0) if post and "exhibitions" in df.columns else F.lit(1.0),
            "emotional_score": F.least(marks * 0.5 + upper * 0.5, F.lit(1.0)),
            "cta_flag": whole_word(low, fv.NOTEBOOK_CTA_WORDS),
            "trust_flag": whole_word(low, fv.NOTEBOOK_TRUST_WORDS),
            "value_proposition_flag": whole_word(low, plain_value),
            "promotional_flag": whole_word(low, plain_promo),
        }
    )
