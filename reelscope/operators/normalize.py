"""Corpus normalisation: aliases, defaults, typed blocks, validation and small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions import text as T
from reelscope.functions.numeric import col, lookup, safe_float


def rename_aliases(df: DataFrame, aliases=fv.COLUMN_ALIASES) -> DataFrame:
    """Ordered alias -> canonical renames; an alias is ignored once its canonical name exists."""
    present, renames = set(df.columns), {}
    for alias, canonical in aliases:
        if alias in present and canonical not in present:
            renames[alias] = canonical
            present = (present - {alias}) | {canonical}
    return df.withColumnsRenamed(renames)


def fill_defaults(df: DataFrame) -> DataFrame:
    """Canonical columns exist and are non-null: text "", counts 0, category "unknown", duration 0."""
    have = set(df.columns)

    def number(name):
        return safe_float(name) if name in have else F.lit(0.0)

    out = {c: T.text(c) if c in have else F.lit("") for c in ("title", "description", "tags")}
    out |= {c: number(c) for c in ("views", "likes", "comments", "duration_seconds")}
    out["published_at"] = F.col("published_at") if "published_at" in have else F.lit(None).cast("string")
    out["category_id"] = (
        F.coalesce(F.col("category_id").cast("string"), F.lit("unknown")) if "category_id" in have else F.lit("unknown")
    )
    return df.withColumns(out)


def ensure_columns(
    df: DataFrame, text=(fv.TEXT_FEATURE,), numeric=fv.NUMERIC_FEATURES, categorical=fv.CATEGORICAL_FEATURES
) -> DataFrame:
    """Model columns that are absent are added with typed defaults; present ones are coerced."""
    have = set(df.columns)
    out = {c: T.text(c) if c in have else F.lit("") for c in text}
    out |= {c: safe_float(c) if c in have else F.lit(0.0) for c in numeric}
    for c in categorical:
        value = F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) if c in have else F.lit(None)
        out[c] = F.coalesce(value, F.lit("unknown"))
    return df.withColumns(out)


def drop_unlabelled(df: DataFrame, target: str = fv.TARGET) -> DataFrame:
    return df.dropna(subset=[target])


def dataset_check(df: DataFrame, target: str = fv.TARGET) -> DataFrame:
    """One row: number of rows and of target classes."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(target).alias("classes"))


def validate_dataset(df: DataFrame, target: str = fv.TARGET, min_rows: int = 30) -> DataFrame:
    """Raise unless the table is large enough and has at least two target classes."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is missing")
    row = dataset_check(df, target).first()
    if row["rows"] < min_rows:
        raise ValueError(f"{row['rows']} rows, at least {min_rows} are needed")
    if row["classes"] < 2:
        raise ValueError(f"target {target!r} has a single class")
    return df


def project_features(df: DataFrame, keep=(), leaking=fv.LEAKING_COLUMNS) -> DataFrame:
    """Text, numeric and categorical model inputs only; label ingredients may not pass."""
    columns = [*keep, fv.TEXT_FEATURE, *fv.NUMERIC_FEATURES, *fv.CATEGORICAL_FEATURES]
    leaked = [c for c in columns if c in leaking]
    if leaked:
        raise ValueError(f"label ingredients among the features: {leaked}")
    return df.select(*columns)


def _number(name, digits) -> Column:
    return F.round(safe_float(name), digits).alias(name)


def _integer(name, alias=None) -> Column:
    return safe_float(name).cast("bigint").alias(alias or name)


def metrics_block(df: DataFrame, name: str = "metricas") -> DataFrame:
    """Typed and rounded public subset of the features."""
    block = F.struct(
        *[_integer(c) for c in ("views", "likes", "comments")],
        *[_number(c, 6) for c in ("engagement_rate", "like_rate", "comment_rate")],
        _number("views_per_day", 4),
        _number("duration_seconds", 2),
        *[_number(c, 4) for c in ("duration_fit_score", "text_power_score", "ocr_relevance_score")],
        *[_integer(c) for c in (
            "title_word_count", "description_word_count", "transcript_word_count", "ocr_word_count")],
        _number("ocr_frame_coverage", 4),
        F.coalesce("visual_text_density", F.lit("no_disponible")).alias("visual_text_density"),
        F.coalesce("video_type", F.lit("auto")).alias("video_type"),
        F.coalesce("content_intent", F.lit(fv.NICHE_DEFAULT)).alias("content_intent"),
    )
    return df.withColumn(name, block)


def _preview(value: Column, n: int = 900) -> Column:
    return F.when(F.length(value) > n, F.concat(F.substring(value, 1, n), F.lit("..."))).otherwise(value)


def _flag(name) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def transcript_block(df: DataFrame, name: str = "analisis_transcripcion", source=None, warning=None) -> DataFrame:
    t = T.text("transcript_text")
    block = F.struct(
        (T.strip(t) != "").alias("disponible"),
        (source if source is not None else F.lit("manual_o_no_ejecutado")).alias("fuente"),
        (warning if warning is not None else F.lit("")).alias("advertencia"),
        F.length(t).alias("longitud_caracteres"),
        T.word_count(t).alias("cantidad_palabras"),
        _flag("cta_flag").alias("tiene_cta"),
        _flag("benefit_flag").alias("tiene_beneficio"),
        _flag("urgency_flag").alias("tiene_urgencia"),
        _flag("trust_flag").alias("tiene_confianza"),
        F.coalesce("content_intent", F.lit(fv.NICHE_DEFAULT)).alias("tipo_contenido_estimado"),
        _preview(t).alias("preview"),
    )
    return df.withColumn(name, block)


def ocr_block(df: DataFrame, name: str = "analisis_ocr") -> DataFrame:
    """On-screen-text summary; columns produced by the roll-up and by the interpretation step."""
    have = set(df.columns)

    def opt(c, default=""):
        return F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)

    def number(c, digits=4, scale=1):
        return F.round((safe_float(c) if c in have else F.lit(0.0)) * scale, digits)

    def integer(c):
        return (safe_float(c) if c in have else F.lit(0.0)).cast("bigint")

    def flag(c):
        return _flag(c) if c in have else F.lit(False)

    t = T.text("ocr_text")
    intent = F.when(opt("ocr_llm_content_intent") != "", opt("ocr_llm_content_intent")).otherwise(
        opt("content_intent", fv.NICHE_DEFAULT)
    )
    role = F.when(opt("ocr_llm_role") != "", opt("ocr_llm_role")).otherwise(opt("ocr_role", "sin_funcion_clara"))
    fields = {
        "disponible": T.strip(t) != "",
        "motor": opt("ocr_engine", "no_disponible"),
        "advertencia": opt("ocr_warning"),
        "frames_con_texto": integer("ocr_frames_with_text"),
        "frames_totales": integer("ocr_frame_count"),
        "cobertura": number("ocr_frame_coverage"),
        "cantidad_palabras": integer("ocr_word_count"),
        "densidad": opt("visual_text_density", "sin_texto"),
        "relevancia_texto_en_pantalla": number("ocr_relevance_score"),
        "relevancia_pct": number("ocr_relevance_score", 1, 100),
        "tiene_cta": flag("ocr_cta_flag"),
        "tiene_promocion": flag("ocr_promo_flag"),
        "tiene_urgencia": flag("ocr_urgency_flag"),
        "tiene_confianza": flag("ocr_trust_flag"),
        "tiene_exceso_texto": opt("visual_text_density") == "alta",
        "tipo_contenido_estimado": intent,
        "rol_texto_en_pantalla": role,
        "ocr_text_raw": opt("ocr_text_raw"),
        "ocr_first_result": opt("ocr_first_result"),
        "ocr_llm_source": opt("ocr_llm_source"),
        "ocr_llm_warning": opt("ocr_llm_warning"),
        "ocr_llm_meaning": opt("ocr_llm_meaning"),
        "ocr_llm_confidence": number("ocr_llm_confidence"),
        "ocr_llm_content_intent": opt("ocr_llm_content_intent"),
        "ocr_llm_role": opt("ocr_llm_role"),
        "overlap_contextual": number("ocr_context_overlap"),
        "senal_comercial": number("ocr_marketing_signal"),
        "senal_humor": number("ocr_humor_signal"),
        "interpretacion_ocr": opt("ocr_interpretation"),
        "preview": _preview(t),
    }
    return df.withColumn(name, F.struct(*[v.alias(k) for k, v in fields.items()]))


def manual_over_api(df: DataFrame, fields: dict) -> DataFrame:
    """Field by field: non-blank (text) or non-zero (number) manual value, else API value, else default.

    ``fields`` maps an output name to ``(manual column, api column, default)``;
    the type of the default decides between the text and the numeric rule.
    """
    out = {}
    for name, (manual, api, default) in fields.items():
        if isinstance(default, str):
            own = F.nullif(T.strip(manual), F.lit(""))
            other = F.nullif(F.col(api).cast("string"), F.lit(""))
        else:
            own = F.nullif(safe_float(manual), F.lit(0.0))
            other = safe_float(api, default)
        out[name] = F.coalesce(own, other, F.lit(default))
    return df.withColumns(out)


def category_map(value) -> Column:
    """Normalised advertising category; automatic, blank and unknown values become null."""
    raw = F.lower(T.strip(value))
    named = lookup(raw, fv.NICHE_ALIASES, raw)
    auto = (raw == "") | raw.isin(*fv.NICHE_AUTO_VALUES)
    return F.when(~auto & named.isin(*fv.NICHE_BASE_CPM), named)


def resolve_transcript(
    df: DataFrame, *, has_media="has_media", asr_text="asr_text", asr_ok="asr_ok", manual="manual_transcript",
    min_words: int = 8,
) -> DataFrame:
    """Media present: recognised speech if good enough, never manual text; no media: manual text or missing."""
    speech, own = T.strip(asr_text), T.strip(manual)
    n_speech, n_own = T.token_count(speech), T.token_count(own)
    media = F.coalesce(col(has_media), F.lit(False))
    good = media & F.coalesce(col(asr_ok), F.lit(False)) & (n_speech >= min_words)
    manual_ok = ~media & (own != "")
    source = (
        F.when(good, F.lit("automatic"))
        .when(media, F.lit("failed"))
        .when(manual_ok, F.lit("manual"))
        .otherwise(F.lit("missing"))
    )
    return df.withColumns(
        {
            "transcript_text": F.when(good, speech).when(manual_ok, own).otherwise(F.lit("")),
            "transcript_source": source,
            "transcript_ok": good | manual_ok,
            "requires_human_review": ~(good | manual_ok),
            "resolved_word_count": F.when(media, n_speech).when(manual_ok, n_own).otherwise(F.lit(0)),
        }
    )
