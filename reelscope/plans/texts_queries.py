"""Queries over intent, on-screen text, policy, sentiment and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.operators import features as X
from reelscope.operators import messages as msg
from reelscope.operators import policy as P
from reelscope.operators import scripts as Q
from reelscope.operators import sentiment as M
from reelscope.plans import sqltext as s
from reelscope.plans import views as V
from reelscope.plans.registry import joined, query, r6
from reelscope.plans.scalars_queries import (
    SENTIMENT_CLEAN_SQL,
    content_tokens_sql,
    mean_len_sql,
    relevance_tokens_sql,
    with_videos,
)
from reelscope.plans.tables_queries import LENGTH_BONUS, POWER_CORE
from reelscope.session import table

ALL_TEXT = "title || ' ' || description || ' ' || transcript_text || ' ' || ocr_text"


def intent_sql(body: str) -> str:
    com = (
        f"({s.hits(body, fv.LIGHT_COMMERCIAL_TERMS)} + {s.flag(body, fv.CTA_TERMS)} + {s.flag(body, fv.PROMO_TERMS)} + {s.flag(body, fv.PRICE_TERMS)})"
    )
    return f"""CASE WHEN {s.hits(body, fv.LIGHT_MUSIC_TERMS)} >= 1 AND {com} < 3 THEN 'musical'
      WHEN {s.hits(body, fv.LIGHT_HUMOR_TERMS)} >= 1 AND {com} < 3 THEN 'humor/entretenimiento'
      WHEN {com} >= 3 THEN 'comercial/promocional' WHEN {s.hits(body, fv.LIGHT_EDU_TERMS)} >= 2 THEN 'educativo/tutorial'
      WHEN {s.hits(body, fv.LIGHT_NEWS_TERMS)} >= 1 THEN 'informativo/noticioso' ELSE 'general/branding' END"""


@query("content_intent", with_videos(f"SELECT video_id, {intent_sql('body')} AS content_intent FROM (SELECT video_id, {ALL_TEXT} AS body FROM videos)"))
def content_intent(spark, sf):
    v = V.videos(spark, sf).withColumn("f", X.intent_scan("title", "description", "transcript_text", "ocr_text"))
    return v.select("video_id", X.content_intent("f").alias("content_intent"))


MARKET = " + ".join(
    s.flag("ocr_text", t)
    for t in (fv.CTA_TERMS, fv.BENEFIT_TERMS, fv.URGENCY_TERMS, fv.TRUST_TERMS, fv.PROMO_TERMS, fv.PRICE_TERMS, fv.LIGHT_COMMERCIAL_TERMS)
)
SCREEN_SQL = f"""screen0 AS MATERIALIZED (SELECT *, {intent_sql('body')} AS content_intent, {relevance_tokens_sql('ocr_text')} AS a,
    {relevance_tokens_sql("title || ' ' || description || ' ' || transcript_text")} AS b, {s.words_n('ocr_text')} AS ow,
    ({MARKET}) / 7.0::DOUBLE AS m, least({s.hits('ocr_text', fv.LIGHT_HUMOR_TERMS)} / 2.0::DOUBLE, 1.0::DOUBLE) AS h,
    least({s.hits('ocr_text', fv.LIGHT_EDU_TERMS)} / 2.0::DOUBLE, 1.0::DOUBLE) AS ed
  FROM (SELECT *, {ALL_TEXT} AS body FROM videos)),
screen1 AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0.0::DOUBLE END AS o,
    CASE WHEN ow BETWEEN 2 AND 18 THEN 1.0 WHEN ow BETWEEN 19 AND 40 THEN 0.65 WHEN ow > 40 THEN 0.35 ELSE 0.45 END::DOUBLE AS dn FROM screen0),
screen AS MATERIALIZED (SELECT *, {s.strip('ocr_text')} = '' AS blank,
    CASE WHEN content_intent = 'musical' THEN o * 0.42::DOUBLE + dn * 0.23::DOUBLE + greatest(h, ed) * 0.1::DOUBLE
         WHEN starts_with(content_intent, 'humor') THEN o * 0.45::DOUBLE + h * 0.2::DOUBLE + dn * 0.15::DOUBLE
         WHEN starts_with(content_intent, 'educativo') THEN o * 0.45::DOUBLE + ed * 0.2::DOUBLE + dn * 0.15::DOUBLE
         WHEN starts_with(content_intent, 'comercial') THEN o * 0.38::DOUBLE + m * 0.34::DOUBLE + dn * 0.1::DOUBLE
         ELSE o * 0.5::DOUBLE + dn * 0.2::DOUBLE + greatest(m, h, ed) * 0.1::DOUBLE END AS raw_score FROM screen1)"""
ROLE_SQL = """CASE WHEN blank THEN 'sin_texto_detectado'
  WHEN content_intent = 'musical' THEN CASE WHEN o >= 0.15 THEN 'letra_musical_o_rotulo' ELSE 'texto_musical_poco_conectado' END
  WHEN starts_with(content_intent, 'humor') THEN CASE WHEN h > 0 OR o >= 0.25 THEN 'apoya_contexto_o_remate' ELSE 'texto_desconectado_del_chiste' END
  WHEN starts_with(content_intent, 'comercial') THEN CASE WHEN m >= 0.34 THEN 'refuerza_oferta_cta_o_beneficio'
       WHEN o >= 0.25 THEN 'acompaña_mensaje_comercial' ELSE 'texto_comercial_poco_claro' END
  WHEN starts_with(content_intent, 'educativo') THEN CASE WHEN o >= 0.2 THEN 'apoyo_explicativo' ELSE 'texto_explicativo_poco_conectado' END
  ELSE CASE WHEN o >= 0.2 THEN 'contexto_visual' ELSE 'texto_visible_sin_funcion_clara' END END"""


@query(
    "ocr_relevance",
    f"""WITH {V.VIDEOS_SQL}, {SCREEN_SQL} SELECT video_id, content_intent, round(o, 4) AS ocr_context_overlap, round(m, 4) AS ocr_marketing_signal,
        round(h, 4) AS ocr_humor_signal, CASE WHEN blank THEN 0.0 ELSE round({s.clip('raw_score', 0, 1)}, 4) END AS ocr_relevance_score FROM screen""",
)
def ocr_relevance(spark, sf):
    return X.ocr_relevance(V.videos(spark, sf)).select(
        "video_id", "content_intent", "ocr_context_overlap", "ocr_marketing_signal", "ocr_humor_signal", "ocr_relevance_score"
    )


@query("ocr_role", f"WITH {V.VIDEOS_SQL}, {SCREEN_SQL} SELECT video_id, {ROLE_SQL} AS ocr_role FROM screen")
def ocr_role(spark, sf):
    return X.ocr_relevance(V.videos(spark, sf)).select("video_id", "ocr_role")


@query(
    "ocr_intent_fallback",
    with_videos(f"""SELECT video_id, CASE WHEN h > 0 THEN 'humor/entretenimiento' WHEN c > 0 THEN 'comercial/promocional' WHEN e > 0 THEN 'educativo/tutorial' ELSE 'general/branding' END AS intent,
      CASE WHEN h > 0 THEN 'caption_contexto_o_remate' WHEN c > 0 THEN 'oferta_beneficio_o_cta' WHEN e > 0 THEN 'apoyo_explicativo' ELSE 'contexto_visual' END AS role,
      CASE WHEN clean_text <> '' THEN 0.35 ELSE 0.0 END::DOUBLE AS confidence FROM (
      SELECT *, {s.hits('body', fv.SCREEN_HUMOR_TERMS)} AS h, {s.hits('body', fv.SCREEN_COMMERCIAL_TERMS)} AS c, {s.hits('body', fv.SCREEN_EDU_TERMS)} AS e
      FROM (SELECT video_id, {s.clean('ocr_text')} AS clean_text, title || ' ' || description || ' ' || transcript_text || ' ' || {s.clean('ocr_text')} AS body FROM videos))"""),
)
def ocr_fallback(spark, sf):
    return X.ocr_intent_fallback(V.videos(spark, sf)).select(
        "video_id", F.col("ocr_llm_content_intent").alias("intent"), F.col("ocr_llm_role").alias("role"),
        F.col("ocr_llm_confidence").alias("confidence"),
    )


@query(
    "text_power",
    with_videos(
        f"SELECT video_id, round(least(CAST({POWER_CORE} + {LENGTH_BONUS.format(w='w')} + 0.07 AS DOUBLE), 1.0), 4) AS text_power_score FROM (SELECT video_id, "
        f"{s.words_n('body')} AS w, " + ", ".join(f"{s.flag('body', t)} AS {k}_flag" for k, t in X.SIGNALS.items())
        + f" FROM (SELECT video_id, {s.strip(ALL_TEXT)} AS body FROM videos))"
    ),
)
def text_power(spark, sf):
    from reelscope.functions import text as T

    v = V.videos(spark, sf).withColumn("text_total", T.text_total("title", "description", "transcript_text", "ocr_text"))
    flagged = X.lexicon_flags(v)
    score = X.text_power({k: F.col(f"{k}_flag") for k in X.SIGNALS}, T.word_count("text_total"), F.lit(0.5))
    return flagged.select("video_id", score.alias("text_power_score"))


FEATURE_FLAGS = ", ".join(f"{s.flag('text_total', t)} AS {k}_flag" for k, t in X.SIGNALS.items())


@query(
    "feature_table",
    with_videos(f"""SELECT video_id, md5(text_total) AS text_total, CAST(length(text_total) AS INTEGER) AS text_total_len,
      CAST({s.words_n('text_total')} AS INTEGER) AS text_total_word_count, CAST({s.words_n('title')} AS INTEGER) AS title_word_count,
      CAST({s.words_n('ocr_text')} AS INTEGER) AS ocr_word_count, {FEATURE_FLAGS},
      CASE WHEN duration_seconds <> 0 AND duration_seconds <= 8 THEN 'sin narrador' ELSE 'con narrador/desconocido' END AS video_type,
      CASE WHEN duration_seconds <= 15 THEN 'short' WHEN duration_seconds <= 60 THEN 'medium' ELSE 'long' END AS duration_bucket,
      round(likes / greatest(views, 1.0), 6) AS like_rate
      FROM (SELECT *, {s.strip(ALL_TEXT)} AS text_total FROM videos)"""),
)
def feature_table(spark, sf):
    out = X.feature_table(V.videos(spark, sf), V.AS_OF)
    return out.select(
        "video_id", F.md5("text_total").alias("text_total"), "text_total_len", "text_total_word_count", "title_word_count",
        "ocr_word_count", *[f"{k}_flag" for k in X.SIGNALS], "video_type", "duration_bucket", "like_rate",
    )


@query(
    "prepub_features",
    with_videos(f"""SELECT video_id, CAST({s.tokens_n('title')} AS INTEGER) AS title_word_count, 0.0::DOUBLE AS viewCount, 1.0::DOUBLE AS exhibitions,
      {s.r6(f"least((length(body) - length(replace(body, '!', ''))) * 0.5::DOUBLE + {s.n_match('title', r'\p{Lu}')}::DOUBLE / greatest(length(title), 1) * 0.5::DOUBLE, 1.0::DOUBLE)")} AS emotional_score,
      CAST(regexp_matches(lower(body), {s.q('(?:^|[^\\p{L}\\p{N}_])(?:' + '|'.join(fv.NOTEBOOK_CTA_WORDS) + ')(?:$|[^\\p{L}\\p{N}_])')}) AS INTEGER) AS cta_flag,
      CAST(regexp_matches(lower(body), {s.q('(?:^|[^\\p{L}\\p{N}_])(?:' + '|'.join(fv.NOTEBOOK_TRUST_WORDS) + ')(?:$|[^\\p{L}\\p{N}_])')}) AS INTEGER) AS trust_flag
      FROM (SELECT *, {s.strip("title || ' ' || description")} AS body FROM videos)"""),
)
def prepub(spark, sf):
    out = X.prepub_features(V.videos(spark, sf))
    return out.select("video_id", "title_word_count", "viewCount", "exhibitions", r6("emotional_score", "emotional_score"), "cta_flag", "trust_flag")


# --- policy ---------------------------------------------------------------------

POLICY_TEXT = "trim(regexp_replace(regexp_replace(lower({t}), '[^\\p{L}\\p{N}_+" + s.SPACE + "]', ' ', 'g'), '[" + s.SPACE + "]+', ' ', 'g'))"
LEXICON_VALUES = ", ".join(f"({s.q(c)}, {s.q(t)})" for c, terms in fv.POLICY_TERMS.items() for t in dict.fromkeys(terms))
# Policy terms are rare in invented prose; the driver's own source names serve as extra entries.
EXTRA = {"drogas": ("and the", "de la"), "armas": ("und", "les "), "clickbait": ("ing the", "ion de"), "apuestas": ("er the",), "violencia": ("que la",)}
LEXICON = {c: tuple(t) + EXTRA.get(c, ()) for c, t in fv.POLICY_TERMS.items()}
LEX_SQL = "lex(category, term) AS (VALUES " + ", ".join(f"({s.q(c)}, {s.q(t.lower())})" for c, terms in LEXICON.items() for t in dict.fromkeys(terms)) + ")"
HITS_SQL = f"""docs AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS video_id, {POLICY_TEXT.replace('{t}', 'text')} AS body FROM documents), {LEX_SQL},
hits AS MATERIALIZED (SELECT video_id, category, term FROM docs JOIN lex ON contains(body, term))"""


def policy_hits(spark, sf):
    d = V.documents(spark, sf).select(F.col("doc_id").cast("string").alias("video_id"), P.normalize_policy_text("text").alias("body"))
    return d, P.lexicon_match(d, "video_id", "body", LEXICON)


@query("lexicon_match", f"WITH {HITS_SQL} SELECT * FROM hits")
def lexicon_match(spark, sf):
    return policy_hits(spark, sf)[1]


PHRASES = "[a-z]+ [a-z]+"


@query(
    "lexicon_match_table",
    f"""WITH docs AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS video_id, {POLICY_TEXT.replace('{t}', 'text')} AS body FROM documents),
    lex AS MATERIALIZED (SELECT DISTINCT CAST(item_id AS VARCHAR) AS category, unnest(regexp_extract_all(lower(text), '{PHRASES}')) AS term FROM benchmark)
    SELECT video_id, category, term FROM docs JOIN lex ON contains(body, term)""",
)
def lexicon_match_table(spark, sf):
    """The lexicon is a table: the two-word phrases of the test items."""
    d = V.documents(spark, sf).select(F.col("doc_id").cast("string").alias("video_id"), P.normalize_policy_text("text").alias("body"))
    phrases = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(PHRASES), F.lit(0))).alias("term")
    return P.lexicon_match(d, "video_id", "body", table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("category"), phrases))


@query("docs_without_hits", f"WITH {HITS_SQL} SELECT video_id FROM docs WHERE video_id NOT IN (SELECT video_id FROM hits)")
def without_hits(spark, sf):
    d, hits = policy_hits(spark, sf)
    return P.docs_without_hits(d, hits, "video_id").select("video_id")


SEVERITY = s.case("category", fv.POLICY_SEVERITY, "'medio'")
LABELS = s.case("category", fv.POLICY_LABELS, "category")


@query("severity_lookup", f"WITH {HITS_SQL} SELECT {SEVERITY} AS severity, {LABELS} AS label, count(*) AS n FROM hits GROUP BY 1, 2")
def severity(spark, sf):
    return P.severity_lookup(policy_hits(spark, sf)[1]).groupBy("severity", "label").agg(F.count("*").alias("n"))


LEVEL_SQL = "CASE WHEN nc = 0 THEN 'bajo' WHEN nh >= 3 THEN 'revisión humana' WHEN nh >= 1 THEN 'alto' ELSE 'medio' END"
STATUS_SQL = "CASE {l} WHEN 'bajo' THEN 'apto' WHEN 'medio' THEN 'apto limitado' WHEN 'alto' THEN 'no apto' ELSE 'revisión humana' END"
ROLL_SQL = f"""roll AS MATERIALIZED (SELECT d.video_id, count(DISTINCT h.category) AS nc,
  count(DISTINCT CASE WHEN {SEVERITY.replace('CASE category', 'CASE h.category')} = 'alto' THEN h.category END) AS nh,
  coalesce(array_to_string(list_sort(list(DISTINCT {LABELS.replace('CASE category', 'CASE h.category').replace('ELSE category', 'ELSE h.category')}) FILTER (h.category IS NOT NULL)), ' | '), '') AS categories,
  count(h.term) AS terms FROM docs d LEFT JOIN hits h ON d.video_id = h.video_id GROUP BY 1)"""


@query(
    "policy_rollup",
    f"WITH {HITS_SQL}, {ROLL_SQL} SELECT video_id, categories, nh AS n_high, {LEVEL_SQL} AS level, {STATUS_SQL.format(l='(' + LEVEL_SQL + ')')} AS status FROM roll WHERE nc > 0",
)
def policy_rollup(spark, sf):
    out = P.policy_rollup(policy_hits(spark, sf)[1], "video_id")
    return out.select(
        "video_id", joined("categories", "categories"), "n_high", F.col("policy_risk_level").alias("level"),
        F.col("youtube_ad_status_estimate").alias("status"),
    )


@query(
    "policy_risk",
    f"""WITH {HITS_SQL}, {ROLL_SQL} SELECT r.video_id, {LEVEL_SQL} AS level, {STATUS_SQL.format(l='(' + LEVEL_SQL + ')')} AS status, categories, CAST(terms AS INTEGER) AS terms,
        lang = 'de' OR {s.strip('text')} = '' AS partial,
        CASE WHEN {s.strip('text')} = '' THEN 'ninguna' WHEN lang <> 'de' THEN 'completa' ELSE 'parcial_sin_transcripcion' END AS coverage
        FROM roll r JOIN documents d ON r.video_id = CAST(d.doc_id AS VARCHAR)""",
)
def policy_risk(spark, sf):
    d = V.documents(spark, sf).select(F.col("doc_id").cast("string").alias("video_id"), "text", (F.col("lang") != "de").alias("spoken"))
    out = P.policy_risk(d, "text", "spoken", lexicon=LEXICON)
    terms = F.aggregate(F.map_values("policy.hits"), F.lit(0), lambda a, x: a + F.size(x))
    return out.select(
        "video_id", F.col("policy.policy_risk_level").alias("level"), F.col("policy.youtube_ad_status_estimate").alias("status"),
        F.array_join(F.array_sort("policy.policy_risk_categories"), " | ").alias("categories"), terms.alias("terms"),
        F.col("policy.partial_evaluation").alias("partial"), F.col("policy.evaluation_coverage").alias("coverage"),
    )


@query("policy_risk_default_terms")
def policy_default(spark, sf):
    v = V.videos(spark, sf).withColumn("body", F.concat_ws(" ", "title", "description", "transcript_text"))
    out = P.policy_risk(v, "body", F.col("transcript_text") != "")
    return out.groupBy(F.col("policy.policy_risk_level").alias("level"), F.col("policy.evaluation_coverage").alias("coverage")).agg(F.count("*").alias("n"))


@query("human_review_block", f"SELECT doc_id, 'revisión humana' AS level, {s.q(msg.POLICY_NOT_EVALUATED)} AS explanation FROM documents")
def human_review(spark, sf):
    d = V.documents(spark, sf).withColumn("b", P.human_review_block())
    return d.select("doc_id", F.col("b.policy_risk_level").alias("level"), F.col("b.policy_explanation").alias("explanation"))


# --- sentiment ------------------------------------------------------------------

# Extra syllables of the invented prose, so that every branch of the score is reached.
NEG = s.lst(fv.SENTIMENT_NEGATORS)
POS = s.lst(fv.SENTIMENT_POSITIVE_TERMS)
SENT_SQL = f"""{V.COMMENTS_SQL},
written AS (SELECT * FROM comments WHERE {s.strip('text')} <> ''),
c0 AS MATERIALIZED (SELECT video_id, position, text, {SENTIMENT_CLEAN_SQL} AS c FROM written),
c1 AS MATERIALIZED (SELECT *, string_split(c, ' ') AS w FROM c0),
c2 AS MATERIALIZED (SELECT *, {s.hits('c', fv.SENTIMENT_POSITIVE_TERMS)} AS p, {s.hits('c', fv.SENTIMENT_NEGATIVE_TERMS)} AS n,
  len(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_contains({NEG}, z[1]) AND len(list_filter({POS},
      lambda q: contains(array_to_string(list_slice(w, z[2] + 1, z[2] + 4), ' '), q))) > 0)) AS k,
  len(list_filter(w, lambda z: list_contains({s.lst(fv.SENTIMENT_INTENSIFIERS)}, z))) AS i FROM c1),
c3 AS (SELECT *, CASE WHEN c = '' THEN 0.0::DOUBLE ELSE {s.clip("(greatest(p - k, 0) - (n + k)) * (1.0::DOUBLE + 0.3::DOUBLE * i) / greatest(greatest(p - k, 0) + n + k, 1)", -1, 1)} END AS raw FROM c2),
scored_comments AS MATERIALIZED (SELECT video_id, position, text, raw, round(raw, 3) AS score,
  CASE WHEN raw > 0.2 THEN 'positivo' WHEN raw < -0.2 THEN 'negativo' ELSE 'neutro' END AS label, substr({s.strip('text')}, 1, 500) AS text500 FROM c3)"""


def scored_comments(spark, sf):
    return M.score_comments(M.written_comments(V.comments(spark, sf)))


@query("cap_comments", f"WITH {V.COMMENTS_SQL} SELECT video_id, position FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY position) AS rn FROM comments) WHERE rn <= 2")
def cap(spark, sf):
    return M.cap_comments(V.comments(spark, sf), 2).select("video_id", "position")


@query("comment_score", f"WITH {SENT_SQL} SELECT video_id, position, {s.r6('raw')} AS raw, score, label, md5(text500) AS text500 FROM scored_comments")
def comment_score(spark, sf):
    return scored_comments(spark, sf).select("video_id", "position", r6("score_raw", "raw"), "score", "label", F.md5("text500").alias("text500"))


@query(
    "sentiment_summary",
    f"""WITH {SENT_SQL}, g AS (SELECT video_id, count(*) AS total, count(*) FILTER (label = 'positivo') AS positivos, count(*) FILTER (label = 'neutro') AS neutros,
        count(*) FILTER (label = 'negativo') AS negativos, sum(CAST(round(score * 1000) AS BIGINT)) / 1000.0::DOUBLE AS sm FROM scored_comments GROUP BY 1)
        SELECT video_id, total, positivos, neutros, negativos, round(positivos::DOUBLE / total * 100, 1) AS pct_positivo,
        round(neutros::DOUBLE / total * 100, 1) AS pct_neutro, round(negativos::DOUBLE / total * 100, 1) AS pct_negativo, round(sm / total, 3) AS score_promedio,
        CASE WHEN neutros >= greatest(positivos, negativos) THEN 'neutro' WHEN positivos >= negativos THEN 'positivo' ELSE 'negativo' END AS sentimiento_dominante FROM g""",
)
def sentiment_summary(spark, sf):
    return M.sentiment_summary(scored_comments(spark, sf)).drop("warning")


@query(
    "top_words",
    f"""WITH {SENT_SQL}, t AS (SELECT label, unnest({content_tokens_sql('text')}) AS word FROM scored_comments),
        c AS (SELECT label, word, count(*) AS n FROM t GROUP BY 1, 2)
        SELECT label, word, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 20""",
)
def top_words(spark, sf):
    return M.top_words(scored_comments(spark, sf))


@query(
    "top_n_per_label",
    f"""WITH {SENT_SQL} SELECT video_id, label, position, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, label
        ORDER BY CASE label WHEN 'positivo' THEN -score WHEN 'negativo' THEN score ELSE 0 END, position) AS rank FROM scored_comments) WHERE rank <= 3""",
)
def examples(spark, sf):
    return M.top_n_per_label(scored_comments(spark, sf)).select("video_id", "label", "position", "rank")


# --- scripts --------------------------------------------------------------------


def starts_sql(x: str, terms) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {s.q(t)})" for t in terms) + ")"


SCRIPT_SQL = f"""s0 AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS video_id, {s.clean('text')} AS t FROM documents WHERE {s.clean('text')} <> ''),
s1 AS MATERIALIZED (SELECT *, t AS text, array_to_string(list_slice(string_split(t, ' '), 1, 30), ' ') AS hook, len(string_split(t, ' ')) AS n FROM s0),
s2 AS MATERIALIZED (SELECT video_id, t, hook, n, {mean_len_sql('.!?')} AS sl, length(t) - length(replace(t, '!', '')) AS bang,
  CAST(contains(hook, '?') OR {starts_sql('lower(hook)', fv.SCRIPT_QUESTION_STARTS)} AS INTEGER) AS hq, {s.flag('hook', fv.SCRIPT_BENEFIT_TERMS)} AS hb,
  {s.flag('substr(lower(hook), 1, 160)', fv.SCRIPT_GENERIC_OPENINGS)} AS go, {s.hits('t', fv.SCRIPT_CTA_TERMS).replace('lambda t: contains(lower(t), t)', 'lambda z: contains(lower(t), z)')} AS cta,
  {s.hits('t', fv.SCRIPT_BENEFIT_TERMS).replace('lambda t: contains(lower(t), t)', 'lambda z: contains(lower(t), z)')} AS ben,
  {s.hits('t', fv.SCRIPT_URGENCY_TERMS).replace('lambda t: contains(lower(t), t)', 'lambda z: contains(lower(t), z)')} AS urg,
  {s.hits('t', fv.SCRIPT_TRUST_TERMS).replace('lambda t: contains(lower(t), t)', 'lambda z: contains(lower(t), z)')} AS tru,
  {s.hits('t', fv.SCRIPT_EXAGGERATED_TERMS).replace('lambda t: contains(lower(t), t)', 'lambda z: contains(lower(t), z)')} AS exa FROM s1),
s3 AS (SELECT *, greatest(0, least(100, 50 + 20 * hq + 25 * hb - 20 * go)) AS hook_score, least(100, 35 + least(cta, 3) * 20) AS cta_score,
  least(100, 45 + least(ben, 4) * 12 + least(tru, 2) * 8) AS value_score,
  greatest(0, 78 - CASE WHEN n < 25 THEN 15 ELSE 0 END - CASE WHEN n > 2500 THEN 12 ELSE 0 END - CASE WHEN sl > 28 THEN 15 ELSE 0 END - CASE WHEN bang > 6 THEN 6 ELSE 0 END) AS clarity_score FROM s2),
script AS MATERIALIZED (SELECT *, CAST({s.bround('round(hook_score * 0.3::DOUBLE + clarity_score * 0.25::DOUBLE + value_score * 0.25::DOUBLE + cta_score * 0.2::DOUBLE, 6)')} AS INTEGER) AS quality,
  CASE WHEN exa >= 2 THEN 'alto' WHEN exa = 1 THEN 'medio' ELSE 'bajo' END AS claim_risk FROM s3)"""


def script_features(spark, sf):
    return Q.transcript_features(V.transcripts(spark, sf))


@query(
    "script_quality",
    f"""WITH {SCRIPT_SQL} SELECT video_id, CAST(n AS INTEGER) AS words, hq, hb, go, CAST(cta AS INTEGER) AS cta, CAST(ben AS INTEGER) AS ben, CAST(urg AS INTEGER) AS urg,
        CAST(tru AS INTEGER) AS tru, CAST(exa AS INTEGER) AS exa, {s.r6('sl')} AS sentence_length, CAST(hook_score AS INTEGER) AS hook_score, CAST(cta_score AS INTEGER) AS cta_score,
        CAST(value_score AS INTEGER) AS value_score, CAST(clarity_score AS INTEGER) AS clarity_score, claim_risk, quality FROM script""",
)
def script_quality(spark, sf):
    from reelscope.functions import text as T

    out = script_features(spark, sf)
    return out.select(
        "video_id", F.col("transcript_word_count").alias("words"), F.col("hook_has_question").alias("hq"), F.col("hook_has_benefit").alias("hb"),
        F.col("generic_opening").alias("go"), F.col("cta_count").alias("cta"), F.col("benefit_count").alias("ben"), F.col("urgency_count").alias("urg"),
        F.col("trust_count").alias("tru"), F.col("exaggerated_claim_count").alias("exa"), r6(T.mean_sentence_length("transcript"), "sentence_length"),
        "hook_score", "cta_score", F.col("value_proposition_score").alias("value_score"), "clarity_score",
        F.col("policy_claim_risk").alias("claim_risk"), F.col("script_quality_score").alias("quality"),
    )


@query("transcript_features", f"WITH {SCRIPT_SQL} SELECT video_id, md5(hook) AS hook, md5(t) AS transcript, 'transcripts' AS source_dataset FROM script")
def transcript_features(spark, sf):
    return script_features(spark, sf).select(
        "video_id", F.md5("hook_first_30_words").alias("hook"), F.md5("transcript").alias("transcript"), "source_dataset"
    )


PATTERN_SQL = f"""WITH {SCRIPT_SQL}, best AS MATERIALIZED (SELECT video_id, t, hook FROM script ORDER BY quality DESC, video_id LIMIT 150),
b(term) AS (SELECT unnest({s.lst(fv.SCRIPT_BENEFIT_TERMS)})), c(term) AS (SELECT unnest({s.lst(fv.SCRIPT_CTA_TERMS)})),
counts AS (SELECT 'hook' AS kind, term, count(*) AS n FROM best JOIN b ON contains(lower(hook), term) GROUP BY 1, 2
  UNION ALL SELECT 'benefit', term, count(*) FROM best JOIN b ON contains(lower(t), term) GROUP BY 1, 2
  UNION ALL SELECT 'cta', term, count(*) FROM best JOIN c ON contains(lower(t), term) GROUP BY 1, 2)"""


@query("pattern_terms", PATTERN_SQL + " SELECT kind, term, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS rank FROM counts) WHERE rank <= 20")
def pattern_terms(spark, sf):
    return Q.pattern_terms(script_features(spark, sf), top=150)


@query(
    "pattern_reference",
    PATTERN_SQL + """ SELECT 'transcripts' AS source, (SELECT count(*) FROM script) AS n_transcripts,
      (SELECT round(avg(quality), 2) FROM script) AS quality_score_mean, (SELECT round(quantile_cont(quality, 0.75), 2) FROM script) AS quality_score_p75""",
)
def pattern_reference(spark, sf):
    return Q.pattern_reference(script_features(spark, sf), top=150).select("source", "n_transcripts", "quality_score_mean", "quality_score_p75")


FULL_TEXT = "{t} || ' ' || {d} || ' ' || {r} || ' ' || category_id || ' ' || tags".format(
    t=s.clean("title"), d=s.clean("description"), r=s.clean("transcript_text")
)


def full_intent_sql(body: str) -> str:
    com = f"({s.hits(body, fv.ANALYZER_COMMERCIAL_TERMS)} + {s.hits(body, fv.SCRIPT_BENEFIT_TERMS)} + {s.hits(body, fv.SCRIPT_CTA_TERMS)})"
    return f"""CASE WHEN {s.hits(body, fv.ANALYZER_HUMOR_TERMS)} >= 1 AND {com} < 3 THEN 'humor/entretenimiento' WHEN {com} >= 3 THEN 'comercial/promocional'
      WHEN {s.hits(body, fv.ANALYZER_EDU_TERMS)} >= 2 THEN 'educativo/tutorial' WHEN {s.hits(body, fv.ANALYZER_NEWS_TERMS)} >= 1 THEN 'informativo/noticioso'
      WHEN {s.hits(body, fv.ANALYZER_LIFESTYLE_TERMS)} >= 1 THEN 'entretenimiento/lifestyle' ELSE 'general/branding' END"""


ANALYSIS_SQL = f"""a0 AS MATERIALIZED (SELECT video_id, duration_seconds, {s.clean('title')} AS ti, {s.clean('description')} AS de, {s.clean('transcript_text')} AS tr, {FULL_TEXT} AS body FROM videos),
a1 AS MATERIALIZED (SELECT *, {s.clean("ti || ' ' || de || ' ' || tr")} AS al, {full_intent_sql('body')} AS intent,
  array_to_string(list_slice(string_split(CASE WHEN tr <> '' THEN tr WHEN ti <> '' THEN ti ELSE de END, ' '), 1, 45), ' ') AS hook,
  CASE WHEN tr = '' THEN 0 ELSE len(string_split(tr, ' ')) END AS n FROM a0),
a2 AS MATERIALIZED (SELECT *, tr AS text, {s.hits('al', fv.SCRIPT_CTA_TERMS)} AS cta, {s.hits('al', fv.SCRIPT_BENEFIT_TERMS)} AS ben, {s.hits('al', fv.SCRIPT_URGENCY_TERMS)} AS urg,
  {s.hits('al', fv.SCRIPT_TRUST_TERMS)} AS tru, {s.hits('al', fv.ANALYZER_COMMERCIAL_TERMS)} AS com, {s.hits('al', fv.ANALYZER_HUMOR_TERMS)} AS hum, {s.hits('al', fv.ANALYZER_EDU_TERMS)} AS edu,
  {s.hits('al', fv.SCRIPT_EXAGGERATED_TERMS)} AS exa, {s.hits('al', fv.ANALYZER_IRONY_TERMS)} AS irony, {s.hits('al', fv.ANALYZER_TESTIMONIAL_TERMS)} AS testi,
  {s.hits('al', fv.ANALYZER_HUMOR_FIT_CUES)} AS hcue, {s.hits('al', fv.ANALYZER_EDU_FIT_CUES)} AS ecue, {s.hits('hook', fv.ANALYZER_HOOK_HUMOR_CUES)} AS lead_cue,
  {s.hits('hook', fv.ANALYZER_HUMOR_TERMS)} AS lead_hum, {s.hits('hook', fv.ANALYZER_SITUATION_TERMS)} AS lead_sit, {s.hits('hook', fv.SCRIPT_BENEFIT_TERMS)} AS lead_ben,
  {s.hits('hook', fv.ANALYZER_COMMERCIAL_TERMS)} AS lead_com, {s.hits('substr(lower(hook), 1, 180)', fv.SCRIPT_GENERIC_OPENINGS)} AS gen,
  contains(hook, '?') OR {starts_sql('lower(hook)', fv.ANALYZER_HOOK_STARTS)} AS quest, length(al) - length(replace(al, '!', '')) AS bang,
  starts_with(intent, 'humor') AS ih, starts_with(intent, 'comercial') AS ic, starts_with(intent, 'educativo') AS ie FROM a1),
a3 AS (SELECT *, {mean_len_sql('.!?¿¡')} AS sl FROM a2),
a4 AS (SELECT *, greatest(0, least(100, 52 + CASE WHEN quest THEN 16 ELSE 0 END + CASE WHEN ih AND (hum > 0 OR lead_cue > 0) THEN 22 WHEN ic AND (ben > 0 OR com > 0) THEN 20
    WHEN ie AND edu > 0 THEN 18 ELSE 0 END - CASE WHEN gen > 0 THEN 12 ELSE 0 END - CASE WHEN n < 10 THEN 12 ELSE 0 END)) AS hs,
  greatest(0, 76 - CASE WHEN n < 12 THEN 16 WHEN n > 600 AND duration_seconds <= 60 THEN 12 ELSE 0 END - CASE WHEN sl > 24 THEN 12 ELSE 0 END - CASE WHEN bang > 9 THEN 8 ELSE 0 END) AS cs,
  least(100, 55 + CASE WHEN ih THEN CASE WHEN hum > 0 THEN 18 ELSE 6 END + CASE WHEN hcue > 0 THEN 10 ELSE 0 END + CASE WHEN n > 0 AND n <= 120 THEN 8 ELSE 0 END
    WHEN ic THEN least(com, 4) * 8 + least(ben, 3) * 6 + least(tru, 2) * 4 WHEN ie THEN least(edu, 4) * 8 + CASE WHEN ecue > 0 THEN 8 ELSE 0 END
    ELSE CASE WHEN n >= 20 THEN 10 ELSE 0 END END) AS fs,
  least(100, CASE WHEN ic THEN 35 + least(cta, 3) * 20 + least(com, 2) * 8 WHEN ih OR starts_with(intent, 'entretenimiento') THEN CASE WHEN cta = 0 THEN 68 ELSE 78 END
    ELSE 55 + least(cta, 2) * 12 END) AS ascore FROM a3),
analysis AS MATERIALIZED (SELECT *, CASE WHEN n > 0 THEN {s.bround('round(hs * 0.28::DOUBLE + cs * 0.26::DOUBLE + fs * 0.3::DOUBLE + ascore * 0.16::DOUBLE, 6)')} END AS total FROM a4)"""


def analysed(spark, sf):
    return Q.script_analysis(V.videos(spark, sf), topic="tags")


@query("content_intent_full", f"WITH {V.VIDEOS_SQL}, {ANALYSIS_SQL} SELECT video_id, intent FROM analysis")
def content_intent_full(spark, sf):
    return analysed(spark, sf).select("video_id", F.col("script.content_intent").alias("intent"))


@query(
    "script_analysis",
    f"""WITH {V.VIDEOS_SQL}, {ANALYSIS_SQL} SELECT video_id, CAST(coalesce(total, -1) AS INTEGER) AS total, CAST(CASE WHEN n > 0 THEN hs ELSE -1 END AS INTEGER) AS hook,
        CAST(CASE WHEN n > 0 THEN cs ELSE -1 END AS INTEGER) AS clarity, CAST(CASE WHEN n > 0 THEN fs ELSE -1 END AS INTEGER) AS fit, CAST(CASE WHEN n > 0 THEN ascore ELSE -1 END AS INTEGER) AS cta,
        CASE WHEN n = 0 THEN 'no_evaluable' WHEN exa >= 2 THEN 'alto' WHEN exa = 1 THEN 'medio' ELSE 'bajo' END AS risk FROM analysis""",
)
def script_analysis(spark, sf):
    sc = "script."
    return analysed(spark, sf).select(
        "video_id", F.coalesce(f"{sc}script_quality_score", F.lit(-1)).alias("total"), F.coalesce(f"{sc}hook_score", F.lit(-1)).alias("hook"),
        F.coalesce(f"{sc}clarity_score", F.lit(-1)).alias("clarity"), F.coalesce(f"{sc}intent_fit_score", F.lit(-1)).alias("fit"),
        F.coalesce(f"{sc}cta_score", F.lit(-1)).alias("cta"), F.col(f"{sc}policy_claim_risk").alias("risk"),
    )


@query(
    "script_tone",
    f"""WITH {V.VIDEOS_SQL}, {ANALYSIS_SQL} SELECT video_id, CASE WHEN n = 0 THEN {s.q(msg.SCRIPT_MISSING)} WHEN ih THEN CASE WHEN irony > 0 THEN 'humorístico/irónico' ELSE 'humorístico/entretenimiento' END
        WHEN exa >= 2 OR urg >= 3 THEN 'sensacionalista/agresivo' WHEN testi > 0 THEN 'testimonial' WHEN ie THEN 'educativo' WHEN cta > 0 AND ben > 0 THEN 'promocional'
        WHEN tru > 0 THEN 'informativo/confiable' ELSE 'informativo' END AS tone,
        CASE WHEN n = 0 THEN 'no evaluable' WHEN quest THEN 'pregunta/curiosidad' WHEN ih AND lead_hum > 0 THEN 'setup humorístico' WHEN lead_sit > 0 THEN 'situación/expectativa'
        WHEN lead_ben > 0 THEN 'beneficio directo' WHEN lead_com > 0 THEN 'oferta/comercial' ELSE 'contextual' END AS hook_type FROM analysis""",
)
def script_tone(spark, sf):
    return analysed(spark, sf).select("video_id", F.col("script.tone").alias("tone"), F.col("script.hook_type").alias("hook_type"))


_M = msg.SCRIPT


@query(
    "script_advice",
    f"""WITH {V.VIDEOS_SQL}, {ANALYSIS_SQL} SELECT video_id, CASE WHEN n = 0 THEN '' ELSE array_to_string(list_filter([{s.q(_M['has_transcript'])}, CASE WHEN hs >= 70 THEN {s.q(_M['hook_ok'])} END,
        CASE WHEN ih AND fs >= 68 THEN {s.q(_M['humor_ok'])} END, CASE WHEN ic AND fs >= 70 THEN {s.q(_M['value_ok'])} END, CASE WHEN ie THEN {s.q(_M['edu_ok'])} END,
        CASE WHEN NOT ih AND NOT ic AND NOT ie AND cs >= 70 THEN {s.q(_M['clear_ok'])} END], lambda x: x IS NOT NULL), ' | ') END AS strengths FROM analysis""",
)
def script_advice(spark, sf):
    return analysed(spark, sf).select("video_id", joined("script.main_strengths", "strengths"))
