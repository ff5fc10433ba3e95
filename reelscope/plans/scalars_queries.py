"""Queries over text, date and arithmetic scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions import arrays as A
from reelscope.functions import numeric as N
from reelscope.functions import temporal as D
from reelscope.functions import text as T
from reelscope.functions.terms import term_hits
from reelscope.operators.features import lexicon_flags, notebook_features
from reelscope.operators.normalize import category_map
from reelscope.plans import sqltext as s
from reelscope.plans import views as V
from reelscope.plans.registry import joined, query, r6
from reelscope.session import table


def with_videos(select: str) -> str:
    return f"WITH {V.VIDEOS_SQL} {select}"


DOC = "CAST(doc_id AS VARCHAR) AS video_id"


def docs(spark, sf):
    return V.documents(spark, sf).withColumn("video_id", F.col("doc_id").cast("string"))


# --- text ---------------------------------------------------------------------


@query("word_count", f"SELECT {DOC}, CAST({s.words_n('text')} AS INTEGER) AS n FROM documents")
def word_count(spark, sf):
    return docs(spark, sf).select("video_id", T.word_count("text").alias("n"))


@query(
    "uppercase_ratio",
    f"""SELECT {DOC}, CASE WHEN {s.n_match('text', r'\p{L}')} > 0
        THEN round({s.n_match('text', r'\p{Lu}')} / {s.n_match('text', r'\p{L}')}, 4) ELSE 0.0::DOUBLE END AS ratio FROM documents""",
)
def uppercase_ratio(spark, sf):
    return docs(spark, sf).select("video_id", T.uppercase_ratio("text").alias("ratio"))


@query(
    "char_counts",
    f"""SELECT {DOC}, CAST(length(text) AS INTEGER) AS text_total_len,
        CAST(length(text) - length(replace(text, '!', '')) AS INTEGER) AS exclamation_count,
        CAST(length(text) - length(replace(text, '?', '')) AS INTEGER) AS question_count,
        CAST({s.n_match('text', r'\p{Nd}')} AS INTEGER) AS digit_count FROM documents""",
)
def char_counts(spark, sf):
    return docs(spark, sf).select("video_id", *[c.alias(k) for k, c in T.char_counts("text").items()])


TOTAL_SQL = s.strip("title || ' ' || description || ' ' || transcript_text || ' ' || ocr_text")


@query(
    "text_total",
    with_videos(f"""SELECT video_id, md5({TOTAL_SQL}) AS inference_text,
        md5(title || ' ' || description || ' ' || tags) AS corpus_text FROM videos"""),
)
def text_total(spark, sf):
    v = V.videos(spark, sf)
    return v.select(
        "video_id",
        F.md5(T.text_total("title", "description", "transcript_text", "ocr_text")).alias("inference_text"),
        F.md5(T.corpus_text("title", "description", "tags")).alias("corpus_text"),
    )


FLAG_LISTS = {
    "cta": fv.CTA_TERMS, "urgency": fv.URGENCY_TERMS, "trust": fv.TRUST_TERMS, "promo": fv.PROMO_TERMS,
    "benefit": fv.BENEFIT_TERMS, "price": fv.PRICE_TERMS,
}


@query(
    "lexicon_flags",
    f"SELECT {DOC}, " + ", ".join(f"{s.flag('text', t)} AS {k}_flag" for k, t in FLAG_LISTS.items()) + " FROM documents",
)
def flags(spark, sf):
    out = lexicon_flags(docs(spark, sf), "text")
    return out.select("video_id", *[f"{k}_flag" for k in FLAG_LISTS])


@query(
    "term_hits",
    f"""SELECT {DOC}, CAST({s.hits('text', fv.LIGHT_COMMERCIAL_TERMS)} AS INTEGER) AS commercial,
        CAST({s.hits('text', fv.LIGHT_NEWS_TERMS)} AS INTEGER) AS news FROM documents""",
)
def hits(spark, sf):
    return docs(spark, sf).select(
        "video_id",
        term_hits("text", fv.LIGHT_COMMERCIAL_TERMS).alias("commercial"),
        term_hits("text", fv.LIGHT_NEWS_TERMS).alias("news"),
    )


def relevance_tokens_sql(text: str) -> str:
    low = f"regexp_replace(lower({text}), 'https?://[^{s.SPACE}]+', ' ', 'g')"
    low = f"regexp_replace({low}, 'www\\.[^{s.SPACE}]+', ' ', 'g')"
    low = f"regexp_replace({low}, '[^a-záéíóúüñ0-9{s.SPACE}]', ' ', 'g')"
    stop = s.lst(fv.RELEVANCE_STOPWORDS)
    return f"list_distinct(list_filter({s.split(low)}, lambda w: length(w) >= 3 AND NOT list_contains({stop}, w)))"


@query(
    "relevance_tokens",
    f"""SELECT {DOC}, CAST(len({relevance_tokens_sql('text')}) AS INTEGER) AS n,
        md5(array_to_string(list_sort({relevance_tokens_sql('text')}), ' ')) AS tokens FROM documents""",
)
def relevance(spark, sf):
    t = docs(spark, sf).select("video_id", T.relevance_tokens("text").alias("t"))
    return t.select("video_id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens"))


SENTIMENT_CLEAN_SQL = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_" + s.SPACE + f"]', ' ', 'g'), '[{s.SPACE}]+', ' ', 'g'))"


@query("sentiment_clean", f"SELECT conv_id, turn, md5({SENTIMENT_CLEAN_SQL}) AS cleaned FROM conversations")
def sentiment_clean(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.sentiment_clean("text")).alias("cleaned"))


def content_tokens_sql(text: str) -> str:
    low = f"regexp_replace(lower({text}), 'https?://[^{s.SPACE}]+', ' ', 'g')"
    low = f"regexp_replace({low}, 'www\\.[^{s.SPACE}]+', ' ', 'g')"
    low = f"regexp_replace({low}, '[@#][\\p{{L}}\\p{{N}}_]+', ' ', 'g')"
    low = f"regexp_replace({low}, '[^a-záéíóúüñ{s.SPACE}]', ' ', 'g')"
    stop = s.lst(fv.SENTIMENT_STOPWORDS)
    return f"list_filter({s.split(low)}, lambda w: length(w) >= 3 AND NOT list_contains({stop}, w))"


@query(
    "content_tokens",
    f"""SELECT {DOC}, CAST(len({content_tokens_sql('text')}) AS INTEGER) AS n,
        md5(array_to_string({content_tokens_sql('text')}, ' ')) AS tokens FROM documents""",
)
def content_tokens(spark, sf):
    t = docs(spark, sf).select("video_id", T.content_tokens("text").alias("t"))
    return t.select("video_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


def sentences_sql(delims: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex(text, '[{delims}]+'), lambda x: {s.strip('x')}), lambda x: x <> '')"
    )


def mean_len_sql(delims: str) -> str:
    parts = sentences_sql(delims)
    return (
        f"CASE WHEN len({parts}) > 0 THEN list_sum(list_transform({parts}, lambda x: len({s.split('x')})))::DOUBLE"
        f" / len({parts}) ELSE 0.0::DOUBLE END"
    )


@query(
    "sentences",
    f"""SELECT {DOC}, CAST(len({sentences_sql('.!?')}) AS INTEGER) AS n,
        md5(array_to_string({sentences_sql('.!?')}, '|')) AS parts,
        {s.r6(mean_len_sql('.!?'))} AS mean_corpus, {s.r6(mean_len_sql('.!?¿¡'))} AS mean_analyzer FROM documents""",
)
def sentences(spark, sf):
    d = docs(spark, sf)
    return d.select(
        "video_id", F.size(T.sentences("text")).alias("n"), F.md5(F.array_join(T.sentences("text"), "|")).alias("parts"),
        r6(T.mean_sentence_length("text"), "mean_corpus"), r6(T.mean_sentence_length("text", ".!?¿¡"), "mean_analyzer"),
    )


@query(
    "first_words",
    f"SELECT {DOC}, array_to_string(list_slice({s.split('text')}, 1, 30), ' ') AS hook FROM documents",
)
def first_words(spark, sf):
    return docs(spark, sf).select("video_id", T.first_words("text", 30).alias("hook"))


@query(
    "clip_text",
    f"""SELECT {DOC}, CASE WHEN length({s.clean('text')}) > 360 THEN substr({s.clean('text')}, 1, 360) || '...'
        ELSE {s.clean('text')} END AS clipped FROM documents""",
)
def clip_text(spark, sf):
    return docs(spark, sf).select("video_id", T.clip_text("text", 360).alias("clipped"))


URL_PARTS_SQL = f"""WITH {V.URLS_SQL}, p AS (
  SELECT page_id, form, {s.strip('url')} AS v FROM urls),
r AS (
  SELECT *, lower(regexp_extract(v, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host,
    regexp_extract(regexp_replace(v, '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^(?://[^/?#]*)?([^?#]*)', 1) AS path,
    regexp_extract(regexp_extract(v, '^[^?#]*\\?([^#]*)', 1), '(?:^|&)v=([^&]+)', 1) AS param FROM p)"""


@query(
    "extract_video_id",
    URL_PARTS_SQL + """
SELECT page_id, CAST(form AS INTEGER) AS form, coalesce(CASE
  WHEN regexp_full_match(v, '[A-Za-z0-9_-]{11}') THEN v
  WHEN contains(host, 'youtu.be') THEN CASE WHEN regexp_full_match(split_part(ltrim(path, '/'), '/', 1), '[A-Za-z0-9_-]{11}')
       THEN split_part(ltrim(path, '/'), '/', 1) END
  WHEN contains(host, 'youtube.com') AND param <> '' THEN CASE WHEN regexp_full_match(param, '[A-Za-z0-9_-]{11}') THEN param END
  WHEN contains(host, 'youtube.com') AND regexp_extract(path, '/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})', 1) <> ''
       THEN regexp_extract(path, '/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})', 1) END, '-') AS video_id FROM r""",
)
def extract_video_id(spark, sf):
    return V.urls(spark, sf).select("page_id", "form", F.coalesce(T.extract_video_id("url"), F.lit("-")).alias("video_id"))


@query(
    "channel_hint",
    URL_PARTS_SQL + """, t AS (SELECT *, trim(path, '/') AS q FROM r)
SELECT page_id, CAST(form AS INTEGER) AS form,
  CASE WHEN v = '' THEN '' WHEN starts_with(v, 'UC') AND length(v) >= 20 THEN 'id' WHEN starts_with(v, '@') THEN 'handle'
       WHEN starts_with(q, '@') THEN 'handle'
       WHEN contains(q, '/') AND split_part(q, '/', 1) = 'channel' THEN 'id'
       WHEN contains(q, '/') AND split_part(q, '/', 1) IN ('c', 'user') THEN split_part(q, '/', 1) ELSE 'query' END AS kind,
  CASE WHEN v = '' THEN '' WHEN starts_with(v, 'UC') AND length(v) >= 20 THEN v WHEN starts_with(v, '@') THEN v
       WHEN starts_with(q, '@') THEN q
       WHEN contains(q, '/') AND split_part(q, '/', 1) IN ('channel', 'c', 'user') THEN split_part(q, '/', 2) ELSE v END AS value
FROM t""",
)
def channel_hint(spark, sf):
    h = V.urls(spark, sf).withColumn("h", T.channel_hint("url"))
    return h.select("page_id", "form", F.col("h.type").alias("kind"), F.col("h.value").alias("value"))


DURATION = "('PT' || (event_id % 30) || 'H' || (event_id % 70) || 'M' || (event_id % 60) || 'S')"


@query(
    "iso_duration_seconds",
    """SELECT event_id, CAST((event_id % 30) * 3600 + (event_id % 70) * 60 + event_id % 60 AS BIGINT) AS full_form,
       CAST(event_id % 60 AS BIGINT) AS seconds_only, CAST(-1 AS BIGINT) AS broken FROM events""",
)
def iso_duration(spark, sf):
    e = F.col("event_id")

    def part(m, unit):
        return F.concat((e % m).cast("string"), F.lit(unit))

    return table(spark, sf, "events").select(
        "event_id",
        T.iso_duration_seconds(F.concat(F.lit("PT"), part(30, "H"), part(70, "M"), part(60, "S"))).alias("full_form"),
        T.iso_duration_seconds(F.concat(F.lit("PT"), part(60, "S"))).alias("seconds_only"),
        F.coalesce(T.iso_duration_seconds(F.concat(F.lit("P1"), part(60, "S"))), F.lit(-1)).alias("broken"),
    )


NOISE = "text || '|||' || chr(12) || '~~ ' || source"
OCR_NORMAL_SQL = s.clean(f"regexp_replace(replace({NOISE}, chr(12), ' '), '[|_~`^]{{2,}}', ' ', 'g')")


@query("ocr_normalize", f"SELECT {DOC}, md5({OCR_NORMAL_SQL}) AS line FROM documents")
def ocr_normalize(spark, sf):
    raw = F.concat("text", F.lit("|||\x0c~~ "), "source")
    return docs(spark, sf).select("video_id", F.md5(T.ocr_normalize(raw)).alias("line"))


def quality_sql(x: str, chars: str) -> str:
    n = f"greatest(length({x}), 1)"
    alnum = f"{s.n_match(x, '[\\p{L}\\p{N}]')}::DOUBLE / {n}"
    letters = f"{s.n_match(x, '\\p{L}')}::DOUBLE / {n}"
    odd_pattern = "[^\\p{L}\\p{N}" + s.SPACE + ".,:;!?¿¡%$#@+\\-/()]"
    odd = f"{s.n_match(x, odd_pattern)}::DOUBLE / {n}"
    # Five equal neighbours; RE2 has no back-references.
    repeated = (
        f"len(list_filter(list_zip({chars}[1:len({chars}) - 4], {chars}[2:len({chars}) - 3], {chars}[3:len({chars}) - 2], "
        f"{chars}[4:len({chars}) - 1], {chars}[5:len({chars})]), "
        "lambda z: z[1] = z[2] AND z[2] = z[3] AND z[3] = z[4] AND z[4] = z[5])) > 0"
    )
    return (
        f"CASE WHEN length({x}) < 3 OR ({repeated}) OR ({alnum} < 0.35 AND {letters} < 0.25) THEN 0.0::DOUBLE "
        f"ELSE {s.clip(f'{alnum} + {letters} * 0.4::DOUBLE - {odd} * 1.4::DOUBLE', 0, 1)} END"
    )


@query(
    "ocr_line_quality",
    f"""WITH l AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(line, '[|_~`^]{{2,}}', ' ', 'g'), '[{s.SPACE}]+', ' ', 'g')) AS x
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
              generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
        SELECT doc_id, CAST(i AS INTEGER) AS i, {s.r6(quality_sql('x', 'c'))} AS quality
        FROM (SELECT *, string_split(lower(x), '') AS c FROM l)""",
)
def line_quality(spark, sf):
    lines = V.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select("doc_id", (F.col("p") + 1).alias("i"), r6(T.ocr_line_quality("line"), "quality"))


def jitter_sql(text: str, span: float) -> str:
    h = f"CAST(('0x' || substr(sha256({text}), 1, 8)) AS BIGINT)"
    return f"1.0::DOUBLE + ({h} / 4294967295.0::DOUBLE - 0.5::DOUBLE) * 2 * {span}::DOUBLE"


@query("stable_jitter", f"SELECT {DOC}, {s.r6(jitter_sql('text', 0.16))} AS jitter FROM documents")
def jitter(spark, sf):
    return docs(spark, sf).select("video_id", r6(T.stable_jitter("text"), "jitter"))


@query(
    "extract_json",
    """SELECT event_id, CAST(coalesce(CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END, -1) AS INTEGER) AS k
       FROM events""",
)
def extract_json(spark, sf):
    fence = F.lit("```")
    e = F.col("event_id") % 4
    raw = (
        F.when(e == 0, F.col("props"))
        .when(e == 1, F.concat(fence, F.lit("json\n"), "props", F.lit("\n"), fence))
        .when(e == 2, F.concat(F.lit("Result: "), "props", F.lit(" done")))
        .otherwise(F.concat(F.lit("{"), "props"))
    )
    return table(spark, sf, "events").select(
        "event_id", F.coalesce(T.extract_json(raw, "k int")["k"], F.lit(-1)).alias("k")
    )


@query(
    "coerce_contract",
    f"""SELECT event_id,
          CAST(CASE WHEN event_id % 3 = 0 THEN 50 ELSE {s.clip(s.bround('CAST(value AS DOUBLE) * 3'), 0, 100)} END AS INTEGER) AS claridad,
          CAST(100 AS INTEGER) AS fuerza, CAST(40 AS INTEGER) AS coherencia, event_type AS tipo,
          CASE WHEN event_id % 2 = 0 THEN 'a | b' ELSE 'fb' END AS fortalezas FROM events""",
)
def coerce(spark, sf):
    e, even = F.col("event_id"), F.col("event_id") % 2 == 0
    claridad = F.when(e % 3 == 0, F.lit('"alta"')).otherwise((F.col("value") * 3).cast("string"))
    raw = F.concat(
        F.lit('{"claridad_mensaje": '), claridad, F.lit(', "fuerza_cta": 250.4, "tipo_contenido": "'), "event_type",
        F.lit('", "fortalezas": '), F.when(even, F.lit('["a", "b"]')).otherwise(F.lit('"texto"')), F.lit("}"),
    )
    fb = F.struct(*[
        (F.array(F.lit("fb")) if k in T.CONTRACT_LISTS else F.lit(40) if k == "coherencia_semantica" else F.lit(50) if k in T.CONTRACT_SCORES else F.lit("x")).alias(k)
        for k in fv.CONTRACT_KEYS
    ])
    out = table(spark, sf, "events").withColumns({"raw": raw, "fb": fb}).withColumn("c", T.coerce_contract("raw", "fb"))
    return out.select(
        "event_id", F.col("c.claridad_mensaje").alias("claridad"), F.col("c.fuerza_cta").alias("fuerza"),
        F.col("c.coherencia_semantica").alias("coherencia"), F.col("c.tipo_contenido").alias("tipo"),
        joined("c.fortalezas", "fortalezas"),
    )


GEN = "(text || ' video contenido ' || source)"


@query(
    "generated_text_quality",
    f"""WITH w AS MATERIALIZED (SELECT doc_id, {GEN} AS body, regexp_extract_all(lower({s.strip(GEN)}), '({s.WORD})', 1) AS w FROM (SELECT * FROM documents)),
        g AS MATERIALIZED (SELECT doc_id, body, len(w) AS n,
          list_transform(list_zip(w[1:len(w) - 3], w[2:len(w) - 2], w[3:len(w) - 1], w[4:len(w)]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3] || ' ' || z[4]) AS grams FROM w)
        SELECT {DOC}, CASE WHEN n < 90 THEN 'corta'
        WHEN {s.hits('body', fv.GENERATED_FORBIDDEN)} > 0 THEN 'incoherente'
        WHEN {s.hits('body', fv.GENERATED_DOMAIN_TERMS)} < 2 THEN 'fuera_de_dominio'
        WHEN len(list_distinct(grams))::DOUBLE / len(grams) < 0.72 THEN 'repetitiva' ELSE 'ok' END AS reason
        FROM g""",
)
def generated_quality(spark, sf):
    t = F.concat("text", F.lit(" video contenido "), "source")
    return docs(spark, sf).select("video_id", T.generated_text_quality(t)["reason"].alias("reason"))


_UNSTABLE = (
    f"({s.tokens_n('text')} < 70 OR {s.hits('text', fv.GUARD_BAD_MARKERS)} > 0 "
    "OR (length(lower(text)) - length(replace(lower(text), 'hallazgo', ''))) / 8 >= 4 "
    "OR (contains(lower(text), 'no invertir') AND contains(lower(text), 'puede avanzar') AND contains(lower(text), 'sí invertir')))"
)


@query(
    "recommendation_guard",
    f"""SELECT {DOC}, (lang <> 'en' AND {_UNSTABLE}) AS replaced,
        md5(CASE WHEN lang <> 'en' AND {_UNSTABLE} THEN 'rule text ' || source ELSE text END) AS shown FROM documents""",
)
def guard(spark, sf):
    mode = F.when(F.col("lang") == "en", F.lit("rules")).otherwise(F.lit("local_open_source"))
    g = docs(spark, sf).withColumn("g", T.recommendation_guard("text", mode, F.concat(F.lit("rule text "), "source")))
    return g.select("video_id", F.col("g.estabilizada").alias("replaced"), F.md5("g.recomendacion").alias("shown"))


_H = "greatest(value * 1.0, 0.0)"


@query(
    "labels_and_formats",
    """SELECT event_id,
         CASE WHEN h < 100 THEN rtrim(rtrim(printf('%.2f', round(h, 2)), '0'), '.') ELSE rtrim(rtrim(printf('%.1f', round(h, 1)), '0'), '.') END
         || CASE WHEN abs(CASE WHEN h < 100 THEN round(h, 2) ELSE round(h, 1) END - 1) < 0.05 THEN ' hora' ELSE ' horas' END AS age
       FROM (SELECT event_id, CAST(value AS DOUBLE) AS h FROM events)""",
)
def formats(spark, sf):
    return table(spark, sf, "events").select("event_id", T.age_label("value").alias("age"))


# --- dates and arithmetic -----------------------------------------------------


@query(
    "parse_ts",
    """SELECT event_id, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) AS iso, CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS day,
       CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) AS epoch, CAST(epoch_us(date_trunc('second', ts)) - 7200000000 AS BIGINT) AS zoned,
       CAST(-1 AS BIGINT) AS bad FROM events""",
)
def parse_ts(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))

    def micros(c):
        return F.coalesce(F.unix_micros(D.parse_ts(c)), F.lit(-1))

    iso = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select(
        "event_id",
        micros(F.concat(iso, F.lit("Z"))).alias("iso"),
        micros(F.date_format("t", "yyyyMMdd")).alias("day"),
        micros(F.concat(F.unix_timestamp("t").cast("string"), F.lit("000"))).alias("epoch"),
        micros(F.concat(iso, F.lit("+02:00"))).alias("zoned"),
        micros(F.concat(F.lit("x"), iso)).alias("bad"),
    )


@query(
    "days_and_hours_since",
    f"""SELECT event_id,
       {s.r6(f"greatest((epoch_us({V.AS_OF_SQL}) - epoch_us(ts)) / 86400000000.0::DOUBLE, 1.0::DOUBLE)")} AS days,
       round(greatest((epoch_us({V.AS_OF_SQL}) - epoch_us(ts)) / 3600000000.0::DOUBLE, 1.0::DOUBLE), 2) AS hours FROM events""",
)
def since(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.select("event_id", r6(D.days_since("t", V.AS_OF), "days"), D.hours_since("t", V.AS_OF).alias("hours"))


@query(
    "calendar_parts",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS pub_hour, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
       CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) AS INTEGER) AS iso_weekday FROM events""",
)
def calendar(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.select("event_id", *[c.alias(k) for k, c in D.calendar_parts("t").items()])


@query(
    "season",
    """SELECT CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'Spring' WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'Summer'
       WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'Fall' ELSE 'Winter' END AS season, count(*) AS n FROM orders GROUP BY 1""",
)
def season(spark, sf):
    return table(spark, sf, "orders").groupBy(D.season(F.month("o_orderdate")).alias("season")).agg(F.count("*").alias("n"))


FIT_SQL = """CASE WHEN d <= 0 THEN 0.5 WHEN d <= 7 THEN 0.95 WHEN d <= 15 THEN 0.9 WHEN d <= 30 THEN 0.8
  WHEN d <= 60 THEN 0.7 WHEN d <= 180 THEN 0.55 ELSE 0.4 END::DOUBLE"""


@query("duration_fit", f"SELECT doc_id, {FIT_SQL} AS fit FROM (SELECT doc_id, n_chars % 250 AS d FROM documents)")
def duration_fit(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.duration_fit(F.col("n_chars") % 250).alias("fit"))


@query(
    "duration_bucket",
    """SELECT doc_id, CASE WHEN d <= 15 THEN 'short' WHEN d <= 60 THEN 'medium' ELSE 'long' END AS simple,
       CASE WHEN d <= 0 THEN 'desconocida' WHEN d <= 15 THEN 'muy_corto_1_15s' WHEN d <= 60 THEN 'corto_16_60s'
            WHEN d <= 180 THEN 'medio_61_180s' ELSE 'largo_180s_plus' END AS audit,
       CASE WHEN d <= 15 THEN 0 WHEN d <= 30 THEN 1 WHEN d <= 60 THEN 2 WHEN d <= 90 THEN 3 WHEN d <= 120 THEN 4 ELSE 5 END::DOUBLE AS code,
       CASE WHEN d <= 30 THEN 'corto (<=30s)' WHEN d <= 60 THEN 'medio (31-60s)' WHEN d <= 120 THEN 'largo (61-120s)'
            ELSE 'muy largo (>120s)' END AS grp
       FROM (SELECT doc_id, n_chars % 250 AS d FROM documents)""",
)
def duration_bucket(spark, sf):
    d = F.col("n_chars") % 250
    return table(spark, sf, "documents").select(
        "doc_id", N.duration_bucket(d).alias("simple"), N.audit_duration_bucket(d).alias("audit"),
        N.notebook_duration_bucket(d).alias("code"), N.notebook_duration_group(d).alias("grp"),
    )


def engagement_sql(corpus: bool) -> str:
    den = "CASE WHEN views = 0 THEN 1.0 ELSE views END" if corpus else "greatest(views, 1.0)"
    days = f"greatest(coalesce((epoch_us({V.AS_OF_SQL}) - epoch_us(published_at)) / 86400000000.0::DOUBLE, 1.0), 1.0)"
    return f"""round((likes + comments) / ({den}), 6) AS engagement_rate, round(likes / ({den}), 6) AS like_rate,
      round(comments / ({den}), 6) AS comment_rate, round(views / {days}, 6) AS views_per_day,
      round(ln(1 + views), 6) AS log_views, round(ln(1 + likes), 6) AS log_likes, round(ln(1 + comments), 6) AS log_comments"""


@query("engagement", with_videos(f"SELECT video_id, views, likes, comments, {engagement_sql(False)} FROM videos"))
def engagement(spark, sf):
    cols = N.engagement("views", "likes", "comments", "published_at", V.AS_OF)
    return V.videos(spark, sf).select("video_id", *[c.alias(k) for k, c in cols.items()])


RETENTION_SQL = """round(CASE WHEN average_watch_time > 0 AND duration_seconds > 0
  THEN least(average_watch_time / duration_seconds, 1.0) ELSE 0.35 END, 4)"""


@query("retention", with_videos(f"SELECT video_id, {RETENTION_SQL} AS retention_rate FROM videos"))
def retention(spark, sf):
    return V.videos(spark, sf).select(
        "video_id", N.retention("average_watch_time", "duration_seconds", 35.0).alias("retention_rate")
    )


HOURS_SQL = f"coalesce(round(greatest((epoch_us({V.AS_OF_SQL}) - epoch_us(published_at)) / 3600000000.0::DOUBLE, 1.0::DOUBLE), 2), 24.0)"


@query(
    "operational_metrics",
    with_videos(f"""SELECT video_id, shares, CASE WHEN views <> 0 THEN round(shares / views, 6) ELSE 0.0 END AS share_rate,
      {RETENTION_SQL} AS retention_rate, {HOURS_SQL} AS hours_since_publication, round(views / {HOURS_SQL}, 4) AS views_per_hour FROM videos"""),
)
def operational(spark, sf):
    v = V.videos(spark, sf)
    hours = F.coalesce(D.hours_since("published_at", V.AS_OF), F.lit(24.0))
    ops = N.operational_metrics("views", "shares", N.retention("average_watch_time", "duration_seconds", 0.35), hours)
    return v.select("video_id", *[c.alias(k) for k, c in ops.items()])


@query(
    "bounded_scaling",
    f"""SELECT event_id, {s.r6(s.clip('(v - 5) / 20.0::DOUBLE', 0, 1))} AS scaled, 0.0::DOUBLE AS empty_range,
        {s.r6(s.clip('v', 2, 30))} AS clipped, {s.r6(s.clip('v / 100', 0, 0.35))} AS rate,
        {s.r6(s.clip('v / 40', 0.02, 0.98))} AS probability,
        {s.r6('1 / (1 + exp(-(v - 20)))')} AS sigmoid,
        {s.r6("CASE WHEN v > 10 AND v > 25 THEN (v - 10 + v - 25) / 2 WHEN v > 10 THEN v - 10 ELSE 0 END")} AS mean_positive
        FROM (SELECT event_id, CAST(value AS DOUBLE) AS v FROM events)""",
)
def bounded(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", r6(N.minmax_clip(v, 5.0, 25.0), "scaled"), N.minmax_clip(v, 5.0, 5.0).alias("empty_range"),
        r6(N.clip(v, 2.0, 30.0), "clipped"), r6(N.clip_rate(v / 100), "rate"),
        r6(N.clip_probability(v / 40), "probability"), r6(N.safe_sigmoid(v - 20), "sigmoid"),
        r6(N.avg_positive(v - 10, v - 25), "mean_positive"),
    )


@query(
    "safe_numbers",
    f"""SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 7 WHEN 4 THEN value ELSE 7 END AS DOUBLE) AS f,
        CAST(CASE event_id % 6 WHEN 0 THEN {s.bround('value')} WHEN 4 THEN {s.bround('value')} ELSE 7 END AS BIGINT) AS i FROM events""",
)
def safe_numbers(spark, sf):
    v = F.col("value").cast("string")
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, v).when(k == 1, F.lit("")).when(k == 2, F.lit("NaN")).when(k == 3, F.lit("inf"))
        .when(k == 4, F.concat(F.lit(" "), v)).otherwise(F.concat(v, F.lit("x")))
    )
    return table(spark, sf, "events").select("event_id", N.safe_float(raw, 7.0).alias("f"), N.safe_int(raw, 7.0).alias("i"))


VALUE_RE = "(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(fv.NOTEBOOK_VALUE_WORDS) + ")(?:$|[^\\p{L}\\p{N}_])"
PROMO_RE = "(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(fv.NOTEBOOK_PROMO_WORDS) + ")(?:$|[^\\p{L}\\p{N}_])"
UPPER_SQL = f"(CASE WHEN {s.n_match('title', r'\p{L}')} > 0 THEN round({s.n_match('title', r'\p{Lu}')}::DOUBLE / {s.n_match('title', r'\p{L}')}, 4) ELSE 0 END)"


@query(
    "ad_features",
    with_videos(f"""SELECT video_id,
      CASE WHEN duration_seconds <= 15 THEN 0 WHEN duration_seconds <= 30 THEN 1 WHEN duration_seconds <= 60 THEN 2
           WHEN duration_seconds <= 90 THEN 3 WHEN duration_seconds <= 120 THEN 4 ELSE 5 END::DOUBLE AS duration_bucket,
      CAST(coalesce(hour(published_at), 12) AS INTEGER) AS pub_hour,
      CAST(coalesce(isodow(published_at) >= 6, false) AS INTEGER) AS is_weekend,
      {s.r6("length(t) / greatest(duration_seconds, 1.0::DOUBLE)")} AS word_density,
      {s.r6("(length(t) - length(replace(t, '?', ''))) / greatest(CAST(tw AS DOUBLE), 1.0::DOUBLE)")} AS question_ratio,
      {s.r6(s.clip(f"(length(t) - length(replace(t, '!', ''))) * 0.5::DOUBLE + {UPPER_SQL} * 0.5::DOUBLE", 0, 1))} AS emotional_score,
      CAST(regexp_matches(lower(t), {s.q(VALUE_RE)}) AS INTEGER) AS value_proposition_flag,
      CAST(regexp_matches(lower(t), {s.q(PROMO_RE)}) AS INTEGER) AS promotional_flag
      FROM (SELECT *, title || ' ' || description AS t, {s.tokens_n('title')} AS tw FROM videos)"""),
)
def ad_features(spark, sf):
    text = F.concat_ws(" ", "title", "description")
    base = V.videos(spark, sf).withColumns(
        {
            "text": text, "text_len": F.length(text), "title_word_count": T.token_count("title"),
            "question_count": F.regexp_count(text, F.lit(r"\?")), "exclamation_count": F.regexp_count(text, F.lit("!")),
            "uppercase_ratio": T.uppercase_ratio("title"),
        }
    )
    out = notebook_features(base)
    return out.select(
        "video_id", "duration_bucket", "pub_hour", "is_weekend", r6("word_density", "word_density"),
        r6("question_ratio", "question_ratio"), r6("emotional_score", "emotional_score"),
        "value_proposition_flag", "promotional_flag",
    )


@query(
    "sampling_timestamps",
    """SELECT doc_id, array_to_string(list_transform(CASE WHEN d <= 0 THEN [] WHEN e <= st THEN [d/2, d/2, d/2, d/2, d/2, d/2, d/2, d/2, d/2, d/2]
         ELSE list_transform(range(10), lambda i: round(st + i * ((e - st) / 9), 2)) END, lambda x: printf('%.2f', x)), ' ') AS points
       FROM (SELECT doc_id, d, least(0.5::DOUBLE, d * 0.05::DOUBLE) AS st, greatest(d - 0.5::DOUBLE, d * 0.95::DOUBLE) AS e
             FROM (SELECT doc_id, CAST(n_chars % 200 AS DOUBLE) AS d FROM documents))""",
)
def sampling(spark, sf):
    d = table(spark, sf, "documents").withColumn("d", (F.col("n_chars") % 200).cast("double"))
    pts = F.transform(N.sampling_timestamps("d", 10), lambda x: F.format_string("%.2f", x))
    return d.select("doc_id", F.array_join(pts, " ").alias("points"))


FRAME_TS_SQL = """
WITH b AS (SELECT doc_id, CAST(n_chars % 130 AS DOUBLE) AS d FROM documents),
g AS (SELECT doc_id, d, CASE WHEN d <= 8 THEN 0.75 ELSE 4.0 END::DOUBLE AS step, greatest(d - 0.2::DOUBLE, 0.6::DOUBLE) AS lim FROM b),
p AS (SELECT doc_id, d, list_sort(list_distinct(list_concat(
        list_transform(list_filter(range(200), lambda i: 0.5::DOUBLE + i * step < lim), lambda i: round(0.5::DOUBLE + i * step, 2)),
        list_transform(list_filter([1.0::DOUBLE, d * 0.25::DOUBLE, d * 0.5::DOUBLE, d * 0.75::DOUBLE, greatest(d - 0.5::DOUBLE, 0.0::DOUBLE)],
                       lambda t: t >= 0 AND t <= d), lambda t: round(t, 2))))) AS u FROM g)
SELECT doc_id, array_to_string(list_transform(CASE WHEN d <= 0 THEN [] WHEN len(u) > 20
   THEN list_transform(range(20), lambda i: u[CAST(round_even(i * (len(u) - 1) / 19.0::DOUBLE, 0) AS INTEGER) + 1]) ELSE u END,
   lambda x: printf('%.2f', x)), ' ') AS points FROM p"""


@query("frame_timestamps", FRAME_TS_SQL)
def frame_ts(spark, sf):
    d = table(spark, sf, "documents").withColumn("d", (F.col("n_chars") % 130).cast("double"))
    pts = F.transform(N.frame_timestamps("d", F.lit("auto")), lambda x: F.format_string("%.2f", x))
    return d.select("doc_id", F.array_join(pts, " ").alias("points"))


# --- nested collections -------------------------------------------------------


@query(
    "token_overlap",
    with_videos(f"""SELECT video_id, {s.r6("CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END")} AS overlap
      FROM (SELECT video_id, {relevance_tokens_sql('ocr_text')} AS a, {relevance_tokens_sql('title')} AS b FROM videos)"""),
)
def overlap(spark, sf):
    v = V.videos(spark, sf).withColumns({"a": T.relevance_tokens("ocr_text"), "b": T.relevance_tokens("title")})
    return v.select("video_id", r6(A.token_overlap("a", "b"), "overlap"))


@query("flag_union", "SELECT doc_id, greatest(quality, toxic, 0) AS flag FROM labels")
def flag_union(spark, sf):
    return table(spark, sf, "labels").select("doc_id", A.flag_union("quality", "toxic").alias("flag"))


@query(
    "append_unique",
    f"""SELECT doc_id, {s.joined("list_slice(list_concat(list_slice(w, 1, 5), list_filter(list_distinct_keep, lambda x: NOT list_contains(list_slice(w, 1, 5), x))), 1, 5)")} AS items
        FROM (SELECT doc_id, w, CASE WHEN len(e) >= 2 AND e[1] = e[2] THEN [e[1]] ELSE e END AS list_distinct_keep
              FROM (SELECT doc_id, list_slice({s.split('text')}, 1, 1 + n_chars % 6) AS w,
                    list_slice(list_slice({s.split('text')}, 3, 9), 1, 2) AS e FROM documents))""",
)
def append_unique(spark, sf):
    d = V.documents(spark, sf)
    w = F.slice(T.words("text"), F.lit(1), (F.col("n_chars") % 6 + 1).cast("int"))
    return d.select("doc_id", joined(A.append_unique(w, F.slice(T.words("text"), 3, 7)), "items"))


@query(
    "build_array",
    """SELECT doc_id, coalesce(array_to_string(list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END,
       CASE WHEN quality = 0 THEN 'weak' END], lambda x: x IS NOT NULL), ' | '), '') AS items FROM labels""",
)
def build_array(spark, sf):
    qv, tv = F.col("quality"), F.col("toxic")
    return table(spark, sf, "labels").select(
        "doc_id", joined(A.build_array((qv == 1, "good"), (tv == 1, "toxic"), (qv == 0, "weak")), "items")
    )


@query(
    "category_map",
    f"""SELECT c_custkey, coalesce(CASE WHEN n IN ({', '.join(s.q(k) for k in fv.NICHE_BASE_CPM)}) THEN n END, '-') AS niche
        FROM (SELECT c_custkey, {s.case('r', fv.NICHE_ALIASES, 'r')} AS n
              FROM (SELECT c_custkey, ['retail', 'salud', 'auto', 'zzz', 'general', 'educación'][CAST(c_custkey % 6 AS INTEGER) + 1] AS r FROM customer))""",
)
def niche_of(spark, sf):
    names = F.array(*[F.lit(x) for x in (" Retail ", "SALUD", "auto", "zzz", "General", "educación")])
    raw = F.get(names, (F.col("c_custkey") % 6).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(category_map(raw), F.lit("-")).alias("niche"))
