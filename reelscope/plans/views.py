"""Adapters: the driver's tables seen as videos, comments, frames, payloads and campaigns.

Every view exists twice, as a DataFrame and as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.session import table

AS_OF = "2024-02-01T00:00:00Z"
AS_OF_SQL = "TIMESTAMP '2024-02-01 00:00:00'"

VIDEOS_SQL = """
n_docs AS (SELECT count(*) AS n FROM documents),
doc_events AS (
  SELECT event_id % n AS doc_id,
         round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 2) AS views,
         CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS likes,
         CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS comments,
         CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS shares,
         5 * ln(1 + round(sum(value), 2)) AS average_watch_time,
         min(ts) AS published_at
  FROM events, n_docs GROUP BY 1),
videos AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS video_id,
         split_part(text, chr(10), 1) AS title,
         substr(text, length(split_part(text, chr(10), 1)) + 2) AS description,
         CASE WHEN lang = 'de' THEN '' ELSE text END AS transcript_text,
         CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), -1) ELSE '' END AS ocr_text,
         source AS tags, lang AS category_id, source AS source_file,
         CAST(n_chars % 200 AS DOUBLE) AS duration_seconds,
         CAST(n_chars % 150 AS DOUBLE) AS budget,
         coalesce(e.views, 0.0) AS views, coalesce(e.likes, 0.0) AS likes,
         coalesce(e.comments, 0.0) AS comments, coalesce(e.shares, 0.0) AS shares,
         coalesce(e.average_watch_time, 0.0) AS average_watch_time, e.published_at
  FROM documents d LEFT JOIN doc_events e ON d.doc_id = e.doc_id)"""


def videos(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    n = docs.agg(F.count("*").alias("n")).scalar()
    kind = F.col("event_type")

    def counted(k):
        return F.count_if(kind == k).cast("double")

    per_doc = (
        table(spark, sf, "events")
        .groupBy((F.col("event_id") % n).alias("doc_id"))
        .agg(
            F.round(F.sum(F.when(kind == "view", F.col("value")).otherwise(0.0)), 2).alias("views"),
            counted("click").alias("likes"),
            counted("signup").alias("comments"),
            counted("purchase").alias("shares"),
            (F.log1p(F.round(F.sum("value"), 2)) * 5).alias("average_watch_time"),
            F.min("ts").alias("published_at"),
        )
    )
    text = F.col("text")
    counts = ("views", "likes", "comments", "shares", "average_watch_time")
    return docs.join(per_doc, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("video_id"),
        F.substring_index(text, "\n", 1).alias("title"),
        F.when(text.contains("\n"), F.substr(text, F.length(F.substring_index(text, "\n", 1)) + 2)).otherwise("").alias("description"),
        F.when(F.col("lang") == "de", F.lit("")).otherwise(text).alias("transcript_text"),
        F.when(text.contains("\n"), F.substring_index(text, "\n", -1)).otherwise("").alias("ocr_text"),
        F.col("source").alias("tags"),
        F.col("lang").alias("category_id"),
        F.col("source").alias("source_file"),
        (F.col("n_chars") % 200).cast("double").alias("duration_seconds"),
        (F.col("n_chars") % 150).cast("double").alias("budget"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in counts],
        F.col("published_at").cast("timestamp").alias("published_at"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").cast("string").alias("video_id"), F.col("text").alias("transcript"))


COMMENTS_SQL = """
comments AS (
  SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS position, text
  FROM conversations WHERE role = 'user')"""


def comments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where(F.col("role") == "user").select(
        F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("position"), "text"
    )


SCORED_SQL = """
scored AS (
  SELECT l.doc_id AS id, l.quality AS y, l.toxic, d.lang, d.source,
         CAST(d.n_chars % 200 AS DOUBLE) AS duration_seconds, d.n_chars,
         least(d.n_chars / 4100.0::DOUBLE, 1.0::DOUBLE) AS proba,
         CAST(d.n_chars >= 1200 AS INTEGER) AS pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf, "labels").join(table(spark, sf, "documents").drop("text"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), "toxic", "lang", "source",
        (n % 200).cast("double").alias("duration_seconds"), "n_chars",
        F.least(n / F.lit(4100.0), F.lit(1.0)).alias("proba"),
        (n >= 1200).cast("int").alias("pred"),
    )


FRAMES_SQL = """
frames AS (
  SELECT video_id, CAST(i AS DOUBLE) AS ts,
         string_split_regex(line, '[.!?] *') AS lines,
         ['easyocr', 'tesseract', 'none'][CAST(i % 3 AS INTEGER) + 1] AS engine,
         CAST(length(line) % 100 AS DOUBLE) AS confidence,
         length(line) > 0 AS presence
  FROM (SELECT CAST(doc_id AS VARCHAR) AS video_id,
               unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
        FROM documents))"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """On-screen text: every line of a document is a frame, its sentences are the lines read there."""
    rows = documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("i", "line")
    )
    return rows.select(
        "video_id",
        F.col("i").cast("double").alias("ts"),
        F.split("line", "[.!?] *").alias("lines"),
        F.element_at(F.array(F.lit("easyocr"), F.lit("tesseract"), F.lit("none")), F.col("i") % 3 + 1).alias("engine"),
        (F.length("line") % 100).cast("double").alias("confidence"),
        (F.length("line") > 0).alias("presence"),
    )


IMAGES_SQL = """
cells AS (
  SELECT CAST(label AS VARCHAR) AS video_id, vec_id AS frame_index, unnest(embedding)::DOUBLE AS e,
         generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
points AS (
  SELECT video_id, frame_index, (i % 8) * 2 + dx AS x, (i // 8) * 2 + dy AS y
  FROM cells, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS o(dx, dy) WHERE abs(e) > 0.1),
grays AS (
  SELECT video_id, frame_index, i,
         CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (e + 0.5) * 255))) AS INTEGER) AS g FROM cells)"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Frame statistics: an embedding is an 8 x 8 gray picture drawn at double size; strong cells are edges."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    gray = F.transform(e, lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v + 0.5) * 255))).cast("int"))
    strong = F.array_compact(F.transform("embedding", lambda v, i: F.when(F.abs(v.cast("double")) > 0.1, i)))

    def four(i):
        x, y = (i % 8) * 2, F.floor(i / 8).cast("int") * 2
        return F.array(*[
            F.struct((x + dx).cast("int").alias("x"), (y + dy).cast("int").alias("y")) for dx in (0, 1) for dy in (0, 1)
        ])

    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("video_id"),
        F.col("vec_id").alias("frame_index"),
        F.col("vec_id").cast("double").alias("ts"),
        F.lit(16).alias("width"),
        F.lit(16).alias("height"),
        gray.alias("gray"),
        F.flatten(F.transform(strong, four)).alias("edge_points"),
    )


def channel_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One landed channel response per user of the event table."""
    per_user = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("p"), F.min("ts").alias("t")
    )
    u = F.col("user_id").cast("string")
    item = F.struct(
        F.concat(F.lit("UC"), u).alias("id"),
        F.struct(
            F.concat(F.lit("Channel "), u).alias("title"),
            F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("About "), u)).alias("description"),
            F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        ).alias("snippet"),
        F.struct(
            (F.col("p") * 10 + 3).cast("string").alias("subscriberCount"),
            F.when(F.col("user_id") % 3 == 0, F.lit(True)).alias("hiddenSubscriberCount"),
            (F.col("n") * 100).cast("string").alias("viewCount"),
            F.col("n").cast("string").alias("videoCount"),
        ).alias("statistics"),
        F.struct(F.struct(F.concat(F.lit("UU"), u).alias("uploads")).alias("relatedPlaylists")).alias("contentDetails"),
    )
    return per_user.select(
        F.concat(F.lit("UC"), u).alias("channel_id"), F.to_json(F.struct(F.array(item).alias("items"))).alias("payload")
    )


def upload_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One landed upload-list response per event (a single item each)."""
    e = table(spark, sf, "events")
    item = F.struct(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("videoId")).alias("contentDetails"))
    return e.select(
        F.concat(F.lit("UU"), F.col("user_id").cast("string")).alias("playlist_id"),
        F.col("event_id").alias("sequence"),
        F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"),
    )


def video_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One landed video response per event; some counters are missing or not numeric."""
    e = table(spark, sf, "events")
    i = F.col("event_id").cast("string")
    v = F.floor(F.col("value") * 10)
    item = F.struct(
        F.concat(F.lit("e"), i).alias("id"),
        F.struct(
            F.concat(F.col("event_type"), F.lit(" "), i).alias("title"),
            F.col("props").alias("description"),
            F.concat(F.lit("Channel "), F.col("user_id").cast("string")).alias("channelTitle"),
            F.concat(F.lit("UC"), F.col("user_id").cast("string")).alias("channelId"),
            F.col("event_type").alias("categoryId"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
            F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("tag"))).alias("tags"),
        ).alias("snippet"),
        F.struct(
            F.concat(F.lit("PT"), F.floor(F.col("event_id") % 70).cast("string"), F.lit("M"), (F.col("event_id") % 60).cast("string"), F.lit("S")).alias("duration")
        ).alias("contentDetails"),
        F.struct(
            v.cast("string").alias("viewCount"),
            F.when(F.col("event_id") % 5 != 0, F.floor(v / 7).cast("string")).alias("likeCount"),
            F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.floor(v / 11).cast("string")).alias("commentCount"),
        ).alias("statistics"),
    )
    return e.select(
        "event_id", F.concat(F.lit("UC"), F.col("user_id").cast("string")).alias("channel_id"),
        F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"),
    )


CHANNEL_VIDEOS_SQL = """
channel_videos AS (
  SELECT 'UC' || user_id AS channel_id, 'UU' || user_id AS playlist_id, 'e' || event_id AS video_id, event_id, ts,
         CAST(floor(value * 10) AS BIGINT) AS views,
         CASE WHEN event_id % 5 <> 0 THEN CAST(floor(floor(value * 10) / 7) AS BIGINT) ELSE 0 END AS likes,
         CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(floor(floor(value * 10) / 11) AS BIGINT) END AS comments
  FROM events)"""


def urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses plus the video and channel addresses built from their hash."""
    p = table(spark, sf, "pages")
    h = F.md5("url")
    forms = [
        F.col("url"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(h, 1, 11), F.lit("&t=10")),
        F.concat(F.lit("https://youtu.be/"), F.substring(h, 2, 11), F.lit("?si=x")),
        F.concat(F.lit("https://m.youtube.com/shorts/"), F.substring(h, 3, 11), F.lit("/extra")),
        F.substring(h, 1, 11),
        F.concat(F.lit("https://youtu.be/"), F.substring(h, 1, 9)),
        F.concat(F.lit("https://www.youtube.com/@"), F.substring(h, 1, 6)),
        F.concat(F.lit("https://www.youtube.com/channel/UC"), h, F.lit("/videos")),
        F.concat(F.lit("https://www.youtube.com/c/"), F.substring(h, 1, 5)),
        F.concat(F.lit("https://www.youtube.com/user/"), F.substring(h, 1, 7)),
        F.concat(F.lit("UC"), h),
        F.concat(F.lit("@"), F.substring(h, 1, 8)),
        F.concat(F.lit("  not a url "), F.substring(h, 1, 4), F.lit(" ")),
    ]
    return p.select("page_id", F.posexplode(F.array(*forms)).alias("form", "url"))


URLS_SQL = """
urls AS (
  SELECT page_id, unnest(range(13)) AS form, unnest([
    url,
    'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=10',
    'https://youtu.be/' || substr(md5(url), 2, 11) || '?si=x',
    'https://m.youtube.com/shorts/' || substr(md5(url), 3, 11) || '/extra',
    substr(md5(url), 1, 11),
    'https://youtu.be/' || substr(md5(url), 1, 9),
    'https://www.youtube.com/@' || substr(md5(url), 1, 6),
    'https://www.youtube.com/channel/UC' || md5(url) || '/videos',
    'https://www.youtube.com/c/' || substr(md5(url), 1, 5),
    'https://www.youtube.com/user/' || substr(md5(url), 1, 7),
    'UC' || md5(url),
    '@' || substr(md5(url), 1, 8),
    '  not a url ' || substr(md5(url), 1, 4) || ' ']) AS url
  FROM pages)"""


def campaigns(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as campaign rows with two targets."""
    from reelscope.functions.temporal import calendar_parts, season

    l = table(spark, sf, "lineitem")
    parts = calendar_parts(F.col("l_shipdate").cast("timestamp"))
    return l.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("row_id"),
        F.col("l_returnflag").alias("source_dataset"),
        season(parts["month"]).alias("campaign"),
        F.col("l_linestatus").alias("channel"),
        F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string")).alias("device"),
        F.concat(F.lit("t"), (F.col("l_partkey") % 5).cast("string")).alias("ad_type"),
        F.concat(F.lit("a"), (F.col("l_linenumber")).cast("string")).alias("age"),
        F.lit("unknown").alias("gender"),
        F.lit("unknown").alias("city"),
        F.col("l_orderkey").cast("double").alias("campaign_numeric_id"),
        F.col("l_partkey").cast("double").alias("ad_numeric_id"),
        F.col("l_quantity").alias("interest"),
        parts["month"].cast("double").alias("month"),
        parts["iso_weekday"].cast("double").alias("weekday"),
        (F.col("l_discount") + 0.001).alias("ctr_prior"),
        (F.col("l_tax") + 0.001).alias("cvr_prior"),
        F.least(F.col("l_extendedprice") / 1000.0, F.lit(100.0)).alias("paid_performance_score"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 200.0).alias("cpm"),
    )


ADS_SQL = """
ads AS (
  SELECT v.video_id AS ad_id, v.title, v.description, v.title || ' ' || v.description AS text, v.published_at,
         v.duration_seconds, v.views,
         ln(1 + v.views) AS log_viewCount,
         (v.duration_seconds + 3) / 150.0::DOUBLE AS skip_rate,
         (v.budget - 5) / 120.0::DOUBLE AS full_watch_rate,
         length(v.title || ' ' || v.description) AS text_len
  FROM videos v)"""


def ads(spark: SparkSession, sf: str) -> DataFrame:
    """Advertisement table; the two rates deliberately leave [0, 1]."""
    text = F.concat_ws(" ", "title", "description")
    return videos(spark, sf).select(
        F.col("video_id").alias("ad_id"), "title", "description", text.alias("text"), "published_at",
        "duration_seconds", "views",
        F.log1p("views").alias("log_viewCount"),
        ((F.col("duration_seconds") + 3) / 150.0).alias("skip_rate"),
        ((F.col("budget") - 5) / 120.0).alias("full_watch_rate"),
        F.length(text).alias("text_len"),
    )
