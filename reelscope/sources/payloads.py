"""Landed API responses and pasted text to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.functions import text as T
from reelscope.functions.numeric import col

CHANNEL_SCHEMA = """items array<struct<
    id:string,
    snippet:struct<title:string,description:string,customUrl:string,publishedAt:string,
                   thumbnails:struct<high:struct<url:string>>>,
    statistics:struct<subscriberCount:string,hiddenSubscriberCount:boolean,viewCount:string,videoCount:string>,
    contentDetails:struct<relatedPlaylists:struct<uploads:string>>>>"""
UPLOADS_SCHEMA = "items array<struct<contentDetails:struct<videoId:string>>>"
VIDEO_SCHEMA = """items array<struct<
    id:string,
    snippet:struct<title:string,description:string,channelTitle:string,channelId:string,categoryId:string,
                   publishedAt:string,tags:array<string>>,
    contentDetails:struct<duration:string>,
    statistics:struct<viewCount:string,likeCount:string,commentCount:string>>>"""
COMMENT_SCHEMA = "items array<struct<snippet:struct<topLevelComment:struct<snippet:struct<textDisplay:string>>>>>"


def to_int(value) -> Column:
    return F.coalesce(col(value).try_cast("bigint"), F.lit(0).cast("bigint"))


def _or_blank(value) -> Column:
    return F.coalesce(col(value), F.lit(""))


def _items(df: DataFrame, payload: str, schema: str, keep) -> DataFrame:
    parsed = df.select(*keep, F.from_json(payload, schema)["items"].alias("items"))
    return parsed.select(*keep, F.posexplode("items").alias("position", "item"))


def flatten_channel_payload(df: DataFrame, payload: str = "payload", channel: str = "channel_id") -> DataFrame:
    """First item of every channel response as a flat row; payloads without items give no row."""
    first = F.get(F.from_json(payload, CHANNEL_SCHEMA)["items"], F.lit(0))
    item = df.select(F.col(channel), first.alias("i")).where(F.col("i").isNotNull())
    return item.select(
        F.col(channel),
        _or_blank("i.snippet.title").alias("channel_title"),
        _or_blank("i.snippet.description").alias("channel_description"),
        _or_blank("i.snippet.customUrl").alias("channel_custom_url"),
        _or_blank("i.snippet.publishedAt").alias("channel_published_at"),
        _or_blank("i.snippet.thumbnails.high.url").alias("channel_thumbnail"),
        to_int("i.statistics.subscriberCount").alias("subscriber_count"),
        F.coalesce("i.statistics.hiddenSubscriberCount", F.lit(False)).alias("hidden_subscriber_count"),
        to_int("i.statistics.viewCount").alias("channel_view_count"),
        to_int("i.statistics.videoCount").alias("channel_video_count"),
        F.col("i.contentDetails.relatedPlaylists.uploads").alias("uploads_playlist_id"),
        F.concat(F.lit("https://www.youtube.com/channel/"), F.col(channel)).alias("channel_url"),
    )


def flatten_uploads_payload(df: DataFrame, payload: str = "payload", playlist: str = "playlist_id") -> DataFrame:
    """(playlist, position, video id) of landed upload lists."""
    rows = _items(df, payload, UPLOADS_SCHEMA, [playlist])
    return rows.select(playlist, "position", F.col("item.contentDetails.videoId").alias("video_id")).where(
        F.coalesce("video_id", F.lit("")) != ""
    )


def flatten_video_payload(df: DataFrame, payload: str = "payload", keep=()) -> DataFrame:
    """One row per video of a statistics response, with public engagement."""
    rows = _items(df, payload, VIDEO_SCHEMA, list(keep))
    v, l, c = (to_int(f"item.statistics.{x}") for x in ("viewCount", "likeCount", "commentCount"))
    return rows.select(
        *keep,
        F.col("item.id").alias("video_id"),
        _or_blank("item.snippet.title").alias("title"),
        _or_blank("item.snippet.publishedAt").alias("published_at"),
        v.alias("views"),
        l.alias("likes"),
        c.alias("comments"),
        F.when(v != 0, F.round((l + c) / v, 4)).otherwise(F.lit(0.0)).alias("engagement_public"),
    )


def flatten_video_metadata(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Full metadata rows: texts, tags, channel, ISO duration in seconds, counters."""
    rows = _items(df, payload, VIDEO_SCHEMA, [])
    s, k = "item.snippet", "item.statistics"
    channel = _or_blank(f"{s}.channelId")
    return rows.select(
        F.col("item.id").alias("video_id"),
        _or_blank(f"{s}.title").alias("title"),
        _or_blank(f"{s}.description").alias("description"),
        _or_blank(f"{s}.channelTitle").alias("channel_title"),
        channel.alias("channel_id"),
        F.concat(F.lit("https://www.youtube.com/channel/"), channel).alias("channel_url"),
        _or_blank(f"{s}.categoryId").alias("category_id"),
        _or_blank(f"{s}.publishedAt").alias("published_at"),
        F.coalesce(f"{s}.tags", F.expr("cast(array() as array<string>)")).alias("tags"),
        _or_blank("item.contentDetails.duration").alias("duration_iso"),
        T.iso_duration_seconds("item.contentDetails.duration").alias("duration_seconds"),
        to_int(f"{k}.viewCount").alias("views"),
        to_int(f"{k}.likeCount").alias("likes"),
        to_int(f"{k}.commentCount").alias("comments"),
    )


def flatten_comment_payload(df: DataFrame, payload: str = "payload", video: str = "video_id") -> DataFrame:
    rows = _items(df, payload, COMMENT_SCHEMA, [video])
    return rows.select(video, "position", _or_blank("item.snippet.topLevelComment.snippet.textDisplay").alias("text"))


def split_manual_comments(df: DataFrame, text: str = "text", video: str = "video_id") -> DataFrame:
    """One row per non-blank line of pasted text, numbered over the kept lines."""
    # str.splitlines boundaries, spelled out.
    lines = F.split(T.text(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    kept = F.filter(F.transform(lines, T.strip), lambda s: s != "")
    return df.select(F.col(video), F.posexplode(kept).alias("position", "text"))
