"""Channel payloads, recent uploads and public reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.operators.dedup import top_per_group


def recent_n(videos: DataFrame, n: int = 20, channel: str = "channel_id", published: str = "published_at", ties=("video_id",)) -> DataFrame:
    """Latest n uploads per channel; ``n`` is what the caller asks for."""
    orders = [F.col(published).desc_nulls_last(), *[F.col(t).asc() for t in ties]]
    return top_per_group(videos, [channel], orders, n).drop("rank")


def channel_recent_videos(
    channels: DataFrame, items: DataFrame, videos: DataFrame, n: int = 20
) -> DataFrame:
    """channel -> uploads playlist -> first n items (position) -> video statistics."""
    listed = top_per_group(
        items.where(F.col("video_id").isNotNull()), ["playlist_id"], [F.col("position").asc()], n
    ).drop("rank")
    owned = channels.select("channel_id", F.col("uploads_playlist_id").alias("playlist_id")).join(listed, "playlist_id")
    return owned.join(videos, "video_id")


def channel_reach(recent: DataFrame, channels: DataFrame | None = None, channel: str = "channel_id") -> DataFrame:
    """Per channel: sampled videos, mean and median views, mean likes and comments, engagement, views per subscriber.

    Groups are bounded by the number of recent uploads kept per channel.
    """
    rolled = recent.groupBy(channel).agg(
        F.count("*").alias("videos_sampled"),
        F.round(F.avg("views"), 1).alias("avg_views_recent"),
        F.round(F.median("views"), 1).alias("median_views_recent"),
        F.round(F.avg("likes"), 1).alias("avg_likes_recent"),
        F.round(F.avg("comments"), 1).alias("avg_comments_recent"),
    )
    v = F.col("avg_views_recent")
    engaged = F.round((F.col("avg_likes_recent") + F.col("avg_comments_recent")) / v, 4)
    out = rolled.withColumn(
        "avg_public_engagement_recent", F.when(v != 0, engaged).otherwise(F.lit(0.0))
    )
    if channels is None:
        return out
    joined = out.join(channels.select(channel, "subscriber_count"), channel, "left")
    subs = F.coalesce("subscriber_count", F.lit(0))
    return joined.withColumn(
        "views_per_subscriber_recent", F.when(subs != 0, F.round(v / subs, 4)).otherwise(F.lit(0.0))
    )
