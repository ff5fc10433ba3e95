"""The stateless operators on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reelscope.operators.decision import score_videos
from reelscope.operators.features import feature_table


def score_stream(videos: DataFrame, as_of) -> DataFrame:
    """Features, probability and level per arriving row: projections only, so no state and no watermark.

    Corpus labels need quantiles of the whole corpus and stay batch work.
    """
    return score_videos(feature_table(videos, as_of))
