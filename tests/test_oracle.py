"""Registered queries against their SQL; all of them with ALL_QUERIES=1, a cross-section otherwise."""

import os

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SOME = (
    "word_count", "lexicon_flags", "relevance_tokens", "engagement", "frame_timestamps", "corpus_features", "policy_risk", "comment_score",
    "top_words", "script_quality", "dedup_latest", "stratified_split", "profile_stats", "organic_score_label", "roc_auc", "group_metrics",
    "psi", "frame_motion", "channel_reach", "hybrid_score", "dynamic_cpm", "final_action",
    "read_transcripts", "pattern_terms", "video_with_signals",
)
ORACLES = contract.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert compare(got, duck.execute(ORACLES[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
