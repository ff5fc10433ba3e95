"""Substring joins against plain containment, on both routes."""

import pytest
from pyspark.sql import functions as F

from reelscope.operators import policy, substring_join


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sent", [substring_join.SENT_TERMS, 0])
def test_matches_plain_containment(spark, monkeypatch, sent):
    monkeypatch.setattr(substring_join, "SENT_TERMS", sent)
    texts = [(1, "the red fox\nand the hen"), (2, "año nuevo, vida nueva"), (2, "año nuevo, vida nueva"), (3, ""), (4, None), (None, "red red red"), (5, "aaaaaaaa"), (6, "x" * 50_000 + "fox")]
    terms = [("a", "red"), ("b", "red"), ("a", "fox\nand"), ("a", "ño"), ("a", "vida nueva"), ("a", "a"), ("a", "aaaa"), ("a", "aaaab"), ("a", ""), ("a", None), (None, "fox"), ("c", "Red"), ("a", "x" * 300)]
    got = policy.lexicon_match(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame([*terms, terms[0]], "category string, term string"))
    want = [(k, c, w) for k, t in texts for c, w in terms if t and w and w in t]
    assert found(got) == sorted(want, key=str)
    none = spark.createDataFrame([], "category string, term string")
    assert policy.lexicon_match(spark.createDataFrame(texts, "k long, t string"), "k", "t", none).count() == 0
    assert policy.lexicon_match(spark.createDataFrame([], "k long, t string"), "k", "t", spark.createDataFrame(terms, "category string, term string")).count() == 0


def test_lexicon_of_100_000_terms(spark):
    terms = spark.range(100_000).select(F.lit("n").alias("category"), F.concat(F.lit("term "), "id", F.lit(".")).alias("term"))
    texts = spark.range(300).select("id", F.concat(F.lit("a text with term "), F.col("id") * 7, F.lit(". and term "), F.col("id") + 90_000, F.lit(".")).alias("t"))
    got = policy.lexicon_match(texts, "id", "t", terms)
    want = [(i, f"term {n}.") for i in range(300) for n in {7 * i, i + 90_000}]
    assert found(got.select("id", "term")) == sorted(want, key=str)


@pytest.mark.parametrize("sent, size", [(substring_join.SENT_TERMS, substring_join.AUTOMATON_BYTES), (substring_join.SENT_TERMS, 3), (0, 0)])
def test_every_route_finds_the_same(spark, monkeypatch, sent, size):
    """One automaton, grams sent to the tasks, grams joined: also with bytes that are no UTF-8, and terms inside terms."""
    monkeypatch.setattr(substring_join, "SENT_TERMS", sent)
    monkeypatch.setattr(substring_join, "AUTOMATON_BYTES", size)
    rows = [(1, "the café\x00 opens"), (2, "shers he hers"), (2, "shers he hers"), (3, ""), (4, None), (5, "日本語テキスト 🎬")]
    words = ["he", "she", "hers", "her", "é", "fé\x00", "本語", "🎬", "Ã", "none"]
    bad = spark.sql("SELECT 6L AS k, cast(concat(unhex('ff'), encode('fox hers', 'UTF-8')) AS string) AS t")
    texts = spark.createDataFrame(rows, "k long, t string").union(bad)
    terms = spark.createDataFrame([(w, n) for w in words for n in (1, 2)] + [("he", 1)], "w string, n int")
    got = substring_join.substring_join(texts, "k", "t", terms, "w")
    every = [(w, n) for w in words for n in (1, 2)] + [("he", 1)]
    want = [(k, w, n) for k, t in [*rows, (6, "fox hers")] for w, n in every if t and w in t]
    assert got.columns == ["k", "w", "n"] and found(got) == sorted(want, key=str)
