"""Substring joins: terms of one table inside texts of another, by one automaton of all terms or, where that would be too
large, through the rarest gram of each term as an equality key."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.session import few, materialize

#: Characters of a gram. A shorter term is its own gram.
GRAM = 4
#: So many terms at most, of TERM_CHARS characters each at most, go to every task; a larger table is shuffled.
SENT_TERMS, TERM_CHARS = 200_000, 200
#: UTF-8 bytes of the different terms of an automaton at most: a worker holds about 50 bytes for each of them.
AUTOMATON_BYTES = 4_000_000


@lru_cache(1)
def _automaton(words: Broadcast):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, w in enumerate(words.value):
        out.add_word(w.decode("latin-1"), i)
    out.make_automaton()
    return out


def finder(spark: SparkSession, words: list[bytes]):
    """UDF text as bytes -> the different words that stand in it; the text is read once. Bytes are searched, as ``contains`` does."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("array<binary>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found, names = _automaton(shared), shared.value
        for texts in batches:
            yield texts.map(lambda t: [names[i] for i in {i for _, i in found.iter(t.decode("latin-1"))}] if t else [])

    return find


def grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text, in linear time; line breaks count as characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def all_grams(text: Column, sizes: list[int]) -> Column:
    return F.flatten(F.array(*[grams(text, n) for n in sizes])) if sizes else F.expr("cast(array() as array<string>)")


def rarest_grams(terms: DataFrame, texts: DataFrame, term: str, text: str, sizes: list[int]) -> DataFrame:
    """The terms with ``_gram``, the one of their grams that the fewest texts hold; terms with a gram no text holds go.

    Texts are counted per gram before the shuffle, so it carries the different grams of a task, not those of a text.
    """
    held = materialize(texts.select(F.explode(all_grams(F.col(text), sizes)).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_n")))
    n = F.length(term)
    own = F.when(n < GRAM, F.array(term)).otherwise(grams(F.col(term), GRAM))
    parts = terms.withColumns({"_grams": F.size(own), "_gram": F.explode(own)})
    best = parts.join(held, "_gram").groupBy(*terms.columns, "_grams").agg(F.count("*").alias("_held"), F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    return best.where("_held = _grams").drop("_held", "_grams")


def substring_join(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(key, columns of ``terms``): a row for each text and each row of ``terms`` whose term stands in the text.

    Null and empty terms and null texts match nothing; case counts; repeated rows of either table give repeated rows. A
    text gives each of its terms once, so no pair is found twice. Up to ``SENT_TERMS`` rows of terms, of ``AUTOMATON_BYTES``
    in all, are one automaton in every task, which reads a text once. A larger table meets a text through one gram of
    each term: up to ``SENT_TERMS`` are sent to the tasks, which look the grams of a text up where it stands: no text is
    shuffled. More terms are joined by gram with narrow rows (gram, id of the text), and only the texts with a candidate
    are fetched again, one row for each text with its candidates.
    """
    if not {key, text}.isdisjoint(terms.columns):
        raise ValueError(f"{key} and {text} must not be columns of the terms")
    terms = materialize(terms.where(F.length(term) > 0))
    base = texts.select(F.col(key).alias(key), F.col(text).alias("_text"))
    words = terms.select(F.col(term).alias("_term")).distinct()
    if few(terms, SENT_TERMS):
        total = words.agg(F.sum(F.octet_length("_term"))).first()[0]
        if total is None:
            return base.join(F.broadcast(terms), F.lit(False)).select(key, *terms.columns)
        if total <= AUTOMATON_BYTES:
            find = finder(texts.sparkSession, [bytes(r[0]) for r in words.select(F.col("_term").cast("binary")).collect()])
            found = base.select(key, F.explode(find(F.col("_text").cast("binary"))).alias("_word")).select(key, F.col("_word").cast("string").alias("_term"))
            return found.join(F.broadcast(terms), found["_term"] == terms[term]).select(key, *terms.columns)
    base = base.where("_text is not null")
    lengths = [r[0] for r in terms.select(F.least(F.length(term), F.lit(GRAM))).distinct().collect()]  # GRAM rows at most
    keyed = materialize(rarest_grams(words, base, "_term", "_text", sorted(lengths)))
    facts = keyed.join(terms, keyed["_term"] == terms[term]).select("_gram", "_term", *(terms[c] for c in terms.columns))
    wide = keyed.where(F.length("_term") > TERM_CHARS).limit(1).count() == 1
    if few(facts, SENT_TERMS) and not wide:
        rows = base.select(key, "_text", F.explode(all_grams(F.col("_text"), sorted(lengths))).alias("_gram"))
        found = rows.join(F.broadcast(facts), "_gram").where(F.col("_text").contains(F.col("_term")))
        return found.select(key, *terms.columns)
    # equal rows of the texts are counted, so that a row's own hash names it
    own = F.struct(F.xxhash64(key, "_text").alias("a"), F.xxhash64("_text", key).alias("b"))
    named = base.groupBy(own.alias("_id"), key, "_text").agg(F.count("*").cast("int").alias("_copies"))
    named = materialize(named)
    rows = named.select("_id", F.explode(all_grams(F.col("_text"), sorted(lengths))).alias("_gram"))
    met = rows.join(keyed, "_gram").select("_id", "_term")
    found = met.join(named, "_id").where(F.col("_text").contains(F.col("_term"))).select(key, "_copies", "_term")
    out = found.join(terms, found["_term"] == terms[term]).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
    return out.select(key, *(terms[c] for c in terms.columns))
