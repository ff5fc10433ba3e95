"""Advertising-policy screening over whole tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions import text as T
from reelscope.functions.numeric import col, lookup
from reelscope.functions.terms import TermIndex, sql_text
from reelscope.operators import messages as msg
from reelscope.operators.substring_join import substring_join
from reelscope.session import settled


def normalize_policy_text(value) -> Column:
    """Lower case; everything but letters, digits, ``_`` and ``+`` becomes a space."""
    t = F.regexp_replace(F.lower(T.text(value)), r"[^\p{L}\p{N}_+" + T.SPACE + "]", " ")
    return F.trim(F.regexp_replace(t, f"[{T.SPACE}]+", " "))


def lexicon_match(df: DataFrame, key: str, text, lexicon=fv.POLICY_TERMS) -> DataFrame:
    """Long table (key, category, term) of every lexicon entry contained in the text.

    The lexicon is a dict of word lists or a table (category, term) of any size, whose repeated rows count once.
    """
    if isinstance(lexicon, DataFrame):
        entries = lexicon.select("category", "term").distinct()
        return substring_join(df.select(key, col(text).alias("_body")), key, "_body", entries, "term")
    index = TermIndex(lexicon)
    entries = [(i, c, t) for c, terms in index.lists.items() for t in terms for i in [index.terms.index(t)]]
    values = ",".join(f"({i}, {sql_text(c)}, {sql_text(t)})" for i, c, t in entries)
    names = df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS v(term_id, category, term)")
    found = df.select(F.col(key), index.scan(text).alias("f")).select(key, F.explode("f").alias("term_id"))
    # The lexicon side is the literal above: its size is the size of the word lists.
    return found.join(F.broadcast(names), "term_id").select(key, "category", "term")


def docs_without_hits(df: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    return df.join(hits.select(key).distinct(), key, "left_anti")


def severity_lookup(hits: DataFrame, severity=fv.POLICY_SEVERITY, labels=fv.POLICY_LABELS) -> DataFrame:
    c = F.col("category")
    return hits.withColumns({"severity": lookup(c, severity, "medio"), "label": lookup(c, labels, c)})


def risk_level(n_categories: Column, n_high: Column) -> Column:
    return (
        F.when(n_categories == 0, F.lit("bajo"))
        .when(n_high >= 3, F.lit("revisión humana"))
        .when(n_high >= 1, F.lit("alto"))
        .otherwise(F.lit("medio"))
    )


def ad_status(level: Column) -> Column:
    return (
        F.when(level == "bajo", F.lit("apto"))
        .when(level == "medio", F.lit("apto limitado"))
        .when(level == "alto", F.lit("no apto"))
        .otherwise(F.lit("revisión humana"))
    )


def policy_rollup(hits: DataFrame, key: str) -> DataFrame:
    """Per document: categories, terms per category, severe categories, level and status.

    A document meets each lexicon entry at most once, so groups are bounded by the lexicon.
    """
    per_category = severity_lookup(hits).groupBy(key, "category", "label", "severity").agg(
        F.array_sort(F.collect_set("term")).alias("terms")
    )
    rolled = per_category.groupBy(key).agg(
        F.array_sort(F.collect_list("label")).alias("categories"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "terms")))).alias("hits"),
        F.count_if(F.col("severity") == "alto").alias("n_high"),
    )
    level = risk_level(F.size("categories"), F.col("n_high"))
    return rolled.withColumn("policy_risk_level", level).withColumn(
        "youtube_ad_status_estimate", ad_status(F.col("policy_risk_level"))
    )


def policy_risk(
    df: DataFrame, text, has_transcript, *, lexicon=fv.POLICY_TERMS, severity=fv.POLICY_SEVERITY,
    labels=fv.POLICY_LABELS, normalize_terms: bool = False, name: str = "policy",
) -> DataFrame:
    """Adds a struct with level, categories, explanation, status, hits and coverage of the screening.

    ``normalize_terms=True`` applies the text normalisation to the word lists
    as well, so that terms with punctuation can match.
    """
    if normalize_terms:
        lexicon = {c: tuple(_normal_term(t) for t in terms) for c, terms in lexicon.items()}
    index = TermIndex(lexicon)
    spoken = col(has_transcript)
    blank = T.strip(text) == ""
    base = settled(df.withColumn("_f", index.scan(normalize_policy_text(text))).withColumn("_blank", blank))
    hit = {c: index.any("_f", c) == 1 for c in lexicon}
    high = [hit[c].cast("int") for c in lexicon if severity.get(c, "medio") == "alto"]
    base = base.withColumns(
        {
            "_cats": F.array_compact(F.array(*[F.when(hit[c], F.lit(labels.get(c, c))) for c in lexicon])),
            "_high": sum(high[1:], high[0]) if high else F.lit(0),
        }
    )
    base = base.withColumn("_level", risk_level(F.size("_cats"), F.col("_high")))
    entries = F.array(*[
        F.struct(F.lit(labels.get(c, c)).alias("label"), index.words("_f", c).alias("terms")) for c in lexicon
    ])
    level = F.col("_level")
    explanation = (
        F.when(F.col("_blank"), F.lit(msg.POLICY_NO_TEXT))
        .when(
            F.size("_cats") == 0,
            F.when(spoken, F.lit(msg.POLICY_CLEAN)).otherwise(F.lit(msg.POLICY_CLEAN_PARTIAL)),
        )
        .otherwise(
            F.concat(
                F.lit(msg.POLICY_FOUND), F.array_join("_cats", ", "), F.lit("."), lookup(level, msg.POLICY_TAIL, "")
            )
        )
    )
    block = F.struct(
        level.alias("policy_risk_level"),
        F.col("_cats").alias("policy_risk_categories"),
        explanation.alias("policy_explanation"),
        ad_status(level).alias("youtube_ad_status_estimate"),
        F.map_from_entries(F.filter(entries, lambda e: F.size(e["terms"]) > 0)).alias("hits"),
        (F.col("_blank") | ~spoken).alias("partial_evaluation"),
        F.when(F.col("_blank"), F.lit("ninguna"))
        .when(spoken, F.lit("completa"))
        .otherwise(F.lit("parcial_sin_transcripcion"))
        .alias("evaluation_coverage"),
    )
    return base.withColumn(name, block).drop("_f", "_blank", "_cats", "_high", "_level")


def _normal_term(term: str) -> str:
    import re

    return re.sub(r"\s+", " ", re.sub(r"[^\w\s+]", " ", term.lower())).strip()


def human_review_block(reason: str = "") -> Column:
    """Constant struct for items whose policy was not evaluated."""
    return F.struct(
        F.lit("revisión humana").alias("policy_risk_level"),
        F.expr("cast(array() as array<string>)").alias("policy_risk_categories"),
        F.lit(reason or msg.POLICY_NOT_EVALUATED).alias("policy_explanation"),
        F.lit("revisión humana").alias("youtube_ad_status_estimate"),
        F.expr("cast(map() as map<string,array<string>>)").alias("hits"),
    )
