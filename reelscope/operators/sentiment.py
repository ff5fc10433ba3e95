"""Comment sentiment: word-list scores per comment, roll-ups per video."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions import text as T
from reelscope.functions.numeric import clip
from reelscope.functions.terms import TermIndex
from reelscope.operators import messages as msg
from reelscope.operators.dedup import top_per_group

_INDEX = TermIndex({"pos": fv.SENTIMENT_POSITIVE_TERMS, "neg": fv.SENTIMENT_NEGATIVE_TERMS})
_POSITIVE = "|".join(re.escape(t) for t in fv.SENTIMENT_POSITIVE_TERMS)
_WINDOW = 4


def _whole(words) -> str:
    return "(?<![^ ])(?:" + "|".join(words) + ")(?![^ ])"


def written_comments(df: DataFrame) -> DataFrame:
    """All comments that are not blank."""
    return df.where(T.strip("text") != "")


def cap_comments(df: DataFrame, n: int, video="video_id", order="position") -> DataFrame:
    """First n non-blank comments per video in arrival order."""
    return top_per_group(written_comments(df), [video], [F.col(order).asc()], n).drop("rank")


def negated_positives(clean: Column) -> Column:
    """Negators followed by a positive term within the next four words."""
    contexts = F.regexp_extract_all(
        clean, F.lit(_whole(fv.SENTIMENT_NEGATORS) + r"(?=((?: [^ ]+){0," + str(_WINDOW) + "}))"), F.lit(1)
    )
    return F.size(F.filter(contexts, lambda c: c.rlike(_POSITIVE)))


def score_comments(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``score_raw``, ``score`` (three decimals), ``label`` and ``text500``, the start of the text for display; the score reads all of it."""
    base = df.withColumn("_c", T.sentiment_clean(text)).withColumn("_f", _INDEX.scan("_c"))
    base = base.withColumns(
        {
            "_p": _INDEX.hits("_f", "pos"),
            "_n": _INDEX.hits("_f", "neg"),
            "_k": negated_positives(F.col("_c")),
            "_i": F.regexp_count("_c", F.lit(_whole(fv.SENTIMENT_INTENSIFIERS))),
        }
    )
    pos = F.greatest(F.col("_p") - F.col("_k"), F.lit(0))
    neg = F.col("_n") + F.col("_k")
    raw = (pos - neg) * (F.lit(1.0) + F.col("_i") * 0.3)
    score = F.when(F.col("_c") == "", F.lit(0.0)).otherwise(clip(raw / F.greatest(pos + neg, F.lit(1)), -1.0, 1.0))
    return (
        base.withColumn("score_raw", score)
        .withColumns(
            {
                "score": F.round("score_raw", 3),
                "label": comment_label(F.col("score_raw")),
                "text500": F.substring(T.strip(text), 1, 500),
            }
        )
        .drop("_c", "_f", "_p", "_n", "_k", "_i")
    )


def comment_label(score: Column) -> Column:
    return (
        F.when(score > 0.2, F.lit("positivo")).when(score < -0.2, F.lit("negativo")).otherwise(F.lit("neutro"))
    )


def sentiment_summary(scored: DataFrame, video: str = "video_id") -> DataFrame:
    """Per video: counts, shares, mean score and dominant label."""
    n = F.count("*")

    def pct(c):
        return F.round(F.col(c) / F.col("total") * 100, 1)

    pos, neg, neu = F.col("positivos"), F.col("negativos"), F.col("neutros")
    return (
        scored.groupBy(video)
        .agg(
            n.alias("total"),
            F.count_if(F.col("label") == "positivo").alias("positivos"),
            F.count_if(F.col("label") == "neutro").alias("neutros"),
            F.count_if(F.col("label") == "negativo").alias("negativos"),
            # Scores carry three decimals: summing whole thousandths makes the mean independent of row order.
            (F.sum(F.round(F.col("score") * 1000).cast("bigint")) / 1000.0).alias("_sum"),
        )
        .withColumns(
            {
                "pct_positivo": pct("positivos"),
                "pct_neutro": pct("neutros"),
                "pct_negativo": pct("negativos"),
                "score_promedio": F.round(F.col("_sum") / F.col("total"), 3),
                "sentimiento_dominante": F.when(neu >= F.greatest(pos, neg), F.lit("neutro"))
                .when(pos >= neg, F.lit("positivo"))
                .otherwise(F.lit("negativo")),
                "warning": F.lit(""),
            }
        )
        .drop("_sum")
    )


def with_empty_sentiment(df: DataFrame) -> DataFrame:
    """Defaults for videos that had no comment (after a left join with the summary)."""
    zeros = ("total", "positivos", "neutros", "negativos")
    shares = ("pct_positivo", "pct_neutro", "pct_negativo", "score_promedio")
    return df.withColumns(
        {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in zeros}
        | {c: F.coalesce(c, F.lit(0.0)) for c in shares}
        | {
            "sentimiento_dominante": F.coalesce("sentimiento_dominante", F.lit("neutro")),
            "warning": F.coalesce("warning", F.lit(msg.NO_COMMENTS)),
        }
    )


def top_words(scored: DataFrame, keys=("label",), n: int = 20, text: str = "text", extra_stopwords=()) -> DataFrame:
    """Most frequent content tokens of the whole texts per group; ties alphabetically."""
    tokens = scored.select(*keys, F.explode(T.content_tokens(text, extra_stopwords)).alias("word"))
    counts = tokens.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return top_per_group(counts, list(keys), [F.col("n").desc(), F.col("word").asc()], n)


def top_n_per_label(scored: DataFrame, n: int = 3, video="video_id", order="position") -> DataFrame:
    """Example comments: positive by score down, negative by score up, neutral by arrival."""
    strength = (
        F.when(F.col("label") == "positivo", -F.col("score"))
        .when(F.col("label") == "negativo", F.col("score"))
        .otherwise(F.lit(0.0))
    )
    ranked = scored.withColumn("_o", strength)
    return top_per_group(ranked, [video, "label"], [F.col("_o").asc(), F.col(order).asc()], n).drop("_o")
