"""Preference formatting: shared turns become the prompt, the rest two completions with loss masks. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NEXT, CLOSE = "<|", "|>\n", "<|end|>\n"


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), plain(turn["role"]), F.lit(NEXT))


def body(turn: Column) -> Column:
    return F.concat(plain(turn["text"]), F.lit(CLOSE))


def plain(c: Column) -> Column:
    """Null as empty; a marker inside a text is broken up, so that markers only ever come from the format."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit(OPEN), F.lit("< |"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t))), "")


def trained_spans(turns: Column) -> Column:
    """Character ranges [a, b) of the rendered turns that count in the loss: text and end mark of assistant turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def add(s, t):
        a = s["at"] + F.length(head(t))
        b = a + F.length(body(t))
        span = F.array(F.struct(a.alias("a"), b.alias("b")))
        return F.struct(b.alias("at"), F.when(t["role"].eqNullSafe(F.lit("assistant")), F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest prefix of equal turns (role and text; nulls are equal)."""
    n = F.least(F.size(chosen), F.size(rejected))
    odd = F.zip_with(F.slice(chosen, F.lit(1), n), F.slice(rejected, F.lit(1), n), lambda x, y: ~(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])))
    first = F.array_position(odd, True)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace two arrays of turns (role, text) by prompt, chosen, rejected and the ranges of both that are trained on.

    ``n_common`` turns are shared and rendered once, as ``prompt``; ``chosen_spans`` and ``rejected_spans`` are character
    ranges of the completions; ``usable`` tells that both completions train on something. A missing conversation is one
    without turns; equal conversations leave two empty completions; null roles and texts render as empty. All other
    columns stay, but for those with the names of the new ones.
    """
    none = F.array().cast(pairs.schema[chosen].dataType)
    both = pairs.withColumns({"_c": F.coalesce(F.col(chosen), none), "_r": F.coalesce(F.col(rejected), none)})
    both = both.withColumn("n_common", common_turns(F.col("_c"), F.col("_r")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    both = both.withColumns({"prompt": rendered(F.slice("_c", 1, F.col("n_common"))), "_c": rest("_c"), "_r": rest("_r")})
    both = both.withColumns({chosen: rendered(F.col("_c")), rejected: rendered(F.col("_r")), "chosen_spans": trained_spans(F.col("_c")), "rejected_spans": trained_spans(F.col("_r"))})
    return both.withColumn("usable", (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0)).drop("_c", "_r")


def conversations_of(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turns) in the order of turn, then role and text; turns without a conversation id belong to none.

    One row holds a whole conversation, as any rendering of it must.
    """
    each = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.where(F.col(conv_id).isNotNull()).groupBy(conv_id).agg(each.alias("turns"))
