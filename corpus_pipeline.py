"""Training-data pipeline over ``documents``: language, near-duplicates, benchmark leaks, source mix, shards.

Every stage takes (spark, docs, sf_dir) and works on all rows the one before kept; all but the last return the columns of
``documents``. Nulls, empty texts, repeated rows and empty tables pass through each stage as its operator defines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.llm import language_id, mixing, near_copies, sharding
from reelscope.llm.common import utf8
from reelscope.llm.decontaminate import decontaminate
from reelscope.session import drop_stages, few, materialize, stages_made, table

#: Intermediates of the stage called last. The next stage reads what that one wrote, so they are deleted then.
_LEFT: list[str] = []


def _stage(build: Callable) -> Callable:
    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stages(spark, _LEFT)
        before = set(stages_made())
        out = build(spark, docs, sf_dir)
        _LEFT[:] = [p for p in stages_made() if p not in before]
        return out

    return run_stage


def row_id() -> Column:
    """The doc_id; for a null one a number from the text, above all usual ids, so that equal texts share it."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and, in ``_doc``, all others, so that no column of the caller meets one that a stage makes."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, (F.struct(*rest) if rest else F.lit(None)).alias("_doc"))


def unpacked(df: DataFrame, columns: list[str], own: dict[str, Column]) -> DataFrame:
    """The caller's columns in their order; ``own`` has those that were not packed."""
    return df.select(*(own[c].alias(c) if c in own else F.col("_doc").getField(c).alias(c) for c in columns))


@_stage
def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in a language that the labelled ones teach; null texts and texts without a letter go."""
    model = language_id.train(docs.select("doc_id", "text", "lang"), ~language_id.held_out())
    kept = language_id.identify(packed(docs, "text"), model).where(F.col("lang_pred") != "und")
    return unpacked(kept, docs.columns, {"text": F.col("text")})


@_stage
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, similarity 0.8 or more): the one with the smallest id.

    Survivors are chosen on narrow rows; the texts are shuffled once, by a row's own id, and equal rows collapse before.
    """
    own = F.xxhash64("doc_id", "text")  # rows that share a doc_id may hold different texts
    kept = near_copies.survivors(docs, F.struct(row_id().alias("doc"), own.alias("own")))
    rows = docs.select(own.alias("_own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    one = rows.groupBy("_own").agg(F.first("_doc").alias("_doc"))
    return unpacked(one.join(kept.select(F.col("doc_id.own").alias("_own")), "_own", "left_semi"), docs.columns, {})


@_stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out of the texts; a document that is mostly such passages goes."""
    out = decontaminate(packed(docs, "text"), table(spark, sf_dir, "benchmark")).where("not dropped")
    chars = F.when(F.col("n_hit") > 0, F.length("clean_text")).otherwise(F.col("_doc.n_chars")).cast("long")
    return unpacked(out, docs.columns, {"text": F.col("clean_text"), "n_chars": chars})


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded: 0 to 3 times.

    The mix takes a source's documents in the order of a hash, the first ones once more than the rest: a row for each
    source says up to which hash, and the documents are compared with it where they stand. With many sources the number
    of copies is joined by id instead.
    """
    name = F.md5(row_id().cast("string").cast("binary"))
    taken, _ = mixing.mix(mixing.sized(docs.select(row_id().alias("doc_id"), "source", "text")))
    times = taken.where("size > 0").select("source", F.col("doc_id").alias("id"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times"))
    rows = docs.select(row_id().alias("_id"), F.col("source").cast("string").alias("_source"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), name.alias("_h"))
    least = times.groupBy("source").agg(F.min("times").alias("times"))
    if few(least):
        place = lambda i: F.struct(F.md5(i.cast("string").cast("binary")).alias("h"), i.alias("id"))
        last = times.groupBy("source", "times").agg(F.max(place(F.col("id"))).alias("upto"))
        per = materialize(last.groupBy("source").agg(F.min("times").alias("least"), F.max("times").alias("most"), F.max_by("upto", "times").alias("upto")))
        per = F.broadcast(per.withColumnRenamed("source", "_s"))
        out = rows.where(F.col("_doc.text").rlike(r"[^\x20\x09-\x0D]")).join(per, F.col("_source").eqNullSafe(F.col("_s")))
        n = F.when(F.struct(F.col("_h").alias("h"), F.col("_id").alias("id")) <= F.col("upto"), F.col("most")).otherwise(F.col("least"))
    else:
        out = rows.join(times.groupBy("id").agg(F.max("times").alias("_n")).withColumnRenamed("id", "_id"), "_id")
        n = F.col("_n")
    out = out.withColumn("_n", n).where("_n > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_n"))))
    return unpacked(out, docs.columns, {})


@_stage
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it, and their bytes (these names replace the caller's)."""
    raw = utf8("text")
    key = sharding.text_key(F.col("text"), F.col("doc_id"))
    keyed = docs.select("doc_id", (F.coalesce(F.length(raw), F.lit(0)) + 1).cast("long").alias("_size"), key.alias("_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    out = sharding.shard_by_bytes(keyed)
    cols = [c for c in docs.columns if c.lower() not in ("shard", "slot", "bytes")]
    return out.select(*(F.col("_doc").getField(c).alias(c) for c in cols), "shard", "slot", F.col("_size").alias("bytes"))


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: Fitted languages and hashes of shingles have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; only the last one's files stay."""
    docs, read = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        drop_stages(spark, read)
        read = stages_made()[-1:]
    drop_stages(spark, _LEFT)
    return docs
