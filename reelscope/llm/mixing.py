"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

A source's documents, in the order of a hash, form one stream of words, cut into blocks of equal length. A golden-ratio
sequence runs over [0, 1); each of its points falls into the interval of one source, whose width is the source's share of
the slots. The r-th slot of a source takes the r-th block of its stream, round and round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelscope.llm.common import if_small, plain_words, running_totals, texts_in, utf8
from reelscope.session import materialize

#: The sequence t * STEP mod RING is the golden-ratio sequence in steps of 1 / RING.
RING, STEP = 1 << 31, 1_327_217_885
CELLS = 4096
CHUNK = 1 << 16


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, source, size): the number of words of each whole text, 0 for null."""

    def run(batches):
        for b in batches:
            n = [len(plain_words(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "size"])

    return texts_in(docs).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), utf8(text_col)).mapInArrow(run, "doc_id long, source string, size long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(sno, source, source_size, target, goal): a row for each source, in order of its name, null last.

    Weights repeat along the sources and share all words. A target stops at ``most`` times the source's size and the
    excess goes to the others by weight: sources are filled to one common level, found in order of the level at which
    each is full. goal is the target as a whole number of words.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("sno", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sno") % len(weights) + 1).cast("int")))
    per = per.withColumns({"cap": (most * F.col("source_size")).cast("double"), "total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every)})
    per = per.withColumn("full_at", F.col("cap") / F.col("w"))
    before = every.orderBy("full_at", "sno").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    per = per.withColumn("level", (F.col("total") - gone("cap")) / (F.col("all_w") - gone("w")))
    open_ = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "sno", "level"))
    per = per.withColumn("level", F.min(open_).over(every)["level"])
    per = per.withColumn("target", F.least("cap", F.col("w") * F.col("level")))
    return per.select("sno", "source", "source_size", "target", F.least(F.floor(F.col("target") + 0.5), most * F.col("source_size")).alias("goal"))


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """(slot, sno, rank, block, words): which block each slot takes and how many words of it; the last one may be cut.

    ``plan`` has sno, source_size and goal. Ranks count a source's slots: within chunks of the sequence, then over the
    chunks. A source that the sequence leaves a few slots short gets them at the end; slots beyond its goal fall away.
    """
    spark = plan.sparkSession
    plan = plan.where("goal > 0").withColumns({"blocks": F.expr(f"(source_size + {block - 1}) div {block}"), "passes": F.expr("goal div source_size"), "rest": F.expr("goal % source_size")})
    plan = plan.withColumn("need", F.col("passes") * F.col("blocks") + F.expr(f"(rest + {block - 1}) div {block}"))
    n = plan.agg(F.sum("need")).first()[0] or 0
    upto = F.sum("need").over(Window.partitionBy(F.lit(0)).orderBy("sno"))
    edge = lambda c: F.floor(c.cast("double") / n * RING).cast("long")
    plan = plan.withColumns({"lo": edge(upto - F.col("need")), "hi": edge(upto)}) if n else plan.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long")})
    wide = RING // CELLS
    cells = plan.where("hi > lo").select("sno", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {wide}"), F.expr(f"(hi - 1) div {wide}"))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") % RING * STEP % RING).alias("point"))
    placed = points.withColumn("cell", F.expr(f"point div {wide}")).join(if_small(cells), "cell").where("lo <= point and point < hi")
    placed = placed.select("slot", "sno", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = placed.groupBy("sno", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sno").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    within = F.row_number().over(Window.partitionBy("sno", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("within", within).join(if_small(counts), ["sno", "chunk"]).select("slot", "sno", (F.col("within") + F.col("before")).alias("rank"))
    had = plan.join(counts.groupBy("sno").agg(F.sum("n").alias("had")), "sno", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    short = had.where("had < need").select(F.lit(n).cast("long").alias("slot"), "sno", F.explode(F.sequence("had", F.col("need") - 1)).alias("rank"))
    short = short.withColumn("slot", F.col("slot") + F.col("rank"))
    of = if_small(plan.select("sno", "need", "blocks", "passes", "rest", "source_size"))
    out = ranked.unionByName(short).join(of, "sno").where("rank < need")
    out = out.withColumns({"pass": F.expr("rank div blocks"), "block": F.expr("rank % blocks")})
    stream = F.when(F.expr("pass < passes"), F.col("source_size")).otherwise(F.col("rest"))
    limit = F.least(F.lit(block), stream - F.col("block") * block)
    return out.select("slot", "sno", "rank", "block", limit.cast("long").alias("words"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule) of the mix, given (doc_id, source, size).

    documents: the input's rows with source_size, target and taken, the words the mix takes of the row, repeats counted,
    at most ``most`` times its size. A source's taken words add up to its target, rounded. Rows of size 0 are taken 0
    times; a null source is a source; a null doc_id is hashed as such; repeated rows are separate; no rows, no slots. A
    source of any size is spread over tasks: positions come from slices of the hash order, and blocks are join keys.
    """
    base = materialize(sizes.select("doc_id", "source", "size", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h")))
    plan = materialize(targets(base, weights, most))
    named = base.join(if_small(plan.select("sno", F.col("source").alias("_s"))), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    at = materialize(running_totals(named, ["sno"], ["h", "doc_id", "size"], ["size"]).withColumnRenamed("size_before", "start"))
    slots = materialize(schedule(plan, block))
    parts = at.where("size > 0").select("sno", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    first = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    length = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    parts = parts.select("sno", "start", "block", first.alias("first"), length.alias("length"))
    got = parts.join(slots.select("sno", "block", "words"), ["sno", "block"]).groupBy("sno", "start")
    got = got.agg(F.sum(F.greatest(F.lit(0), F.least("length", F.col("words") - F.col("first")))).alias("taken"))
    got = got.select(F.col("sno").alias("_n"), F.col("start").alias("_at"), "taken")
    out = at.join(got, (at.sno == got._n) & (at.start == got._at) & (at.size > 0), "left")
    out = out.join(if_small(plan.select(F.col("sno").alias("_p"), "source_size", "target")), F.col("sno") == F.col("_p"))
    docs = out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return docs, slots.join(if_small(plan.select("sno", "source")), "sno").select("slot", "source", "rank", "block", "words")
