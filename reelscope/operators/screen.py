"""On-screen text: per-frame lines to per-video roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions import text as T
from reelscope.functions.terms import TermIndex
from reelscope.operators import messages as msg
from reelscope.operators.dedup import clean_lines, containment_dedup, fuzzy_line_dedup

_FLAGS = TermIndex(
    {"cta": fv.CTA_TERMS, "promo": fv.PROMO_TERMS, "trust": fv.TRUST_TERMS, "urgency": fv.URGENCY_TERMS}
)


def frame_lines(frames: DataFrame, *, fuzzy: bool = False) -> DataFrame:
    """Cleaned and de-duplicated lines of every frame (in the row, no shuffle)."""
    cleaned = frames.withColumn("lines", clean_lines("lines"))
    return cleaned.withColumn("lines", fuzzy_line_dedup("lines") if fuzzy else containment_dedup("lines"))


def density_class(n_words: Column) -> Column:
    return (
        F.when(n_words == 0, F.lit("sin_texto"))
        .when(n_words < 10, F.lit("baja"))
        .when(n_words < 35, F.lit("media"))
        .otherwise(F.lit("alta"))
    )


def video_text(frames: DataFrame, video: str = "video_id") -> DataFrame:
    """Per video: frames, frames with text, coverage, confidence, engines, and its lines in order of first appearance.

    One pass over the frames: a frame becomes a row for each line (one row if it has none), and its own facts count on
    the first of them. Copies of a line collapse before the shuffle; what is collected per video is the set of different
    lines of its sampled frames.
    """
    rows = frames.select(video, "engine", "ts", "presence", "confidence", F.posexplode_outer("lines").alias("pos", "line"))
    head = F.coalesce(F.col("pos"), F.lit(0)) == 0
    sure = head & (F.col("confidence") > 0)
    per_line = rows.groupBy(video, "engine", F.lower("line").alias("low")).agg(
        F.count_if(head).alias("n"),
        F.count_if(F.col("pos") == 0).alias("with_text"),
        F.count_if(head & F.coalesce("presence", F.lit(False))).alias("present"),
        F.count_if(sure).alias("conf_n"),
        F.sum(F.when(sure, F.col("confidence")).otherwise(F.lit(0.0))).alias("conf_sum"),
        F.min(F.when(F.col("line").isNotNull(), F.struct("ts", "pos", "line"))).alias("first"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "with_text", "present", "conf_n", "conf_sum")]
    per_engine = per_line.groupBy(video, "engine").agg(*sums, F.collect_list("first").alias("firsts"))
    # One row per engine name from here on.
    engines = F.sort_array(F.collect_list(F.struct("engine", "n")))
    rolled = per_engine.groupBy(video).agg(
        F.sum("n").alias("ocr_frame_count"),
        F.sum("with_text").alias("ocr_frames_with_text"),
        F.sum("present").alias("_present"),
        F.sum("conf_n").alias("_cn"),
        F.sum("conf_sum").alias("_cs"),
        F.map_from_entries(engines).alias("ocr_engine_counts"),
        F.min_by("engine", F.struct(-F.col("n"), F.col("engine"))).alias("ocr_engine"),
        F.flatten(F.collect_list("firsts")).alias("_firsts"),
    )
    return rolled.withColumns(
        {
            "ocr_frame_coverage": F.round(F.col("ocr_frames_with_text") / F.col("ocr_frame_count"), 3),
            "_conf": F.when(F.col("_cn") > 0, F.col("_cs") / F.col("_cn")).otherwise(F.lit(0.0)),
            "ocr_text_presence_detected": F.col("_present") > 0,
            "lines": F.transform(F.array_sort("_firsts"), lambda f: f["line"]),
        }
    ).withColumn("ocr_confidence_avg", F.round("_conf", 2)).drop("_present", "_cn", "_cs", "_firsts")


def ocr_rollup(frames: DataFrame, video: str = "video_id", *, fuzzy: bool = False) -> DataFrame:
    """Per-video summary of (ts, lines, engine, confidence, presence) frames."""
    kept = fuzzy_line_dedup("lines") if fuzzy else containment_dedup("lines")
    joined = video_text(frame_lines(frames, fuzzy=fuzzy), video)
    joined = joined.withColumn("ocr_text", T.text(F.array_join(kept, " "))).drop("lines")
    joined = joined.withColumns({"ocr_word_count": T.token_count("ocr_text"), "_f": _FLAGS.scan("ocr_text")})
    n = F.col("ocr_word_count")
    low = (n > 0) & (F.col("_conf") < 52)
    warning = (
        F.when(F.col("ocr_text") != "", F.when(low, F.lit(msg.OCR_LOW_CONFIDENCE)).otherwise(F.lit("")))
        .when(F.col("ocr_text_presence_detected"), F.lit(msg.OCR_UNREADABLE))
        .otherwise(F.lit(msg.OCR_NONE))
    )
    return joined.withColumns(
        {
            "ocr_low_confidence": low,
            "visual_text_density": density_class(n),
            "ocr_ok": F.col("ocr_text") != "",
            "ocr_warning": warning,
            "ocr_cta_flag": _FLAGS.any("_f", "cta"),
            "ocr_promo_flag": _FLAGS.any("_f", "promo"),
            "ocr_trust_flag": _FLAGS.any("_f", "trust"),
            "ocr_urgency_flag": _FLAGS.any("_f", "urgency"),
            "ocr_excess_text_flag": (n > 35).cast("int"),
        }
    ).drop("_f", "_conf")


def first_text(frames: DataFrame, video: str = "video_id") -> DataFrame:
    """First readable line per video by time and position (placeholder lines skipped)."""
    lines = frames.select(video, "ts", F.posexplode("lines").alias("pos", "line")).withColumn("line", T.strip("line"))
    readable = lines.where((F.col("line") != "") & ~F.lower("line").startswith("[texto detectado"))
    return readable.groupBy(video).agg(F.min_by("line", F.struct("ts", "pos")).alias("ocr_first_result"))
