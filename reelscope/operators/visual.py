"""Frame composition scores from edge points and gray values, rolled up per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.functions import text as T
from reelscope.functions.numeric import clip
from reelscope.operators import messages as msg
from reelscope.operators.ordering import previous_value

FRAME_SCORES = (
    "rule_thirds_score", "golden_ratio_score", "geometric_balance_score", "focal_clarity_score",
    "contrast_score", "brightness_score", "edge_density",
)


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, p: acc + f(p))


def _nearest(cx, cy, lines) -> Column:
    corners = [(x, y) for y in lines for x in lines]
    return F.least(*[F.sqrt(F.pow(cx - x, 2) + F.pow(cy - y, 2)) for x, y in corners])


def frame_scores(frames: DataFrame) -> DataFrame:
    """Composition scores per frame from ``edge_points`` and ``gray`` (one row in, one row out)."""
    e, g = F.col("edge_points"), F.col("gray")
    base = frames.withColumns(
        {
            "_n": F.size(e).cast("double"),
            "_w": F.col("width").cast("double"),
            "_h": F.col("height").cast("double"),
            "_m": F.size(g).cast("double"),
        }
    )
    n, w, h, m = (F.col(c) for c in ("_n", "_w", "_h", "_m"))
    base = base.withColumns(
        {
            "_sx": _sum(e, lambda p: p["x"].cast("double")),
            "_sy": _sum(e, lambda p: p["y"].cast("double")),
            "_sxx": _sum(e, lambda p: p["x"].cast("double") * p["x"]),
            "_syy": _sum(e, lambda p: p["y"].cast("double") * p["y"]),
            "_left": _sum(e, lambda p: (p["x"] < w / 2).cast("double")),
            "_up": _sum(e, lambda p: (p["y"] < h / 2).cast("double")),
            "_g": _sum(g, lambda v: v.cast("double")) / m,
        }
    )
    base = base.withColumns(
        {
            "_gv": _sum(g, lambda v: F.pow(v - F.col("_g"), 2)) / m,
            "_cx": F.when(n > 0, F.col("_sx") / n / w).otherwise(F.lit(0.5)),
            "_cy": F.when(n > 0, F.col("_sy") / n / h).otherwise(F.lit(0.5)),
        }
    )
    cx, cy = F.col("_cx"), F.col("_cy")

    def closeness(distance, reach):
        return F.lit(1.0) - F.least(distance / reach, F.lit(1.0))

    lr = F.abs(F.col("_left") * 2 - n) / F.greatest(n, F.lit(1.0))
    ud = F.abs(F.col("_up") * 2 - n) / F.greatest(n, F.lit(1.0))
    var_x = (F.col("_sxx") / n - F.pow(F.col("_sx") / n, 2)) / (w * w)
    var_y = (F.col("_syy") / n - F.pow(F.col("_sy") / n, 2)) / (h * h)
    brightness = F.col("_g") / 255.0
    scores = {
        "saliency_center_x": cx,
        "saliency_center_y": cy,
        "rule_thirds_score": closeness(_nearest(cx, cy, (1 / 3, 2 / 3)), 0.55),
        "golden_ratio_score": closeness(_nearest(cx, cy, (0.382, 0.618)), 0.52),
        "geometric_balance_score": F.when(n > 0, closeness((lr + ud) / 2, 0.60)).otherwise(F.lit(0.3)),
        "focal_clarity_score": F.when(n > 100, closeness(var_x + var_y, 0.18)).otherwise(F.lit(0.2)),
        "contrast_score": clip(F.sqrt("_gv") / 80.0, 0.0, 1.0),
        "brightness_score": closeness(F.abs(brightness - 0.52), 0.52),
        "edge_density": n / F.greatest(w * h, F.lit(1.0)),
    }
    return base.withColumns({k: F.round(v, 3) for k, v in scores.items()}).select(*frames.columns, *scores)


def frame_scores_with(frames: DataFrame) -> DataFrame:
    """Frame scores without the pixel columns, ready for the roll-up."""
    return frame_scores(frames).drop("gray", "edge_points", "width", "height")


def frame_motion(frames: DataFrame, video: str = "video_id", order: str = "frame_index") -> DataFrame:
    """Mean absolute gray difference to the previous frame of the video, over 255; null for the first.

    Frames of different size are compared on their common upper-left part.
    """
    packed = frames.withColumn("_img", F.struct("gray", "width", "height"))
    lagged = previous_value(packed, [video], order, "_img", "_prev")
    g, p = F.col("gray"), F.col("_prev.gray")
    w = F.least("width", F.col("_prev.width"))
    h = F.least("height", F.col("_prev.height"))
    same = (F.col("width") == F.col("_prev.width")) & (F.col("height") == F.col("_prev.height"))
    full = F.zip_with(g, p, lambda a, b: F.abs(a - b))
    part = F.transform(
        F.sequence(F.lit(0), w * h - 1),
        lambda i: F.abs(
            F.get(g, (F.floor(i / w) * F.col("width") + i % w).cast("int"))
            - F.get(p, (F.floor(i / w) * F.col("_prev.width") + i % w).cast("int"))
        ),
    )
    diff = F.when(same, full).otherwise(part)
    mean = _sum(diff, lambda d: d.cast("double")) / F.size(diff)
    return lagged.withColumn("motion", F.when(F.col("_prev").isNotNull(), mean / 255.0)).drop("_img", "_prev")


def visual_complexity(edge_density, ocr_text) -> Column:
    words = T.token_count(ocr_text)
    load = F.least(edge_density / 0.18, F.lit(1.0)) * 0.65 + F.least(words / 45.0, F.lit(1.0)) * 0.35
    return clip(load, 0.0, 1.0)


def _mean3(c: str) -> Column:
    # Frame scores carry three decimals; whole thousandths make the mean independent of row order.
    return F.sum(F.round(F.col(c) * 1000).cast("bigint")) / 1000.0 / F.count("*")


def visual_rollup(frames: DataFrame, texts: DataFrame | None = None, video: str = "video_id") -> DataFrame:
    """Per-video means, complexity and composition score; ``texts`` brings (video, ocr_text)."""
    motion = F.col("motion") if "motion" in frames.columns else F.lit(None).cast("double")
    means = frames.withColumn("_motion", motion).groupBy(video).agg(
        F.count("*").alias("frames_analyzed"),
        *[_mean3(c).alias(c) for c in FRAME_SCORES],
        F.coalesce(F.avg(F.round("_motion", 9)), F.lit(0.0)).alias("motion_score"),
    )
    joined = means.join(texts, video, "left") if texts is not None else means.withColumn("ocr_text", F.lit(""))
    joined = joined.withColumn("ocr_text", T.text("ocr_text"))
    joined = joined.withColumn("visual_complexity_score", visual_complexity(F.col("edge_density"), "ocr_text"))
    score = (
        F.col("rule_thirds_score") * 0.22 + F.col("golden_ratio_score") * 0.18 + F.col("geometric_balance_score") * 0.22
        + F.col("focal_clarity_score") * 0.18 + F.col("contrast_score") * 0.12
        + (F.lit(1.0) - F.col("visual_complexity_score")) * 0.08
    )
    return joined.withColumn("composition_score", F.round(score, 3))


def visual_summary(df: DataFrame) -> DataFrame:
    """Summary phrase, verdict, weakest area and conclusion from the rolled-up scores."""
    t, g, b, f, c = (
        F.col(x) for x in (
            "rule_thirds_score", "golden_ratio_score", "geometric_balance_score", "focal_clarity_score",
            "visual_complexity_score")
    )
    good = (t >= 0.55, g >= 0.55, b >= 0.55, f >= 0.40, c < 0.55)
    phrases = [F.when(ok, F.lit(yes)).otherwise(F.lit(no)) for ok, (yes, no) in zip(good, msg.VISUAL_SUMMARY)]
    s = F.col("composition_score")
    verdict = (
        F.when(s >= 0.70, F.lit(msg.VISUAL_VERDICT[0]))
        .when(s >= 0.50, F.lit(msg.VISUAL_VERDICT[1]))
        .otherwise(F.lit(msg.VISUAL_VERDICT[2]))
    )
    ranked = F.array(*[
        F.struct(v.alias("score"), F.lit(i).alias("i"), F.lit(a).alias("area"))
        for i, (v, a) in enumerate(zip((t, g, b, f, F.lit(1.0) - c), msg.VISUAL_AREAS))
    ])
    return df.withColumns(
        {
            "visual_summary": F.concat(F.concat_ws("; ", *phrases), F.lit(".")),
            "visual_verdict": verdict,
            "weakest_area": F.array_min(ranked)["area"],
            "visual_score_100": F.bround(F.round(s * 100, 6)).cast("int"),
        }
    )


def visual_advice(df: DataFrame) -> DataFrame:
    """Adds ``visual_advice``: composition theory -> messages, empty theories left out."""
    v = msg.VISUAL
    t, g, b, f, con, bri, e, c, mo = (
        F.col(x) for x in (
            "rule_thirds_score", "golden_ratio_score", "geometric_balance_score", "focal_clarity_score",
            "contrast_score", "brightness_score", "edge_density", "visual_complexity_score", "motion_score")
    )

    def three(x, texts):
        return F.array(F.when(x < 0.45, F.lit(texts[0])).when(x < 0.65, F.lit(texts[1])).otherwise(F.lit(texts[2])))

    def some(*pairs):
        return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]))

    theories = {
        "regla_de_tercios": three(t, v["thirds"]),
        "composicion_aurea": three(g, v["golden"]),
        "composicion_geometrica": some((b < 0.45, v["balance"][0]), (b >= 0.65, v["balance"][1])),
        "foco_visual": some((f < 0.35, v["focus"]), (e < 0.025, v["few_edges"])),
        "iluminacion_y_contraste": some((con < 0.40, v["contrast"]), (bri < 0.35, v["brightness"])),
        "carga_cognitiva": some(
            (c > 0.65, v["load"]), (mo > 0.28, v["motion"]), ((T.strip("ocr_text") == "") & (c < 0.35), v["no_text"])
        ),
    }
    entries = []
    for name, items in theories.items():
        entries += [F.lit(name), items]
    advice = F.map_filter(F.create_map(*entries), lambda k, items: F.size(items) > 0)
    flat = F.flatten(F.array(*theories.values()))
    return df.withColumns({"visual_advice": advice, "visual_recommendations": flat})
