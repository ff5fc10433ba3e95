"""Queries over frames, channels and clusters rolled up per entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.operators import channels as C
from reelscope.operators import screen as O
from reelscope.operators import visual as W
from reelscope.plans import sqltext as s
from reelscope.plans import views as V
from reelscope.plans.registry import query, r6
from reelscope.plans.scalars_queries import quality_sql
from reelscope.plans.tables_queries import containment_sql
from reelscope.session import table
from reelscope.sources import payloads

NORMAL = f"trim(regexp_replace(regexp_replace(replace(x, chr(12), ' '), '[|_~`^]{{2,}}', ' ', 'g'), '[{s.SPACE}]+', ' ', 'g'))"
OCR_SQL = f"""{V.FRAMES_SQL},
raw_lines AS (SELECT video_id, ts, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM frames),
norm_lines AS MATERIALIZED (SELECT video_id, ts, i, {NORMAL} AS x FROM raw_lines),
good AS MATERIALIZED (SELECT video_id, ts, i, x FROM (SELECT *, string_split(lower(x), '') AS c FROM norm_lines) WHERE {quality_sql('x', 'c')} >= 0.38),
per_frame AS MATERIALIZED (SELECT video_id, ts, {containment_sql('list(x ORDER BY i)')} AS kept FROM good GROUP BY 1, 2),
frame_kept AS MATERIALIZED (SELECT video_id, ts, unnest(kept) AS x, generate_subscripts(kept, 1) AS i FROM per_frame),
firsts AS (SELECT *, row_number() OVER (PARTITION BY video_id, lower(x) ORDER BY ts, i) AS r FROM frame_kept),
video_text AS MATERIALIZED (SELECT video_id, array_to_string({containment_sql('list(x ORDER BY ts, i)')}, ' ') AS ocr_text FROM firsts WHERE r = 1 GROUP BY 1)"""


@query(
    "ocr_rollup",
    f"""WITH {OCR_SQL}, g AS (SELECT f.video_id, count(*) AS n, count(*) FILTER (p.kept IS NOT NULL AND len(p.kept) > 0) AS w, bool_or(presence) AS pr,
          coalesce(avg(CASE WHEN confidence > 0 THEN confidence END), 0) AS cf FROM frames f LEFT JOIN per_frame p ON f.video_id = p.video_id AND f.ts = p.ts GROUP BY 1),
        m AS (SELECT video_id, engine FROM (SELECT video_id, engine, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, engine) AS r FROM frames GROUP BY 1, 2) WHERE r = 1),
        j AS (SELECT g.*, engine, coalesce(ocr_text, '') AS ocr_text FROM g JOIN m USING (video_id) LEFT JOIN video_text USING (video_id)),
        k AS (SELECT *, {s.tokens_n('ocr_text')} AS wc FROM j)
        SELECT video_id, n AS ocr_frame_count, CAST(w AS BIGINT) AS ocr_frames_with_text, round(w::DOUBLE / n, 3) AS ocr_frame_coverage, round(cf, 2) AS ocr_confidence_avg,
          engine AS ocr_engine, md5(ocr_text) AS ocr_text, CAST(wc AS INTEGER) AS ocr_word_count, wc > 0 AND cf < 52 AS ocr_low_confidence,
          CASE WHEN wc = 0 THEN 'sin_texto' WHEN wc < 10 THEN 'baja' WHEN wc < 35 THEN 'media' ELSE 'alta' END AS visual_text_density,
          {s.flag('ocr_text', fv.CTA_TERMS)} AS ocr_cta_flag, {s.flag('ocr_text', fv.URGENCY_TERMS)} AS ocr_urgency_flag, CAST(wc > 35 AS INTEGER) AS ocr_excess_text_flag FROM k""",
)
def ocr_rollup(spark, sf):
    out = O.ocr_rollup(V.frames(spark, sf))
    return out.select(
        "video_id", "ocr_frame_count", "ocr_frames_with_text", "ocr_frame_coverage", "ocr_confidence_avg", "ocr_engine",
        F.md5("ocr_text").alias("ocr_text"), "ocr_word_count", "ocr_low_confidence", "visual_text_density", "ocr_cta_flag",
        "ocr_urgency_flag", "ocr_excess_text_flag",
    )


@query("ocr_rollup_fuzzy")
def ocr_rollup_fuzzy(spark, sf):
    out = O.ocr_rollup(V.frames(spark, sf), fuzzy=True)
    return out.select("video_id", "ocr_frame_count", "ocr_word_count", "visual_text_density")


@query(
    "first_text",
    f"""WITH {V.FRAMES_SQL}, l AS (SELECT video_id, ts, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM frames)
        SELECT video_id, x AS ocr_first_result FROM (SELECT video_id, {s.strip('x')} AS x, row_number() OVER (PARTITION BY video_id ORDER BY ts, i) AS r
        FROM l WHERE {s.strip('x')} <> '' AND NOT starts_with(lower({s.strip('x')}), '[texto detectado')) WHERE r = 1""",
)
def first_text(spark, sf):
    return O.first_text(V.frames(spark, sf))


def near_sql(lines) -> str:
    return "least(" + ", ".join(f"sqrt(power(cx - {x}::DOUBLE, 2) + power(cy - {y}::DOUBLE, 2))" for x in lines for y in lines) + ")"


THIRDS = ("(1.0::DOUBLE / 3.0::DOUBLE)", "(2.0::DOUBLE / 3.0::DOUBLE)")
IMAGE_SQL = f"""{V.IMAGES_SQL},
pt AS (SELECT video_id, frame_index, count(*)::DOUBLE AS n, avg(x) / 16 AS cx, avg(y) / 16 AS cy, var_pop(x) / 256 AS vx, var_pop(y) / 256 AS vy,
  (count(*) FILTER (x < 8))::DOUBLE AS l, (count(*) FILTER (y < 8))::DOUBLE AS u FROM points GROUP BY 1, 2),
gr AS (SELECT video_id, frame_index, avg(g) AS b, stddev_pop(g) AS sd FROM grays GROUP BY 1, 2),
fr AS (SELECT gr.video_id, gr.frame_index, coalesce(n, 0) AS n, coalesce(cx, 0.5) AS cx, coalesce(cy, 0.5) AS cy, vx, vy, l, u, b, sd FROM gr LEFT JOIN pt USING (video_id, frame_index)),
image_scores AS MATERIALIZED (SELECT video_id, frame_index, round(cx, 3) AS saliency_center_x, round(cy, 3) AS saliency_center_y,
  round(1 - least({near_sql(THIRDS)} / 0.55::DOUBLE, 1), 3) AS rule_thirds_score, round(1 - least({near_sql(('0.382', '0.618'))} / 0.52::DOUBLE, 1), 3) AS golden_ratio_score,
  CASE WHEN n > 0 THEN round(1 - least((abs(2 * l - n) / greatest(n, 1) + abs(2 * u - n) / greatest(n, 1)) / 2 / 0.6::DOUBLE, 1), 3) ELSE 0.3 END AS geometric_balance_score,
  CASE WHEN n > 100 THEN round(1 - least((vx + vy) / 0.18::DOUBLE, 1), 3) ELSE 0.2 END AS focal_clarity_score,
  round(least(sd / 80.0::DOUBLE, 1), 3) AS contrast_score, round(1 - least(abs(b / 255.0::DOUBLE - 0.52::DOUBLE) / 0.52::DOUBLE, 1), 3) AS brightness_score,
  round(n / 256.0::DOUBLE, 3) AS edge_density FROM fr)"""


def image_scores(spark, sf):
    return W.frame_scores(V.images(spark, sf))


SCORES = ("saliency_center_x", "saliency_center_y", *W.FRAME_SCORES)


@query("frame_scores", f"WITH {IMAGE_SQL} SELECT video_id, frame_index, {', '.join(SCORES)} FROM image_scores")
def frame_scores(spark, sf):
    return image_scores(spark, sf).select("video_id", "frame_index", *SCORES)


MOTION_SQL = """w AS (SELECT video_id, frame_index, i, g, lag(g) OVER (PARTITION BY video_id, i ORDER BY frame_index) AS p FROM grays),
motion AS MATERIALIZED (SELECT video_id, frame_index, avg(abs(g - p)) / 255.0::DOUBLE AS motion FROM w GROUP BY 1, 2)"""


@query("frame_motion", f"WITH {IMAGE_SQL}, {MOTION_SQL} SELECT video_id, frame_index, {s.r6('coalesce(motion, -1)')} AS motion FROM motion")
def frame_motion(spark, sf):
    out = W.frame_motion(V.images(spark, sf))
    return out.select("video_id", "frame_index", r6(F.coalesce("motion", F.lit(-1.0)), "motion"))


def mean3(c: str) -> str:
    return f"sum(CAST(round({c} * 1000) AS BIGINT))::DOUBLE / 1000.0::DOUBLE / count(*) AS {c}"


VISUAL_SQL = f"""vt AS (SELECT label, CAST(label AS VARCHAR) AS video_id, 'uno dos tres cuatro' AS ocr_text FROM (SELECT DISTINCT label FROM embeddings)),
v0 AS (SELECT i.video_id, count(*) AS frames_analyzed, {', '.join(mean3(c) for c in W.FRAME_SCORES)}, coalesce(avg(round(motion, 9)), 0) AS motion_score
  FROM image_scores i JOIN motion m USING (video_id, frame_index) GROUP BY 1),
v1 AS (SELECT *, {s.clip("0.65::DOUBLE * least(edge_density / 0.18::DOUBLE, 1) + 0.35::DOUBLE * least(4 / 45.0::DOUBLE, 1)", 0, 1)} AS visual_complexity_score FROM v0),
visual AS MATERIALIZED (SELECT *, round(rule_thirds_score * 0.22::DOUBLE + golden_ratio_score * 0.18::DOUBLE + geometric_balance_score * 0.22::DOUBLE + focal_clarity_score * 0.18::DOUBLE
  + contrast_score * 0.12::DOUBLE + (1 - visual_complexity_score) * 0.08::DOUBLE, 3) AS composition_score FROM v1)"""


def rolled_images(spark, sf):
    scored = image_scores(spark, sf).join(
        W.frame_motion(V.images(spark, sf)).select("video_id", "frame_index", "motion"), ["video_id", "frame_index"]
    )
    texts = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("video_id")).distinct().withColumn(
        "ocr_text", F.lit("uno dos tres cuatro")
    )
    return W.visual_rollup(scored, texts)


@query(
    "visual_rollup",
    f"WITH {IMAGE_SQL}, {MOTION_SQL}, {VISUAL_SQL} SELECT video_id, frames_analyzed, {', '.join(f'{s.r6(c)} AS {c}' for c in W.FRAME_SCORES)}, {s.r6('motion_score')} AS motion_score, composition_score FROM visual",
)
def visual_rollup(spark, sf):
    out = rolled_images(spark, sf)
    return out.select("video_id", "frames_analyzed", *[r6(c, c) for c in W.FRAME_SCORES], r6("motion_score", "motion_score"), "composition_score")


AREAS = "['encuadre por tercios', 'composición áurea', 'balance geométrico', 'claridad del foco', 'carga visual']"
FIVE = "[rule_thirds_score, golden_ratio_score, geometric_balance_score, focal_clarity_score, 1 - visual_complexity_score]"


@query(
    "visual_complexity",
    f"""WITH {IMAGE_SQL}, {MOTION_SQL}, {VISUAL_SQL} SELECT video_id, {s.r6('visual_complexity_score')} AS visual_complexity_score,
        CAST({s.bround('round(composition_score * 100, 6)')} AS INTEGER) AS visual_score_100, {AREAS}[list_position({FIVE}, list_min({FIVE}))] AS weakest_area FROM visual""",
)
def visual_complexity(spark, sf):
    out = W.visual_summary(rolled_images(spark, sf))
    return out.select("video_id", r6("visual_complexity_score", "visual_complexity_score"), "visual_score_100", "weakest_area")


@query(
    "visual_advice",
    f"""WITH {IMAGE_SQL}, {MOTION_SQL}, {VISUAL_SQL} SELECT video_id, array_to_string(list_filter(['regla_de_tercios', 'composicion_aurea',
        CASE WHEN geometric_balance_score < 0.45 OR geometric_balance_score >= 0.65 THEN 'composicion_geometrica' END,
        CASE WHEN focal_clarity_score < 0.35 OR edge_density < 0.025 THEN 'foco_visual' END,
        CASE WHEN contrast_score < 0.4 OR brightness_score < 0.35 THEN 'iluminacion_y_contraste' END,
        CASE WHEN visual_complexity_score > 0.65 OR motion_score > 0.28 THEN 'carga_cognitiva' END], lambda x: x IS NOT NULL), ' | ') AS theories FROM visual""",
)
def visual_advice(spark, sf):
    out = W.visual_advice(rolled_images(spark, sf))
    return out.select("video_id", F.array_join(F.map_keys("visual_advice"), " | ").alias("theories"))


RECENT_SQL = f"""{V.CHANNEL_VIDEOS_SQL}, recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY date_trunc('second', ts) DESC, video_id) AS r FROM channel_videos) WHERE r <= 20)"""


def recent(spark, sf):
    flat = payloads.flatten_video_payload(V.video_payloads(spark, sf), keep=("channel_id",))
    return C.recent_n(flat, 20)


@query("recent_n", f"WITH {RECENT_SQL} SELECT channel_id, video_id, views FROM recent")
def recent_n(spark, sf):
    return recent(spark, sf).select("channel_id", "video_id", "views")


@query(
    "channel_reach",
    f"""WITH {RECENT_SQL}, subs AS (SELECT 'UC' || user_id AS channel_id, count(*) FILTER (event_type = 'purchase') * 10 + 3 AS sc FROM events GROUP BY 1),
        g AS (SELECT channel_id, count(*) AS videos_sampled, round(avg(views), 1) AS av, round(median(views), 1) AS md, round(avg(likes), 1) AS al, round(avg(comments), 1) AS ac FROM recent GROUP BY 1)
        SELECT channel_id, videos_sampled, av AS avg_views_recent, md AS median_views_recent, al AS avg_likes_recent, ac AS avg_comments_recent,
          CASE WHEN av <> 0 THEN round((al + ac) / av, 4) ELSE 0 END AS avg_public_engagement_recent, CASE WHEN sc <> 0 THEN round(av / sc, 4) ELSE 0 END AS views_per_subscriber_recent
        FROM g LEFT JOIN subs USING (channel_id)""",
)
def channel_reach(spark, sf):
    channels = payloads.flatten_channel_payload(V.channel_payloads(spark, sf))
    return C.channel_reach(recent(spark, sf), channels).drop("subscriber_count")
