"""Queries over evaluation, fairness, drift and cluster metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.operators import evaluation as E
from reelscope.operators.dedup import union_by_name
from reelscope.plans import sqltext as s
from reelscope.plans import views as V
from reelscope.plans.registry import query, r6
from reelscope.session import table


def with_scored(select: str) -> str:
    return f"WITH {V.SCORED_SQL} {select}"


COUNTS = """CAST(count(*) FILTER (y = 0 AND pred = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (y = 0 AND pred = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (y = 1 AND pred = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (y = 1 AND pred = 1) AS BIGINT) AS tp"""


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


RATES = f"""{s.r6(div('tp + tn', 'tp + tn + fp + fn'))} AS accuracy, {s.r6(div('tp', 'tp + fp'))} AS "precision", {s.r6(div('tp', 'tp + fn'))} AS recall, {s.r6(div('2 * tp', '2 * tp + fp + fn'))} AS f1"""


@query("confusion", with_scored(f", c AS (SELECT {COUNTS} FROM scored) SELECT tn, fp, fn, tp, {RATES} FROM c"))
def confusion(spark, sf):
    out = E.confusion(V.scored(spark, sf))
    return out.select("tn", "fp", "fn", "tp", *[r6(c, c) for c in ("accuracy", "precision", "recall", "f1")])


AUC_SQL = """ranked AS (SELECT y, proba, count(*) OVER (ORDER BY proba RANGE UNBOUNDED PRECEDING) AS hi, count(*) OVER (PARTITION BY proba) AS ties FROM scored),
auc AS (SELECT (sum(CASE WHEN y = 1 THEN hi - (ties - 1) / 2.0::DOUBLE ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) AS a FROM ranked)"""


@query("roc_auc", f"WITH {V.SCORED_SQL}, {AUC_SQL} SELECT {s.r6('a')} AS roc_auc FROM auc")
def roc_auc(spark, sf):
    return E.roc_auc(V.scored(spark, sf)).select(r6("roc_auc", "roc_auc"))


@query("log_loss", with_scored(f"SELECT {s.r6('avg(-ln(CASE WHEN y = 1 THEN greatest(least(proba, 0.999999), 0.000001) ELSE 1 - greatest(least(proba, 0.999999), 0.000001) END))')} AS log_loss FROM scored"))
def log_loss(spark, sf):
    return E.log_loss(V.scored(spark, sf)).select(r6("log_loss", "log_loss"))


CUM_SQL = """cum AS (SELECT proba AS threshold, CAST(sum(p) OVER w AS BIGINT) AS cum_pos, CAST(sum(n) OVER w AS BIGINT) AS cum_neg, sum(p) OVER () AS tp, sum(n) OVER () AS tn
  FROM (SELECT proba, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM scored GROUP BY 1) WINDOW w AS (ORDER BY proba DESC))"""


@query("roc_curve", f"WITH {V.SCORED_SQL}, {CUM_SQL} SELECT threshold, {s.r6('cum_neg::DOUBLE / tn')} AS fpr, {s.r6('cum_pos::DOUBLE / tp')} AS tpr FROM cum")
def roc_curve(spark, sf):
    return E.roc_curve(V.scored(spark, sf)).select("threshold", r6("fpr", "fpr"), r6("tpr", "tpr"))


@query("cumulative_counts", f"WITH {V.SCORED_SQL}, {CUM_SQL} SELECT threshold, cum_pos, cum_neg FROM cum")
def cumulative(spark, sf):
    return E.cumulative_counts(V.scored(spark, sf)).select(F.col("score").alias("threshold"), "cum_pos", "cum_neg")


GROUPS = ("lang", "source", "duration_bucket")
BUCKET = """CASE WHEN duration_seconds <= 0 THEN 'desconocida' WHEN duration_seconds <= 15 THEN 'muy_corto_1_15s' WHEN duration_seconds <= 60 THEN 'corto_16_60s'
  WHEN duration_seconds <= 180 THEN 'medio_61_180s' ELSE 'largo_180s_plus' END"""
GROUP_SQL = f"""{V.SCORED_SQL}, gl AS ({' UNION ALL '.join(f"SELECT '{g}' AS v, {BUCKET if g == 'duration_bucket' else g} AS g, y, pred, proba FROM scored" for g in GROUPS)}),
gc AS (SELECT v AS variable_grupo, g AS grupo, count(*) AS n, {COUNTS}, avg(proba) AS prob_media FROM gl GROUP BY 1, 2),
groups AS MATERIALIZED (SELECT variable_grupo, grupo, n, (tp + fn)::DOUBLE / n AS prevalencia_real, (tp + fp)::DOUBLE / n AS sel, {div('tp + tn', 'n')} AS accuracy, {div('tp', 'tp + fp')} AS prec,
  {div('tp', 'tp + fn')} AS recall_tpr, {div('2 * tp', '2 * tp + fp + fn')} AS f1, CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) END AS fpr, CASE WHEN fn + tp > 0 THEN fn::DOUBLE / (fn + tp) END AS fnr, prob_media
  FROM gc WHERE n >= CASE variable_grupo WHEN 'lang' THEN 20 ELSE 5 END)"""


def groups(spark, sf):
    from reelscope.functions.numeric import audit_duration_bucket

    d = V.scored(spark, sf).withColumn("duration_bucket", audit_duration_bucket("duration_seconds"))
    return E.group_metrics(d, GROUPS, {"lang": 20, "source": 5, "duration_bucket": 5})


@query(
    "group_metrics",
    f"""WITH {GROUP_SQL} SELECT variable_grupo, grupo, n, {s.r6('prevalencia_real')} AS prevalencia_real, {s.r6('sel')} AS tasa_seleccion_predicha, {s.r6('accuracy')} AS accuracy, {s.r6('prec')} AS "precision",
        {s.r6('recall_tpr')} AS recall_tpr, {s.r6('f1')} AS f1, {s.r6('coalesce(fpr, -1)')} AS fpr, {s.r6('coalesce(fnr, -1)')} AS fnr, {s.r6('prob_media')} AS prob_media FROM groups""",
)
def group_metrics(spark, sf):
    cols = ("prevalencia_real", "tasa_seleccion_predicha", "accuracy", "precision", "recall_tpr", "f1", "prob_media")
    return groups(spark, sf).select(
        "variable_grupo", "grupo", "n", *[r6(c, c) for c in cols], r6(F.coalesce("fpr", F.lit(-1.0)), "fpr"), r6(F.coalesce("fnr", F.lit(-1.0)), "fnr")
    )


@query(
    "fairness_summary",
    f"""WITH {GROUP_SQL} SELECT variable_grupo, count(*) AS grupos_incluidos, CAST(sum(n) AS BIGINT) AS n_total_en_grupos, {s.r6('max(sel) - min(sel)')} AS demographic_parity_difference,
        {s.r6('min(sel) / max(sel)')} AS disparate_impact_ratio_min_max, {s.r6('max(recall_tpr) - min(recall_tpr)')} AS equal_opportunity_difference_tpr, {s.r6('max(fpr) - min(fpr)')} AS fpr_difference,
        {s.r6('max(f1) - min(f1)')} AS f1_gap FROM groups GROUP BY 1""",
)
def fairness(spark, sf):
    out = E.fairness_summary(groups(spark, sf))
    gaps = ("demographic_parity_difference", "disparate_impact_ratio_min_max", "equal_opportunity_difference_tpr", "fpr_difference", "f1_gap")
    return out.select("variable_grupo", "grupos_incluidos", "n_total_en_grupos", *[r6(c, c) for c in gaps])


@query("top_groups", f"WITH {GROUP_SQL} SELECT variable_grupo, grupo, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY variable_grupo ORDER BY n DESC, grupo) AS r FROM groups) WHERE r <= 3")
def top_groups(spark, sf):
    return E.top_groups(groups(spark, sf), 3).select("variable_grupo", "grupo", "n", "rank")


REG_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS target, {s.r6(f'avg(abs({y} - {p}))')} AS mae, {s.r6(f'sqrt(avg(({y} - {p}) * ({y} - {p})))')} AS rmse, {s.r6(f'1 - avg(({y} - {p}) * ({y} - {p})) / var_pop({y})')} AS r2,
    {s.r6(f'avg(abs({y} - {p}) / greatest(abs({y}), 0.000001)) * 100')} AS mape_pct, {s.r6(f'avg({y})')} AS test_mean FROM lineitem"""
    for t, y, p in (("l_quantity", "l_quantity", "(l_extendedprice / 1600.0::DOUBLE)"), ("l_tax", "l_tax", "l_discount"))
)


@query("regression_metrics", REG_SQL)
def regression(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("guess", F.col("l_extendedprice") / 1600.0)
    out = E.regression_metrics(l, {"l_quantity": "guess", "l_tax": "l_discount"})
    return out.select("target", *[r6(c, c) for c in ("mae", "rmse", "r2", "mape_pct", "test_mean")])


def psi_sql(c: str) -> str:
    return f"""(SELECT '{c}' AS "column", round(sum((ap - ep) * ln(ap / ep)), 6) AS psi FROM (
      SELECT e / (sum(e) OVER ()) + 1e-6::DOUBLE AS ep, a / (sum(a) OVER ()) + 1e-6::DOUBLE AS ap FROM (
        SELECT least(len(list_filter(edges, lambda z: z <= x)), len(edges) - 1) AS bin, (count(*) FILTER (side = 'e'))::DOUBLE AS e, (count(*) FILTER (side = 'a'))::DOUBLE AS a
        FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'e' ELSE 'a' END AS side, {c} AS x, (SELECT list_sort(list_distinct(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))
              FROM lineitem WHERE l_returnflag = 'A') AS edges FROM lineitem)
        WHERE x >= edges[1] AND x <= edges[-1] GROUP BY 1)))"""


PSI_COLS = ("l_quantity", "l_extendedprice", "l_discount")


def psi_table(spark, sf, cols):
    l = table(spark, sf, "lineitem")
    return E.drift_report(l.where(F.col("l_returnflag") == "A"), l.where(F.col("l_returnflag") != "A"), cols)


@query("psi", f"SELECT psi FROM {psi_sql('l_quantity')}")
def psi(spark, sf):
    return psi_table(spark, sf, ["l_quantity"]).select(r6("psi", "psi"))


@query("drift_report", " UNION ALL ".join(f"SELECT \"column\", psi, CASE WHEN psi < 0.1 THEN 'estable' WHEN psi < 0.25 THEN 'moderado' ELSE 'alto' END AS severity FROM {psi_sql(c)}" for c in PSI_COLS))
def drift(spark, sf):
    return psi_table(spark, sf, PSI_COLS).select("column", r6("psi", "psi"), "severity")


@query("cluster_profile", f"SELECT label AS cluster, {s.r6('avg(embedding[1]::DOUBLE)')} AS perf_media, {s.r6('stddev_samp(embedding[1]::DOUBLE)')} AS perf_std, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_profile(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.col("embedding")[0].cast("double").alias("perf_score"))
    return E.cluster_profile(e).select("cluster", r6("perf_media", "perf_media"), r6("perf_std", "perf_std"), "n")


RULES = (("short", "n_chars < 1500"), ("long", "n_chars >= 1200"), ("all", "n_chars >= 0"))
MODELS_SQL = f"{V.SCORED_SQL}, m AS ({' UNION ALL '.join(f'''SELECT '{n}' AS model, y, CAST({c} AS INTEGER) AS pred, proba FROM scored''' for n, c in RULES)})"


def models(spark, sf):
    d = V.scored(spark, sf)
    return union_by_name([d.withColumns({"model": F.lit(n), "pred": F.expr(c).cast("int")}) for n, c in RULES])


@query(
    "rank_models",
    f"WITH {MODELS_SQL}, c AS (SELECT model, {COUNTS} FROM m GROUP BY 1), r AS (SELECT model, {RATES} FROM c) SELECT model, f1, CAST(row_number() OVER (ORDER BY f1 DESC, recall DESC, model) AS INTEGER) AS rank FROM r",
)
def rank_models(spark, sf):
    return E.rank_models(E.model_metrics(models(spark, sf))).select("model", r6("f1", "f1"), "rank")


@query("threshold_eval", with_scored(f", c AS (SELECT count(*) FILTER (y = 0 AND proba < 0.4) AS tn, count(*) FILTER (y = 0 AND proba >= 0.4) AS fp, count(*) FILTER (y = 1 AND proba < 0.4) AS fn, count(*) FILTER (y = 1 AND proba >= 0.4) AS tp FROM scored) SELECT {RATES} FROM c"))
def threshold_eval(spark, sf):
    out = E.threshold_eval(V.scored(spark, sf), 0.40)
    return out.select(*[r6(c, c) for c in ("accuracy", "precision", "recall", "f1")])


@query("balanced_weights", f"SELECT doc_id, {s.r6('(SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER (PARTITION BY quality))')} AS weight FROM labels")
def balanced_weights(spark, sf):
    return E.balanced_weights(table(spark, sf, "labels"), "quality").select("doc_id", r6("weight", "weight"))


HALF_SQL = f"{V.SCORED_SQL}, tr AS (SELECT * FROM scored WHERE source < 'src2'), te AS (SELECT * FROM scored WHERE source >= 'src2')"


def halves(spark, sf):
    d = V.scored(spark, sf)
    return d.where(F.col("source") < "src2"), d.where(F.col("source") >= "src2")


@query(
    "dummy_baselines",
    f"""WITH {HALF_SQL}, rate AS (SELECT avg(y) AS r FROM tr) SELECT 'most_frequent' AS model, id, CAST(r > 0.5 AS INTEGER) AS pred FROM te, rate
        UNION ALL SELECT 'stratified', id, CAST(CAST('0x' || substr(md5(id || ':42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < r AS INTEGER) FROM te, rate""",
)
def dummies(spark, sf):
    tr, te = halves(spark, sf)
    return E.dummy_baselines(tr, te, key="id").select("model", "id", "pred")


@query(
    "length_rule_baseline",
    f"""WITH {HALF_SQL}, cut AS (SELECT quantile_cont(n_chars::DOUBLE, 1 - (SELECT avg(y) FROM tr)) AS t FROM tr), sp AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM te)
        SELECT id, CAST(n_chars >= t AS INTEGER) AS pred, {s.r6('(n_chars - lo) / (hi - lo + 1e-9::DOUBLE)')} AS proba FROM te, cut, sp""".replace(
        "quantile_cont(n_chars::DOUBLE, 1 - (SELECT avg(y) FROM tr))",
        "(SELECT lo.x + (hi.x - lo.x) * (pos.p - floor(pos.p)) FROM (SELECT (1 - avg(y)) * (count(*) - 1) AS p FROM tr) pos, "
        "(SELECT n_chars::DOUBLE AS x, row_number() OVER (ORDER BY n_chars) - 1 AS r FROM tr) lo, "
        "(SELECT n_chars::DOUBLE AS x, row_number() OVER (ORDER BY n_chars) - 1 AS r FROM tr) hi WHERE lo.r = floor(pos.p) AND hi.r = ceil(pos.p))",
    ).replace(" AS t FROM tr)", " AS t)"),
)
def length_rule(spark, sf):
    tr, te = halves(spark, sf)
    return E.length_rule_baseline(tr, te, key="id", length="n_chars").select("id", "pred", r6("proba", "proba"))
