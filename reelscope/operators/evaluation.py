"""Classification, ranking, fairness, regression, drift and cluster metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions.numeric import ratio
from reelscope.operators.ordering import exact_quantiles, running_totals, with_scalars
from reelscope.session import few


def _counts(y="y", pred="pred") -> list[Column]:
    t, p = F.col(y) == 1, F.col(pred) == 1
    return [
        F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"),
    ]


def _rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(tp * 2, tp * 2 + fp + fn),
    }


def confusion(df: DataFrame, by=(), y="y", pred="pred") -> DataFrame:
    """Counts and guarded rates; 0/0 gives 0."""
    return df.groupBy(*by).agg(*_counts(y, pred)).withColumns(_rates())


def score_counts(df: DataFrame, by=(), y="y", score="proba") -> DataFrame:
    """Positives and negatives per distinct score: the only input the ranking metrics need."""
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )


def cumulative_counts(df: DataFrame, by=(), y="y", score="proba") -> DataFrame:
    """Running positives and negatives from the highest score down."""
    return running_totals(score_counts(df, by, y, score), list(by), "score", ["pos", "neg"], descending=True)


def roc_auc(df: DataFrame, by=(), y="y", score="proba", one_class: float | None = 0.0) -> DataFrame:
    """Exact area under the curve with tie averaging; ``one_class`` when a class is missing."""
    cum = cumulative_counts(df, by, y, score)
    # Negatives below the score plus half of those tied with it.
    sums = cum.groupBy(*by).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2.0)).alias("above"),
    )
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    area = F.lit(1.0) - F.col("above") / (p * n)
    return sums.select(*by, F.when((p > 0) & (n > 0), area).otherwise(F.lit(one_class).cast("double")).alias("roc_auc"))


def roc_curve(df: DataFrame, y="y", score="proba") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score."""
    cum = cumulative_counts(df, (), y, score)
    totals = df.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n"))
    return with_scalars(cum, totals, "t").select(
        F.col("score").alias("threshold"),
        ratio(F.col("cum_neg").cast("double"), F.col("t.n").cast("double")).alias("fpr"),
        ratio(F.col("cum_pos").cast("double"), F.col("t.p").cast("double")).alias("tpr"),
    )


def log_loss(df: DataFrame, by=(), y="y", score="proba", eps: float = 1e-6) -> DataFrame:
    p = F.greatest(F.least(F.col(score).cast("double"), F.lit(1 - eps)), F.lit(eps))
    return df.groupBy(*by).agg(
        F.avg(-F.log(F.when(F.col(y) == 1, p).otherwise(F.lit(1.0) - p))).alias("log_loss")
    )


def model_metrics(df: DataFrame, by=("model",), one_class: float | None = 0.0) -> DataFrame:
    """Confusion, rates and AUC side by side per group."""
    c, a = confusion(df, by), roc_auc(df, by, one_class=one_class)
    return c.join(a, list(by))


def threshold_eval(df: DataFrame, threshold: float, score="proba", by=()) -> DataFrame:
    """Metrics of the predictions ``score >= threshold``."""
    at = df.withColumn("pred", (F.col(score) >= threshold).cast("int"))
    c, a = confusion(at, by), roc_auc(at, by, score=score)
    return c.join(a, list(by)) if by else c.withColumn("roc_auc", a.scalar())


def rank_models(metrics: DataFrame) -> DataFrame:
    """Order by F1, AUC and recall; the table has one row per model."""
    w = Window.orderBy(F.col("f1").desc(), F.col("roc_auc").desc(), F.col("recall").desc(), F.col("model").asc())
    return metrics.withColumn("rank", F.row_number().over(w))


def group_metrics(df: DataFrame, groups, min_n=100) -> DataFrame:
    """Long table of metrics per group value; ``min_n`` is a number or a per-variable mapping.

    All variables are aggregated in one pass; missing values count as "unknown".
    """
    groups = list(groups)
    long = df.select(
        "y", "pred", "proba",
        F.explode(F.array(*[
            F.struct(F.lit(g).alias("v"), F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias("g")) for g in groups
        ])).alias("k"),
    ).select("y", "pred", "proba", F.col("k.v").alias("variable_grupo"), F.col("k.g").alias("grupo"))
    per = long.groupBy("variable_grupo", "grupo").agg(
        F.count("*").alias("n"), *_counts(), F.avg(F.col("proba").cast("double")).alias("prob_media")
    )
    need = F.lit(min_n) if isinstance(min_n, int) else None
    if need is None:
        for g in groups:
            hit = F.col("variable_grupo") == g
            need = F.when(hit, F.lit(min_n[g])) if need is None else need.when(hit, F.lit(min_n[g]))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    rates = _rates()
    return (
        per.where(F.col("n") >= need)
        .select(
            "variable_grupo", "grupo", "n",
            ((tp + fn) / F.col("n")).alias("prevalencia_real"),
            ((tp + fp) / F.col("n")).alias("tasa_seleccion_predicha"),
            rates["accuracy"].alias("accuracy"),
            rates["precision"].alias("precision"),
            rates["recall"].alias("recall_tpr"),
            rates["f1"].alias("f1"),
            F.when(fp + tn > 0, fp / (fp + tn)).alias("fpr"),
            F.when(fn + tp > 0, fn / (fn + tp)).alias("fnr"),
            "prob_media",
        )
        .orderBy("variable_grupo", F.col("n").desc(), "grupo")
    )


def fairness_summary(metrics: DataFrame) -> DataFrame:
    """Per variable: groups, rows, parity difference, impact ratio and gaps."""
    def gap(c):
        return F.max(c) - F.min(c)

    sel = "tasa_seleccion_predicha"
    return metrics.groupBy("variable_grupo").agg(
        F.count("*").alias("grupos_incluidos"),
        F.sum("n").alias("n_total_en_grupos"),
        gap(sel).alias("demographic_parity_difference"),
        F.when(F.max(sel) > 0, F.min(sel) / F.max(sel)).alias("disparate_impact_ratio_min_max"),
        gap("recall_tpr").alias("equal_opportunity_difference_tpr"),
        gap("fpr").alias("fpr_difference"),
        gap("f1").alias("f1_gap"),
    )


def top_groups(metrics: DataFrame, k: int = 10) -> DataFrame:
    """The k largest groups of every audited variable."""
    from reelscope.operators.dedup import top_per_group

    return top_per_group(metrics, ["variable_grupo"], [F.col("n").desc(), F.col("grupo").asc()], k)


def regression_metrics(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """MAE, RMSE, R2, MAPE and mean per target; ``targets`` maps target -> prediction column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"), F.col(p).cast("double").alias("p"))
        for t, p in targets.items()
    ])).alias("r")).select("r.*")
    e = F.col("y") - F.col("p")
    agg = long.groupBy("target").agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.avg(e * e) / F.var_pop("y")).alias("r2"),
        (F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(1e-6))) * 100).alias("mape_pct"),
        F.avg("y").alias("test_mean"),
    )
    return agg


def drift_report(ref: DataFrame, cur: DataFrame, columns, bins: int = 10) -> DataFrame:
    """Population stability index per numeric column against quantile bins of the reference."""
    columns = list(columns)
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(ref, columns, probs).groupBy("column").agg(
        # bins + 1 edges per column.
        F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("edges")
    )

    def long(df, side):
        return df.select(
            F.lit(side).alias("side"),
            F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns
            ])).alias("r"),
        ).select("side", "r.column", "r.x").where(F.col("x").isNotNull())

    both = long(ref, "e").unionByName(long(cur, "a")).join(F.broadcast(edges), "column")
    top = F.size("edges")
    slot = F.least(F.size(F.filter("edges", lambda e: e <= F.col("x"))), top - 1)
    inside = (F.col("x") >= F.get("edges", F.lit(0))) & (F.col("x") <= F.get("edges", top - 1))
    counts = both.where(inside & (top >= 3)).groupBy("column", slot.alias("bin")).agg(
        F.count_if(F.col("side") == "e").alias("e"), F.count_if(F.col("side") == "a").alias("a")
    )
    totals = counts.groupBy("column").agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    ep = F.col("e") / F.greatest("te", F.lit(1)) + 1e-6
    ap = F.col("a") / F.greatest("ta", F.lit(1)) + 1e-6
    values = counts.join(totals, "column").groupBy("column").agg(F.sum((ap - ep) * F.log(ap / ep)).alias("psi"))
    return (
        edges.select("column").join(values, "column", "left")
        .withColumn("psi", F.coalesce("psi", F.lit(0.0)))
        .withColumn("severity", psi_severity(F.col("psi")))
    )


def psi_severity(psi: Column) -> Column:
    return F.when(psi < 0.10, F.lit("estable")).when(psi < 0.25, F.lit("moderado")).otherwise(F.lit("alto"))


def psi(ref: DataFrame, cur: DataFrame, column: str, bins: int = 10) -> DataFrame:
    return drift_report(ref, cur, [column], bins)


def cluster_profile(df: DataFrame, cluster="cluster", score="perf_score") -> DataFrame:
    return df.groupBy(cluster).agg(
        F.avg(score).alias("perf_media"), F.stddev_samp(score).alias("perf_std"), F.count("*").alias("n")
    )


def balanced_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """n / (classes * class size) per row; the joined side has one row per class."""
    sizes = df.groupBy(target).agg(F.count("*").alias("_n"))
    facts = sizes.agg(F.sum("_n").alias("n"), F.count("*").alias("k"))
    weights = with_scalars(sizes, facts, "_f").select(
        target, (F.col("_f.n") / (F.col("_f.k") * F.col("_n"))).alias(name)
    )
    return df.join(F.broadcast(weights) if few(sizes) else weights, target)


def dummy_baselines(train: DataFrame, test: DataFrame, *, key: str, y: str = "y", seed=42) -> DataFrame:
    """Majority and prior-matched random predictions for the test rows: (model, key, y, pred, proba)."""
    facts = train.agg(F.avg(F.col(y).cast("double")).alias("rate"))
    base = with_scalars(test.select(key, y), facts, "_f")
    major = (F.col("_f.rate") > 0.5).cast("int")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0
    drawn = (u < F.col("_f.rate")).cast("int")
    rows = [
        base.select(F.lit(n).alias("model"), key, F.col(y).alias("y"), p.alias("pred"), p.cast("double").alias("proba"))
        for n, p in (("most_frequent", major), ("stratified", drawn))
    ]
    return rows[0].unionByName(rows[1])


def length_rule_baseline(train: DataFrame, test: DataFrame, *, key: str, y: str = "y", length: str = "text_total_word_count") -> DataFrame:
    """Long texts are predicted positive: threshold at the quantile that matches the positive rate."""
    rate = train.agg(F.array(F.lit(1.0) - F.avg(F.col(y).cast("double"))).alias("p")).scalar()
    cut = exact_quantiles(train, {"len": F.coalesce(F.col(length).cast("double"), F.lit(0.0))}, rate).select(
        F.col("quantile").alias("t")
    )
    x = F.coalesce(F.col(length).cast("double"), F.lit(0.0))
    span = test.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    scored = with_scalars(with_scalars(test, cut, "_t"), span, "_s")
    return scored.select(
        F.lit("length_rule").alias("model"), key, F.col(y).alias("y"),
        (x >= F.col("_t.t")).cast("int").alias("pred"),
        ((x - F.col("_s.lo")) / (F.col("_s.hi") - F.col("_s.lo") + 1e-9)).alias("proba"),
    )


def attach_predictions(df: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Predictions are matched by key, never by position."""
    return df.join(predictions, key)


def attach_split_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")
