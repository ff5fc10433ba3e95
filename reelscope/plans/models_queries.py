"""Queries that fit models: iterative results, checked by rows and by bounds in the tests."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.operators import evaluation as E
from reelscope.operators import learning as M
from reelscope.operators import sampling as S
from reelscope.operators.normalize import ensure_columns, project_features
from reelscope.plans import views as V
from reelscope.plans.registry import query, r6
from reelscope.plans.tables_queries import corpus_table
from reelscope.session import materialize, work_dir
from reelscope.sources import sinks


def training(spark, sf):
    """Feature table of the labelled videos; the target is the given quality label."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").cast("string").alias("video_id"), "quality")
    rows = ensure_columns(corpus_table(spark, sf)).join(labels, "video_id")
    keep = project_features(rows.withColumnRenamed("quality", fv.TARGET), keep=("video_id", fv.TARGET))
    return materialize(keep)


def split(df):
    marked = materialize(S.stratified_split(df, "video_id", fv.TARGET, 0.20))
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def vectors(spark, sf):
    train, test = split(training(spark, sf))
    return M.prepare_vectors(train, test, key="video_id", target=fv.TARGET)


def norm(v):
    """Length of a vector, from the values it stores."""
    return F.sqrt(F.aggregate(F.unwrap_udt(v).values, F.lit(0.0), lambda a, x: a + x * x))


def width(v):
    stored = F.unwrap_udt(v)
    return F.coalesce(stored.size, F.size(stored.values))


@query("tfidf")
def tfidf(spark, sf):
    d = training(spark, sf)
    out = M.tfidf(d).transform(d)
    return out.select("video_id", F.round(norm("text_vector"), 6).alias("norm"))


@query("tfidf_sublinear")
def tfidf_sublinear(spark, sf):
    d = training(spark, sf)
    out = M.tfidf(d, vocabulary=6000, min_df=3, max_df=0.95, sublinear=True, accents=True).transform(d)
    return out.select("video_id", F.round(norm("text_vector"), 6).alias("norm"))


@query("numeric_preprocessing")
def numeric(spark, sf):
    d = training(spark, sf)
    v = vector_to_array("numeric_vector")
    return M.numeric_preprocessing(d).transform(d).select("video_id", F.size(v).alias("n"), r6(v[0], "first"))


@query("categorical_preprocessing")
def categorical(spark, sf):
    d = training(spark, sf)
    v = vector_to_array("category_vector")
    return M.categorical_preprocessing(d).transform(d).select("video_id", "category_id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("ones"))


@query(
    "rare_to_infrequent",
    """SELECT source AS v, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY source) < 50 THEN 'infrequent' ELSE source END AS source FROM documents) GROUP BY 1""",
)
def rare(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("source")
    return M.rare_to_infrequent(d, d, "source", 50).groupBy(F.col("source").alias("v")).agg(F.count("*").alias("n"))


@query("assemble")
def assemble(spark, sf):
    d = training(spark, sf)
    out = M.assemble(d).transform(d)
    return out.select("video_id", width("features").alias("width"))


def one_model(spark, sf, fit, name):
    _, train, test = vectors(spark, sf)
    scored = M.predictions(fit(train), test, name, key="video_id")
    return E.model_metrics(scored)


@query("logistic_regression")
def logistic(spark, sf):
    return one_model(spark, sf, M.logistic_regression, "logistic_regression")


@query("linear_svc_calibrated")
def svc(spark, sf):
    return one_model(spark, sf, lambda d: M.linear_svc_calibrated(d, key="video_id"), "linear_svc")


@query("random_forest")
def forest(spark, sf):
    return one_model(spark, sf, M.random_forest, "random_forest")


@query("gbt_classifier")
def gbt(spark, sf):
    return one_model(spark, sf, lambda d: M.gbt_classifier(d, key="video_id"), "gbt")


@query("train_all")
def train_all(spark, sf):
    _, comparison, *_ = M.train_all(training(spark, sf))
    return comparison


@query("save_and_load_model")
def save_and_load(spark, sf):
    d = training(spark, sf)
    model = M.categorical_preprocessing(d)
    path = f"{work_dir(spark)}/model-{uuid.uuid4().hex}"
    sinks.save_model(model, path, d.agg(F.count("*").alias("rows")))
    back = sinks.load_model(spark, path, required=True)
    return back.transform(d).groupBy("category_id").agg(F.count("*").alias("n"))


@query("train_save_load_score")
def train_save_load_score(spark, sf):
    """All classifiers compared, the winner saved with its features and its rank table, loaded and applied to every video."""
    from pyspark.ml import PipelineModel

    from reelscope.operators.decision import score_videos

    best, comparison, fitted, features, _ = M.train_all(training(spark, sf))
    path = f"{work_dir(spark)}/model-{uuid.uuid4().hex}"
    sinks.save_model(PipelineModel([*features.stages, fitted[best]]), path, comparison)
    out = score_videos(corpus_table(spark, sf), sinks.load_model(spark, path, required=True))
    return out.select("video_id", "probability", "level", "model_available", F.lit(best).alias("model"))


@query("cross_val_f1")
def cross_val(spark, sf):
    return M.cross_val_f1(training(spark, sf), M.notebook_builders("video_id"), key="video_id", target=fv.TARGET)


@query("benchmark_table")
def benchmark(spark, sf):
    train, test = split(training(spark, sf))
    _, tv, hv = M.prepare_vectors(train, test, key="video_id", target=fv.TARGET)
    best = M.predictions(M.logistic_regression(tv), hv, "logistic_regression", key="video_id")
    return M.benchmark_table(train, test, best, key="video_id", target=fv.TARGET)


@query("learning_curve")
def learning_curve(spark, sf):
    return M.learning_curve(training(spark, sf), (100, 200), key="video_id", target=fv.TARGET)


@query("paid_regressor")
def paid(spark, sf):
    rows = V.campaigns(spark, sf)
    marked = materialize(S.shuffle_split(rows, "row_id", 0.20).withColumnRenamed("is_val", "is_test"))
    _, _, scored = M.paid_regressor(marked.where(~F.col("is_test")), marked.where("is_test"))
    return E.regression_metrics(scored, {t: f"pred_{t}" for t in fv.PAID_TARGETS})


@query("metric_regressors")
def metric_models(spark, sf):
    keep = ("views_per_day", "engagement_rate", "like_rate", "comment_rate")
    d = ensure_columns(corpus_table(spark, sf)).select("video_id", fv.TEXT_FEATURE, *fv.NUMERIC_FEATURES, *fv.CATEGORICAL_FEATURES, *keep)
    d = materialize(d)
    features, models = M.metric_regressors(d)
    out = M.apply_metric_regressors(d, features, models)
    return out.select("video_id", *[f"pred_{k}" for k in keep])


def embedded(spark, sf):
    return M.to_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")).select("vec_id", "label", "features")


@query("pca")
def pca(spark, sf):
    out, _ = M.pca(embedded(spark, sf), 50)
    return out.select("vec_id", F.size(vector_to_array("reduced")).alias("n"))


@query("kmeans")
def kmeans(spark, sf):
    reduced, _ = M.pca(embedded(spark, sf), 50)
    out, _ = M.kmeans(materialize(reduced.select("vec_id", "label", "reduced")), 6)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("label").alias("mean_label"))


@query("elbow")
def elbow(spark, sf):
    reduced, _ = M.pca(embedded(spark, sf), 50)
    return M.elbow(materialize(reduced.select("reduced")), range(3, 12))


@query("embedding_classifier")
def embedding_classifier(spark, sf):
    d = embedded(spark, sf).withColumn("label", (F.col("label") >= 5).cast("double"))
    d = materialize(S.stratified_split(E.balanced_weights(d, "label"), "vec_id", "label", 0.20))
    model = M.embedding_classifier(d.where(~F.col("is_test")))
    return E.model_metrics(M.predictions(model, d.where("is_test"), "dense", key="vec_id"))


@query("linear_attribution")
def attribution(spark, sf):
    _, train, test = vectors(spark, sf)
    model = M.logistic_regression(train)
    return M.linear_attribution(test, model.coefficients.toArray(), background=train)


def dense_model(spark, sf):
    """Logistic regression on the numeric columns only: its training rows, held-out rows and its scorer for perturbed tables."""
    d = training(spark, sf).select("video_id", fv.TARGET, *[F.col(c).cast("double").alias(c) for c in fv.NUMERIC_FEATURES])
    train, test = split(d)
    stages = M.numeric_preprocessing(train)

    def prepared(t):
        return stages.transform(t).withColumnRenamed("numeric_vector", "features").withColumn("label", F.col(fv.TARGET).cast("double"))

    model = M.logistic_regression(E.balanced_weights(prepared(train), "label"))

    def score(t):
        keep = [c for c in ("feature", "run") if c in t.columns]
        return M.predictions(model, prepared(t), "m", key="video_id", keep=keep).select("y", "pred", *keep)

    return train, test, score


@query("permutation_importance")
def permutation(spark, sf):
    _, test, score = dense_model(spark, sf)
    return M.permutation_importance(test, score, fv.NUMERIC_FEATURES, key="video_id")


@query("noise_robustness")
def noise(spark, sf):
    train, test, score = dense_model(spark, sf)
    return M.noise_robustness(test, score, fv.NUMERIC_FEATURES, key="video_id", reference=train)


@query("score_videos_with_model")
def score_with_model(spark, sf):
    """Probability and level of every video, from a text, numeric and category model fitted on all labelled ones."""
    from pyspark.ml import PipelineModel

    from reelscope.operators.decision import score_videos

    labelled = training(spark, sf)
    features = M.assemble(labelled)
    fitted = M.logistic_regression(M.labelled_vectors(features, labelled, key="video_id", target=fv.TARGET))
    out = score_videos(corpus_table(spark, sf), PipelineModel([*features.stages, fitted]))
    return out.select("video_id", "probability", "level", "model_available")
