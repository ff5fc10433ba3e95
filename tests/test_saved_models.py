from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from reelscope.operators import evaluation as E
from reelscope.operators import learning as M
from reelscope.sources import sinks


def points(spark, n=240):
    d = spark.range(n).select(F.col("id").cast("string").alias("key"), (F.col("id") % 2).cast("double").alias("label"))
    x = F.pmod(F.xxhash64("key"), F.lit(1000)) / 1000.0
    return d.select("*", (F.col("label") * 2 + x).alias("a"), x.alias("b"), F.lit(1.0).alias("weight"))


def test_calibrated_svc_is_saved_and_scores_alike(spark, tmp_path):
    from pyspark.ml import PipelineModel

    d = points(spark).withColumn("features", array_to_vector(F.array("a", "b")))
    model = PipelineModel([M.linear_svc_calibrated(d, key="key")])
    sinks.save_model(model, str(tmp_path))
    back = sinks.load_model(spark, str(tmp_path))

    def scores(m):
        return {r.key: (r.prediction, r.p) for r in m.transform(d).select("key", "prediction", vector_to_array("probability")[1].alias("p")).collect()}

    assert back.stages[0].uid == model.stages[0].uid
    assert scores(back) == scores(model)
    assert sinks.load_model(spark, str(tmp_path / "none")) is None


def test_importance_of_used_and_unused_columns(spark):
    d = points(spark)

    def score(t):
        keep = [c for c in ("feature", "run") if c in t.columns]
        return t.select(F.col("label").cast("int").alias("y"), (F.col("a") >= 1.5).cast("int").alias("pred"), *keep)

    start = E.confusion(score(d)).first().f1
    got = {r.feature: r.importance for r in M.permutation_importance(d, score, ("a", "b"), key="key").collect()}
    assert got["b"] == 0.0
    assert 0.3 < got["a"] < start
    empty = M.permutation_importance(d.limit(0), score, ("a", "b"), key="key").collect()
    assert {r.feature: r.importance for r in empty} == {"a": 0.0, "b": 0.0}
