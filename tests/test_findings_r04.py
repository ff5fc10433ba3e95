"""Findings of the fourth round: each test failed before its change."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as contract
from oracle_check import compare
from reelscope.functions import text as T
from reelscope.operators import boosting, learning
from reelscope.sources import sinks

SF = "/root/testdata/sf0.001"


def test_jitter_of_empty_and_missing_text_is_that_of_its_sql(spark, tmp_path):
    """an empty or missing text was hashed as another word, which the SQL does not do."""
    rows = [(0, "a text"), (1, ""), (2, None), (3, " "), (4, "ñandú 🙂")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = contract.queries()["stable_jitter"](spark, str(tmp_path)).toPandas()
    assert compare(got, duck.execute(contract.oracle_sql()["stable_jitter"]).df()) is None
    paid = spark.createDataFrame([("",), (None,), ("general",)], "t string").select(T.stable_jitter("t", empty="general")).collect()
    assert len(set(paid)) == 1


def points(spark, n=3000):
    d = spark.range(n).select(F.col("id").alias("key"), *((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)) / float(m)).alias(c) for i, (c, m) in enumerate((("a", 100), ("b", 1000), ("c", 3)))))
    d = d.select("*", (F.sin(F.col("a") * 6) + F.col("b") * F.col("c")).alias("y"), (F.col("a") + F.col("c") > 0.9).cast("double").alias("z"))
    return d.withColumn("features", array_to_vector(F.array("a", "b", F.when(F.col("c") > 0, F.col("c")).otherwise(0.0))))


def test_boosted_trees_take_the_best_splits_however_rows_are_dealt(spark, monkeypatch):
    d = points(spark).cache()
    x = np.array([r.features.toArray() for r in d.select("features").collect()])
    y = np.array([r.y for r in d.select("y").collect()])
    best = max(
        (-((y[m] - y[m].mean()) ** 2).sum() - ((y[~m] - y[~m].mean()) ** 2).sum(), f, float(cut), (y[m].mean(), y[~m].mean()))
        for f in range(3) for v in [np.unique(x[:, f])] for cut in (v[1:] + v[:-1]) / 2 for m in [x[:, f] <= cut]
    )
    stump = boosting.boost(d, ["y"], rounds=1, depth=1, rate=1.0, bins=2000)[0]
    tree = stump.trees[0][0]
    assert tree[1][:2] == pytest.approx((best[1], best[2]))
    assert np.allclose([stump.base + tree[2], stump.base + tree[3]], best[3], atol=1e-6)
    options = {"rounds": 5, "depth": 3, "rate": 0.1, "bins": 16, "rows_share": 0.9, "columns_share": 0.7, "key": "key"}
    want = boosting.boost(d, ["y", "z"], **options)
    monkeypatch.setattr(boosting, "ONE_PROCESS", 0)
    monkeypatch.setattr(boosting, "KEEP_EVERY", 2)
    for sent in (1 << 20, 0):
        monkeypatch.setattr(boosting, "SENT_SUMS", sent)
        got = boosting.boost(d.repartition(3), ["y", "z"], **options)
        for g, w in zip(got, want):
            assert len(g.trees) == 5 and [[n[:2] if isinstance(n, tuple) else round(n, 9) for _, n in sorted(t.items())] for t, _ in g.trees] == [
                [n[:2] if isinstance(n, tuple) else round(n, 9) for _, n in sorted(t.items())] for t, _ in w.trees
            ]


def work_of(spark, monkeypatch, name):
    """Options that a query hands to the boosting; two rounds of it are run."""
    seen, real = [], boosting.boost
    monkeypatch.setattr(boosting, "boost", lambda df, labels, **o: seen.append((list(labels), o)) or real(df, labels, **{**o, "rounds": 2}))
    assert contract.queries()[name](spark, SF).count() > 0
    return seen


def test_paid_regressor_grows_all_trees(spark, monkeypatch):
    """5 of 350 trees."""
    (labels, options), = work_of(spark, monkeypatch, "paid_regressor")
    assert labels == ["paid_performance_score", "cpm"]
    assert {k: options[k] for k in ("rounds", "depth", "rate", "rows_share")} == {"rounds": 350, "depth": 4, "rate": 0.045, "rows_share": 0.9}


def test_metric_regressors_grow_all_trees(spark, monkeypatch):
    """2 of 40 trees, depth 3 of 4."""
    (labels, options), = work_of(spark, monkeypatch, "metric_regressors")
    assert labels == ["views_per_day", "engagement_rate", "like_rate", "comment_rate"]
    assert (options["rounds"], options["depth"]) == (40, 4)


def test_gbt_classifier_grows_all_trees(spark, monkeypatch):
    """5 of 120 rounds, depth 4 of 6."""
    (_, options), = work_of(spark, monkeypatch, "gbt_classifier")
    assert {k: options[k] for k in ("rounds", "depth", "rate", "leaves", "leaf")} == {"rounds": 120, "depth": 6, "rate": 0.08, "leaves": 31, "leaf": 20}


def test_boosting_ends_when_the_held_out_loss_stays(spark, tmp_path):
    """one tree of little gain ended it before; the model scores alike after saving."""
    from pyspark.ml import PipelineModel

    d = points(spark).withColumn("held", F.col("key") % 7 == 0).withColumn("noise", (F.pmod(F.xxhash64("key"), F.lit(2))).cast("double"))
    losses = boosting.boost(d, ["noise"], logistic=True, rounds=120, depth=6, rate=0.08, leaf=20, leaves=8, held="held")[0].losses
    assert 10 < len(losses) < 120 and min(losses[-10:]) > losses[-11] - 1e-7
    assert all(min(losses[i - 10 : i]) <= losses[i - 11] - 1e-7 for i in range(11, len(losses)))
    ensemble = boosting.boost(d, ["z"], logistic=True, rounds=30, depth=6, rate=0.08, leaf=20, leaves=8, held="held")[0]
    assert all(sum(not isinstance(n, tuple) for n in tree.values()) <= 8 for tree, _ in ensemble.trees)
    model = boosting.classifier(d, "z", rounds=30, depth=6, rate=0.08, leaf=20, leaves=8, held="held")
    PipelineModel([model]).save(str(tmp_path / "m"))

    def scores(m):
        return m.transform(d).select("prediction", vector_to_array("probability")[1].alias("p"), "z").collect()

    got = scores(model)
    assert got == scores(PipelineModel.load(str(tmp_path / "m")))
    assert np.mean([r.prediction == r.z for r in got]) > 0.95


def test_a_model_that_cannot_be_read_is_an_error(spark, tmp_path, monkeypatch):
    """any failure to load gave None, and every video the score of the heuristic."""
    from pyspark.ml import PipelineModel

    d = points(spark, 50)
    features = learning.categorical_preprocessing(d, ["c"])
    sinks.save_model(features, str(tmp_path))
    assert sinks.load_model(spark, str(tmp_path)).transform(d).count() == 50
    assert sinks.load_model(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception):
        sinks.load_model(spark, str(tmp_path / "none"), required=True)
    (tmp_path / "broken" / "model" / "metadata").mkdir(parents=True)
    (tmp_path / "broken" / "model" / "metadata" / "part-00000").write_text("{")
    with pytest.raises(Exception):
        sinks.load_model(spark, str(tmp_path / "broken"))
    monkeypatch.setattr(learning, "train_all", lambda rows: ("m", d, {"m": PipelineModel([])}, features, None))
    monkeypatch.setattr(sinks, "save_model", lambda *a: None)
    with pytest.raises(Exception):
        contract.queries()["train_save_load_score"](spark, SF)


def test_cross_validation_compares_the_six_classifiers(spark, monkeypatch):
    """one classifier was validated, and none was chosen."""
    asked, fitted = [], {}
    monkeypatch.setattr(learning, "cross_val_f1", lambda df, builders, **o: asked.append(builders) or df)
    contract.queries()["cross_val_f1"](spark, SF)
    assert set(asked[0]) == {"dummy", "logistic_regression", "random_forest", "linear_svc", "xgboost", "lightgbm"}
    monkeypatch.undo()
    for module, name in ((boosting, "classifier"), (learning, "random_forest"), (learning, "linear_svc_calibrated"), (learning, "logistic_regression")):
        monkeypatch.setattr(module, name, lambda d, *a, _n=name, **o: fitted.setdefault(_n, []).append(o))
    for fit in list(asked[0].values())[1:]:
        fit(None if fit is not asked[0]["xgboost"] else points(spark, 5))
    assert [(o["rounds"], o["rate"], o["depth"]) for o in fitted["classifier"]] == [(200, 0.05, 3), (200, 0.05, 5)]
    assert fitted["random_forest"] == [{"trees": 200, "depth": 8, "leaf": 1}]
    monkeypatch.undo()
    vectors = lambda train, test, **o: (None, *(t.select("key", F.col("z").alias("label"), F.lit(1.0).alias("weight"), "features") for t in (train, test)))
    monkeypatch.setattr(learning, "prepare_vectors", vectors)
    builders = {"dummy": asked[0]["dummy"], "good": lambda d: learning.logistic_regression(d, max_iter=20)}
    got = {r.model: r for r in learning.cross_val_f1(points(spark, 400), builders, key="key", target="z").collect()}
    assert got["good"].best and not got["dummy"].best and got["good"].f1_mean > 0.8 and got["good"].f1_std < 0.2


def test_every_video_is_scored_with_the_model(spark):
    """F8: a row for each level came out, and a fifth of the labels was laid aside for no test."""
    out = contract.queries()["score_videos_with_model"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("video_id"))
    got = out.toPandas()
    assert sorted(got.video_id) == sorted(r[0] for r in docs.collect())
    assert got.probability.between(0.02, 0.98).all() and got.model_available.all() and got.level.notna().all()


def test_scores_of_the_whole_analysis_are_made_once(spark):
    """F2: each use of a score held the whole expression over the word scans again, 112 times the same lower() for the script."""
    out = contract.queries()["analyze_batch_all_sides"](spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(_hook#") < 40
