"""Feature pipelines, estimators and model comparison on pyspark.ml."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool
from random import Random

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    PCA,
    CountVectorizerModel,
    ElementwiseProduct,
    Imputer,
    NGram,
    Normalizer,
    OneHotEncoder,
    RegexTokenizer,
    RobustScaler,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from reelscope import fixed_values as fv
from reelscope.operators import boosting
from reelscope.operators import evaluation as E
from reelscope.operators import sampling as S
from reelscope.operators.ordering import hash_order, hash_rank
from reelscope.operators.terms_text import strip_accents
from reelscope.session import drop_stages, few, materialize, stage_of


@F.udf(VectorUDT())
def log_counts(v):
    """1 + ln(c) of the counts that a vector stores; the zeros it leaves out stay so."""
    if isinstance(v, SparseVector):
        return Vectors.sparse(v.size, v.indices[v.values > 0], 1.0 + np.log(v.values[v.values > 0]))
    return Vectors.dense([1.0 + np.log(c) if c > 0 else 0.0 for c in v.values])


class LogCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term counts c > 0 become 1 + ln(c)."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), log_counts(self.getInputCol()))


def fit_stages(df: DataFrame, stages) -> PipelineModel:
    """Fit estimators in order, each on the output of the stages before it."""
    fitted, current = [], df
    for stage in stages:
        model = stage.fit(current) if hasattr(stage, "fit") else stage
        fitted.append(model)
        current = model.transform(current)
    return PipelineModel(fitted)


#: Folds of a cross-validation that are fitted at the same time.
FOLDS_AT_ONCE = 5
#: So many words at most are sent to the tasks that count pairs.
SENT_WORDS = 100_000


def _term_counts(rows: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(term, n, docs): how often each of ``terms`` occurs, and in how many rows; only pairs of ``words``, if given."""
    one = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    seen = F.concat(
        F.transform("terms", lambda t: F.struct(t.alias("term"), one.alias("n"), none.alias("docs"))),
        F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), none.alias("n"), one.alias("docs"))),
    )
    found = rows.select(F.explode(seen).alias("t")).select("t.*")
    for at in (1, -1) if words is not None else ():
        part = words.select(F.col("term").alias("_word"))
        found = found.join(part, F.substring_index("term", " ", at) == F.col("_word"), "left_semi")
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def top_terms(df: DataFrame, words: str, pairs: str, vocabulary: int, min_df: float, max_df: float | None) -> tuple[list[str], list[int], int]:
    """The most frequent words and word pairs within the limits, ties to the smaller term, their documents, and all rows.

    Limits below 1 are shares of the rows. A pair occurs no more often than either of its words, so
    once enough words are known, only the pairs of words as frequent as the last of them are counted; the rest cannot
    be among the most frequent. Without enough words all pairs are.
    """
    rows = df.count()
    low = min_df if min_df >= 1.0 else min_df * rows
    high = None if max_df is None else max_df if max_df >= 1.0 else max_df * rows
    kept = (F.col("docs") >= low) & (F.lit(True) if high is None else F.col("docs") <= high)
    order = (F.desc("n"), F.asc("term"))
    single = materialize(_term_counts(df.select(F.col(words).alias("terms"))))
    best = single.where(kept).orderBy(*order).limit(vocabulary).collect()
    both = df.select(F.col(pairs).alias("terms"))
    frequent = single.where(F.col("n") >= best[-1].n).select("term") if len(best) == vocabulary else None
    if frequent is not None and few(frequent, SENT_WORDS):
        counted = _term_counts(both, F.broadcast(frequent))
    else:
        counted = _term_counts(both)
    best = single.where(kept).orderBy(*order).limit(vocabulary).unionByName(counted.where(kept)).orderBy(*order).limit(vocabulary).collect()
    drop_stages(df.sparkSession, stage_of(single))
    if not best:
        raise ValueError("no term is within the limits")
    return [r.term for r in best], [r.docs for r in best], rows


def tfidf(
    df: DataFrame, text: str = fv.TEXT_FEATURE, output: str = "text_vector", *, vocabulary: int = 700,
    min_df: float = 2, max_df: float | None = None, sublinear: bool = False, accents: bool = False,
) -> PipelineModel:
    """Word 1- and 2-grams, top terms by corpus frequency, smoothed idf + 1, unit length."""
    source = SQLTransformer(statement=f"SELECT *, {strip_accents(text) if accents else text} AS tf_text FROM __THIS__")
    steps = [
        source,
        RegexTokenizer(inputCol="tf_text", outputCol="tf_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True),
        NGram(n=2, inputCol="tf_words", outputCol="tf_pairs"),
        SQLTransformer(statement="SELECT *, concat(tf_words, tf_pairs) AS tf_terms FROM __THIS__"),
    ]
    # every text is cut into words once for all counts
    current = materialize(PipelineModel(steps[:2]).transform(df).select("tf_words"))
    written = stage_of(current)
    current = steps[2].transform(current)
    terms, docs, rows = top_terms(current, "tf_words", "tf_pairs", vocabulary, float(min_df), max_df)
    drop_stages(df.sparkSession, written)
    counts = CountVectorizerModel.from_vocabulary(terms, "tf_terms", "tf_counts")
    weights = Vectors.dense(np.log((rows + 1.0) / (np.array(docs) + 1.0)) + 1.0)
    stages = [*steps, counts]
    scaled_input = "tf_counts"
    if sublinear:
        stages.append(LogCounts(inputCol="tf_counts", outputCol="tf_log"))
        scaled_input = "tf_log"
    stages += [
        ElementwiseProduct(inputCol=scaled_input, outputCol="tf_weighted", scalingVec=weights),
        Normalizer(inputCol="tf_weighted", outputCol=output, p=2.0),
        SQLTransformer(
            statement="SELECT * EXCEPT (tf_text, tf_words, tf_pairs, tf_terms, tf_counts, "
            + ("tf_log, " if sublinear else "") + "tf_weighted) FROM __THIS__"
        ),
    ]
    return PipelineModel(stages)


def numeric_preprocessing(df: DataFrame, columns=fv.NUMERIC_FEATURES, output: str = "numeric_vector", *, robust: bool = False) -> PipelineModel:
    """Median imputation, then scaling without centring (or robust centring and scaling)."""
    columns = list(columns)
    doubles = SQLTransformer(
        statement="SELECT *, " + ", ".join(f"CAST({c} AS DOUBLE) AS nu_{c}" for c in columns) + " FROM __THIS__"
    )
    filled = [f"nu_{c}" for c in columns]
    scaler = (
        RobustScaler(inputCol="nu_raw", outputCol=output, withCentering=True)
        if robust
        else StandardScaler(inputCol="nu_raw", outputCol=output, withMean=False, withStd=True)
    )
    return fit_stages(df, [
        doubles,
        Imputer(strategy="median", inputCols=filled, outputCols=filled, relativeError=0.001),
        VectorAssembler(inputCols=filled, outputCol="nu_raw", handleInvalid="keep"),
        scaler,
        SQLTransformer(statement=f"SELECT * EXCEPT (nu_raw, {', '.join(filled)}) FROM __THIS__"),
    ])


def categorical_preprocessing(df: DataFrame, columns=fv.CATEGORICAL_FEATURES, output: str = "category_vector") -> PipelineModel:
    """Most frequent value for nulls, one-hot with unknown values mapped to no category."""
    columns = list(columns)
    fills = []
    for c in columns:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).collect()
        value = str(top[0][0]) if top else "missing"
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        fills.append(f"coalesce(CAST({c} AS STRING), '{escaped}') AS ca_{c}")
    indexed = [f"ci_{c}" for c in columns]
    hot = [f"ch_{c}" for c in columns]
    temporary = ", ".join([f"ca_{c}" for c in columns] + indexed + hot)
    return fit_stages(df, [
        SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__"),
        StringIndexer(inputCols=[f"ca_{c}" for c in columns], outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=hot, outputCol=output),
        SQLTransformer(statement=f"SELECT * EXCEPT ({temporary}) FROM __THIS__"),
    ])


def rare_to_infrequent(df: DataFrame, reference: DataFrame, column: str, min_frequency: int = 5, label: str = "infrequent") -> DataFrame:
    """Values seen fewer than ``min_frequency`` times in the reference share one label; unseen values stay."""
    rare = reference.groupBy(column).count().where(F.col("count") < min_frequency).select(column, F.lit(True).alias("_rare"))
    joined = df.join(rare, column, "left")
    return joined.withColumn(column, F.when(F.col("_rare"), F.lit(label)).otherwise(F.col(column))).drop("_rare")


def rare_values(reference: DataFrame, columns, min_frequency: int = 5) -> DataFrame:
    """(column, value) of the values that fewer than ``min_frequency`` rows of the reference hold, all columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = reference.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    return materialize(counts.where((F.col("n") < min_frequency) & F.col("value").isNotNull()).select("column", "value"))


def mark_infrequent(df: DataFrame, rare: DataFrame, columns, label: str = "infrequent") -> DataFrame:
    """Values listed in ``rare`` share one label per column. Columns without any are left alone; long lists are joined."""
    for c in [r[0] for r in rare.select("column").distinct().collect()]:
        listed = rare.where(F.col("column") == c).select(F.col("value").alias("_value"), F.lit(True).alias("_rare"))
        listed = F.broadcast(listed) if few(listed) else listed
        joined = df.join(listed, F.col(c).cast("string") == F.col("_value"), "left")
        df = joined.withColumn(c, F.when(F.col("_rare"), F.lit(label)).otherwise(F.col(c))).drop("_rare", "_value")
    return df


FEATURE_PARTS = ("text_vector", "numeric_vector", "category_vector")


def assemble(df: DataFrame, *, text_options: dict | None = None, robust: bool = False) -> PipelineModel:
    """Text, numeric and categorical vectors joined column-wise into ``features``."""
    text = tfidf(df, **(text_options or {}))
    numeric = numeric_preprocessing(df, robust=robust)
    category = categorical_preprocessing(df)
    drop = ", ".join(FEATURE_PARTS)
    return PipelineModel([
        *text.stages, *numeric.stages, *category.stages,
        VectorAssembler(inputCols=list(FEATURE_PARTS), outputCol="features"),
        SQLTransformer(statement=f"SELECT * EXCEPT ({drop}) FROM __THIS__"),
    ])


class CalibratedSvc(Model, MLReadable, MLWritable):
    """Mean of linear SVMs, each calibrated by a sigmoid on its held-out fold."""

    def __init__(self, members=()):
        super().__init__()
        self.members = list(members)

    def write(self):
        return CalibratedSvcWriter(self)

    @classmethod
    def read(cls):
        return CalibratedSvcReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        out, parts = df, []
        for i, (svc, sigmoid) in enumerate(self.members):
            margin = vector_to_array(F.col("_raw"))[1]
            out = svc.setRawPredictionCol("_raw").setPredictionCol("_p").transform(out)
            z = margin * float(sigmoid.coefficients[0]) + float(sigmoid.intercept)
            out = out.withColumn(f"_m{i}", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop("_raw", "_p")
            parts.append(F.col(f"_m{i}"))
        p = sum(parts[1:], parts[0]) / len(parts)
        done = out.withColumn("_mean", p).drop(*[f"_m{i}" for i in range(len(parts))])
        return done.withColumns(
            {
                "probability": array_to_vector(F.array(F.lit(1.0) - F.col("_mean"), F.col("_mean"))),
                "prediction": (F.col("_mean") >= 0.5).cast("double"),
            }
        ).drop("_mean")


class CalibratedSvcWriter(MLWriter):
    """A folder for each member's machine and sigmoid, numbered, beside the metadata."""

    def __init__(self, model: CalibratedSvc):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        members = self.model.members
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"members": len(members)})
        for i, (svc, sigmoid) in enumerate(members):
            svc.save(f"{path}/member-{i}/svc")
            sigmoid.save(f"{path}/member-{i}/sigmoid")


class CalibratedSvcReader(MLReader):
    def load(self, path: str) -> CalibratedSvc:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = (f"{path}/member-{i}" for i in range(meta["members"]))
        model = CalibratedSvc([(LinearSVCModel.load(f"{p}/svc"), LogisticRegressionModel.load(f"{p}/sigmoid")) for p in parts])
        model._resetUid(meta["uid"])
        return model


def linear_svc_calibrated(df: DataFrame, *, key: str, label: str = "label", weight: str = "weight", folds: int = 3, c: float = 1.0, max_iter: int = 100) -> CalibratedSvc:
    folded = S.kfold_stratified(df, key, label, folds)
    n = df.count()
    members = []
    for k in range(folds):
        fit_on, hold = folded.where(F.col("fold") != k), folded.where(F.col("fold") == k)
        svc = LinearSVC(labelCol=label, weightCol=weight, regParam=1.0 / (c * n), maxIter=max_iter, standardization=False).fit(fit_on)
        margins = svc.transform(hold).select(
            array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("features"), label
        )
        members.append((svc, LogisticRegression(labelCol=label, maxIter=50).fit(margins)))
    return CalibratedSvc(members)


def logistic_regression(df: DataFrame, *, label="label", weight="weight", c: float = 1.0, max_iter: int = 100, features="features"):
    """L2 logistic regression; the penalty equals C on the sum of balanced weights."""
    n = df.count()
    return LogisticRegression(
        featuresCol=features, labelCol=label, weightCol=weight, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0,
        maxIter=max_iter, standardization=False,
    ).fit(df)


def random_forest(df: DataFrame, *, label="label", weight="weight", trees: int = 120, depth: int = 12, leaf: int = 2, seed=42):
    return RandomForestClassifier(
        labelCol=label, weightCol=weight, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed,
        cacheNodeIds=True, checkpointInterval=10,
    ).fit(df)


def gbt_classifier(df: DataFrame, *, key: str, label="label", iterations: int = 120, rate: float = 0.08, depth: int = 6, seed=42, validation: float = 0.15):
    """Boosted trees with at most 31 leaves of 20 rows or more; stops when the loss on a stratified validation share has not fallen for 10 trees."""
    split = S.stratified_split(df, key, label, validation, f"{seed}gbt")
    return boosting.classifier(split, label, rounds=iterations, depth=depth, rate=rate, leaves=31, leaf=20, held="is_test", seed=seed)


def predictions(model, df: DataFrame, name: str, *, key: str, label: str = "label", keep=()) -> DataFrame:
    """(model, key, y, pred, proba) of one fitted classifier, and the columns ``keep``."""
    return model.transform(df).select(
        F.lit(name).alias("model"), key, *keep, F.col(label).cast("int").alias("y"),
        F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("proba"),
    )


def model_builders(key: str, *, with_gbt: bool = False, light: bool = False) -> dict:
    """Name -> fit function of the compared classifiers; ``light`` shrinks the tree ensembles."""
    trees, rounds = (20, 10) if light else (120, 120)
    builders = {
        "logistic_regression": lambda d: logistic_regression(d),
        "linear_svc": lambda d: linear_svc_calibrated(d, key=key),
        "random_forest": lambda d: random_forest(d, trees=trees, depth=6 if light else 12),
    }
    if with_gbt:
        builders["hist_gradient_boosting"] = lambda d: gbt_classifier(d, key=key, iterations=rounds)
    return builders


class MostFrequent(Model):
    """The most frequent class for every row."""

    def __init__(self, share: float = 0.0):
        super().__init__()
        self.share = share

    def _transform(self, df: DataFrame) -> DataFrame:
        one = 1.0 if self.share > 0.5 else 0.0
        return df.withColumns({"probability": array_to_vector(F.array(F.lit(1.0 - one), F.lit(one))), "prediction": F.lit(one)})


def notebook_builders(key: str) -> dict:
    """Name -> fit function of the six classifiers that the research notebook cross-validates, with its parameters.

    Its 3,000 iterations of the linear SVM are passes of another solver and do not apply to this one.
    """
    def boosted(df, weight, **options):
        return boosting.classifier(df, "label", weight=weight, rounds=200, rate=0.05, key=key, **options)

    return {
        "dummy": lambda d: MostFrequent(d.agg(F.avg("label")).first()[0]),
        "logistic_regression": lambda d: logistic_regression(d, c=1.0, max_iter=2000),
        "random_forest": lambda d: random_forest(d, trees=200, depth=8, leaf=1),
        "linear_svc": lambda d: linear_svc_calibrated(d, key=key, c=0.5),
        "xgboost": lambda d: boosted(
            d, F.when(F.col("label") == 1, 2.0).otherwise(1.0), depth=3, rows_share=0.8, columns_share=0.8, hessian=1.0, penalty=1.0
        ),
        "lightgbm": lambda d: boosted(d, "weight", depth=5, leaves=20, leaf=20, hessian=1e-3),
    }


def labelled_vectors(features: PipelineModel, df: DataFrame, *, key: str, target: str) -> DataFrame:
    """Narrow table of key, label, balanced weight and features."""
    weighted = E.balanced_weights(df.withColumn("label", F.col(target).cast("double")), "label")
    return materialize(features.transform(weighted).select(key, "label", "weight", "features"))


def prepare_vectors(train: DataFrame, test: DataFrame, *, key: str, target: str, text_options=None, robust=False):
    """Fit the feature stages on the training part and write both parts as narrow vector tables."""
    features = assemble(train, text_options=text_options, robust=robust)
    return features, *(labelled_vectors(features, part, key=key, target=target) for part in (train, test))


def train_all(df: DataFrame, *, key: str = "video_id", target: str = fv.TARGET, builders: dict | None = None, seed=42, fraction: float = 0.20):
    """Split, fit every classifier on shared vectors, evaluate on the hold-out and rank.

    A classifier that fails is left out.  Returns (best name, comparison table,
    fitted models, feature model, scored hold-out rows).
    """
    split = materialize(S.stratified_split(df, key, target, fraction, seed))
    features, train, test = prepare_vectors(
        split.where(~F.col("is_test")), split.where("is_test"), key=key, target=target
    )
    fitted, scored = {}, []
    for name, fit in (builders or model_builders(key)).items():
        try:
            model = fit(train)
        except Exception as error:
            print(f"{name} left out: {type(error).__name__}")
            continue
        fitted[name] = model
        scored.append(predictions(model, test, name, key=key))
    if not scored:
        return None, None, {}, features, None
    every = materialize(reduce(lambda a, b: a.unionByName(b), scored))
    comparison = E.rank_models(E.model_metrics(every))
    best = comparison.where(F.col("rank") == 1).select("model").first()[0]
    return best, comparison, fitted, features, every


def benchmark_table(train: DataFrame, test: DataFrame, best: DataFrame, *, key: str, target: str) -> DataFrame:
    """Baselines and the chosen model in one metrics table; ``best`` holds its scored rows."""
    base = E.dummy_baselines(train, test, key=key, y=target)
    rule = E.length_rule_baseline(train, test, key=key, y=target)
    return E.model_metrics(base.unionByName(rule).unionByName(best), one_class=None)


def cross_val_f1(df: DataFrame, builders: dict, *, key: str, target: str, folds: int = 5, seed=42) -> DataFrame:
    """F1 mean and deviation per classifier over class-balanced folds, and whether its mean is the highest.

    Feature stages are fitted inside each fold. Some folds are worked on at a time, as most of their jobs are short.
    """
    folded = materialize(S.kfold_stratified(df, key, target, folds, seed))

    def scored(k):
        _, rest, hold = prepare_vectors(
            folded.where(F.col("fold") != k).drop("fold"), folded.where(F.col("fold") == k).drop("fold"), key=key, target=target
        )
        found = [predictions(fit(rest), hold, name, key=key).withColumn("fold", F.lit(k)) for name, fit in builders.items()]
        return E.confusion(reduce(lambda a, b: a.unionByName(b), found), ("model", "fold")).select("model", "fold", "f1").collect()

    with ThreadPool(FOLDS_AT_ONCE) as pool:
        per_fold = [r for rows in pool.map(inheritable_thread_target(df.sparkSession)(scored), range(folds)) for r in rows]
    table = df.sparkSession.createDataFrame(per_fold, "model string, fold int, f1 double")
    means = table.groupBy("model").agg(F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"))
    best = means.agg(F.max_by("model", F.struct("f1_mean", "model"))).scalar()
    return means.withColumn("best", F.col("model") == best)


def learning_curve(df: DataFrame, sizes, *, key: str, target: str, seed=42, caps=None, max_iter: int = 100) -> DataFrame:
    """Metrics of a logistic regression per training size, on the subset and on a fixed validation set."""
    split = materialize(S.stratified_split(df, key, target, 0.20, seed))
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    hold = S.capped_validation(test, key, target, caps, seed) if caps else test
    rows = []
    for size in sizes:
        subset = S.curve_subset(train, key, target, size, seed)
        features, fit_rows, hold_rows = prepare_vectors(subset, hold, key=key, target=target)
        model = logistic_regression(fit_rows, max_iter=max_iter)
        n = fit_rows.count()
        for part, rows_df in (("train", fit_rows), ("validation", hold_rows)):
            rows.append(predictions(model, rows_df, "logistic_regression", key=key).withColumns(
                {"n_train": F.lit(n).cast("bigint"), "split": F.lit(part)}
            ))
    scored = materialize(reduce(lambda a, b: a.unionByName(b), rows))
    by = ("n_train", "split")
    return E.model_metrics(scored, by).join(E.log_loss(scored, by), list(by)).select(
        "n_train", "split", "accuracy", "f1", "roc_auc", "log_loss"
    )


def _campaign_vectors(train: DataFrame, test: DataFrame, categorical, numeric, targets):
    # Both parts are reduced by the training frequencies, all columns by one pass; then the narrow rows are written once.
    rare = rare_values(train, categorical)
    keep = ["row_id", *dict.fromkeys([*categorical, *numeric, *targets])]
    train, test = (materialize(mark_infrequent(part, rare, categorical).select(keep)) for part in (train, test))
    numbers = numeric_preprocessing(train, numeric)
    categories = categorical_preprocessing(train, categorical)
    model = PipelineModel([
        *numbers.stages, *categories.stages,
        VectorAssembler(inputCols=["numeric_vector", "category_vector"], outputCol="features"),
    ])
    keep = [*targets, "features"]
    return model, materialize(model.transform(train).select("row_id", *keep)), materialize(
        model.transform(test).select("row_id", *keep)
    )


def paid_regressor(
    train: DataFrame, test: DataFrame, *, categorical=fv.PAID_CATEGORICAL, numeric=fv.PAID_NUMERIC,
    targets=fv.PAID_TARGETS, trees: int = 350, depth: int = 4, rate: float = 0.045, subsample: float = 0.9,
    columns: float = 0.9, penalty: float = 1.5, seed=42,
):
    """One boosted-tree regressor per target over shared campaign features; needs ``row_id``.

    Returns (feature model, regressors, scored test rows with ``pred_<target>``).
    """
    features, fit_rows, hold = _campaign_vectors(train, test, categorical, numeric, targets)
    fitted = boosting.regressors(
        fit_rows, targets, [f"pred_{t}" for t in targets], rounds=trees, depth=depth, rate=rate, bins=256, hessian=1.0, penalty=penalty,
        rows_share=subsample, columns_share=columns, key="row_id", seed=seed,
    )
    scored, models = hold, dict(zip(targets, fitted))
    for m in fitted:
        scored = m.transform(scored)
    return features, models, scored.drop("features")


def metric_regressors(df: DataFrame, *, targets=("views_per_day", "engagement_rate", "like_rate", "comment_rate"), trees: int = 40, depth: int = 4, seed=42):
    """Expected pace and rates from the pre-publication feature set: (feature model, {target: regressor})."""
    features = assemble(df)
    rows = materialize(features.transform(df).select("features", *targets))
    fitted = boosting.regressors(rows, targets, [f"pred_{t}" for t in targets], rounds=trees, depth=depth, rate=0.1, seed=seed)
    return features, dict(zip(targets, fitted))


def apply_metric_regressors(df: DataFrame, features: PipelineModel, models: dict) -> DataFrame:
    out = features.transform(df)
    for m in models.values():
        out = m.transform(out)
    return out.drop("features")


def to_vectors(df: DataFrame, column: str = "embedding", output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(column).cast("array<double>")))


def pca(df: DataFrame, k: int = 50, features: str = "features", output: str = "reduced"):
    """(projected table, model); the model carries the explained variance."""
    model = PCA(k=k, inputCol=features, outputCol=output).fit(df)
    return model.transform(df), model


def kmeans(df: DataFrame, k: int = 6, features: str = "reduced", seed=42, output: str = "cluster"):
    model = KMeans(k=k, featuresCol=features, predictionCol=output, seed=seed, initSteps=5).fit(df)
    return model.transform(df), model


def elbow(df: DataFrame, ks=range(3, 12), features: str = "reduced", seed=42) -> DataFrame:
    """Inertia per number of clusters; the input should be materialised."""
    rows = [(k, float(kmeans(df, k, features, seed)[1].summary.trainingCost)) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def embedding_classifier(train: DataFrame, *, c: float = 1.0, max_iter: int = 100):
    """Logistic regression straight on dense vectors (label, weight, features)."""
    return logistic_regression(train, c=c, max_iter=max_iter)


def linear_attribution(df: DataFrame, coefficients, *, background: DataFrame | None = None, names=None, top: int = 20) -> DataFrame:
    """Mean absolute contribution w * (x - mean) per feature, largest first."""
    mean = (background if background is not None else df).select(Summarizer.mean(F.col("features")).alias("m")).first()[0]
    w = F.lit([float(v) for v in coefficients])
    m = F.lit([float(v) for v in mean])
    x = vector_to_array("features")
    parts = F.zip_with(F.zip_with(x, m, lambda a, b: a - b), w, lambda d, v: F.abs(d * v))
    means = df.select(array_to_vector(parts).alias("v")).select(Summarizer.mean(F.col("v")).alias("m"))
    ranked = means.select(F.posexplode(vector_to_array("m")).alias("position", "importance"))
    if names:
        table = F.lit(list(names))
        ranked = ranked.withColumn("feature", F.get(table, F.col("position")))
    else:
        ranked = ranked.withColumn("feature", F.concat(F.lit("f"), F.col("position").cast("string")))
    return ranked.select("feature", "importance").orderBy(F.desc("importance"), "feature").limit(top)


def permutation_importance(df: DataFrame, score, columns, *, key: str, repeats: int = 5, seed=42) -> DataFrame:
    """Mean F1 drop per numeric column when its values are dealt to other rows, over all columns and repeats in one pass.

    ``score`` maps a table to rows with y and pred and hands the columns ``feature`` and ``run`` through. Rows stand in a
    hash order; repeat r gives each row the values of the row so many places further on, so one join by place serves all
    columns, and the copies of a row for each column are made after it. Null keys are ordered like others; a table of
    fewer than two rows has nothing to deal.
    """
    ranked = materialize(hash_rank(df, hash_order(key, f"{seed}base"), F.lit("all"), "_at"))
    first, n = ranked.agg(F.min("_at"), F.count("*")).first()
    if n < 2:
        return df.sparkSession.createDataFrame([(c, 0.0) for c in columns], "feature string, importance double")
    deal = Random(f"{seed}-{n}")
    shifts = [deal.randrange(1, n) for _ in range(repeats)]
    runs = F.array(*(F.struct(F.lit(r).alias("run"), F.lit(d).cast("long").alias("shift")) for r, d in enumerate(shifts)))
    values = ranked.select(F.col("_at").alias("_from"), F.struct(*(F.col(c).cast("double").alias(c) for c in columns)).alias("_moved"))
    rows = ranked.withColumn("_run", F.explode(runs)).withColumn("_from", F.pmod(F.col("_at") - first + F.col("_run.shift"), F.lit(n)) + first)
    dealt = rows.join(values, "_from").withColumns({"run": F.col("_run.run"), "feature": F.explode(F.array(*map(F.lit, columns)))})
    moved = {c: F.when(F.col("feature") == c, F.col(f"_moved.{c}")).otherwise(F.col(c).cast("double")) for c in columns}
    scored = score(dealt.withColumns(moved).drop("_at", "_from", "_run", "_moved"))
    plain = score(ranked.drop("_at").withColumns({"run": F.lit(-1), "feature": F.lit("")}))
    f1 = materialize(E.confusion(scored.unionByName(plain), ("feature", "run")).select("feature", "run", "f1"))
    start = f1.where("run = -1").select("f1")
    return f1.where("run >= 0").groupBy("feature").agg((start.scalar() - F.avg("f1")).alias("importance"))


def normal_of(key: str, salt) -> Column:
    """Standard normal number from a hash of the key: the same for a row however the table is partitioned."""
    def uniform(part):
        return (F.pmod(F.xxhash64(F.col(key), F.lit(f"{salt}{part}")), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.log(uniform("a"))) * F.cos(2 * F.pi() * uniform("b"))


def noise_robustness(df: DataFrame, score, columns, sigmas=(0.0, 0.05, 0.10, 0.20, 0.35), *, key: str, reference: DataFrame | None = None, seed=42) -> DataFrame:
    """F1 per noise level: every numeric column gets N(0, sigma * its deviation in ``reference``). Meant for held-out rows."""
    stats = (reference if reference is not None else df).agg(
        *[F.coalesce(F.stddev_samp(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns]
    ).first()
    rows = []
    for s in sigmas:
        noisy = df
        if s > 0:
            noisy = df.withColumns({
                c: F.col(c).cast("double") + normal_of(key, seed + i) * (s * float(stats[c])) for i, c in enumerate(columns)
            })
        rows.append(E.confusion(score(noisy)).select(F.lit(float(s)).alias("sigma"), "f1"))
    return reduce(lambda a, b: a.unionByName(b), rows)
