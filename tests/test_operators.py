import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from reelscope import fixed_values as fv
from reelscope.functions import numeric as N
from reelscope.functions import temporal as D
from reelscope.functions import text as T
from reelscope.functions.terms import TermIndex
from reelscope.operators import decision as DEC
from reelscope.operators import dedup as U
from reelscope.operators import evaluation as E
from reelscope.operators import policy as P
from reelscope.operators import sampling as S
from reelscope.operators import sentiment as M
from reelscope.operators.labels import organic_score_label
from reelscope.operators.normalize import rename_aliases, validate_dataset
from reelscope.operators.ordering import exact_quantiles, previous_value


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_safe_float(spark):
    raw = ["", "abc", "NaN", "inf", "2.5", " 3 ", None, "1d"]
    got = values(spark, [(x,) for x in raw], "x string", N.safe_float("x", 9.0))
    assert got == [9.0, 9.0, 9.0, 9.0, 2.5, 3.0, 9.0, 9.0]


def test_text_counts(spark):
    r = one(spark, T.word_count(F.lit("Año nuevo, ¡sí!")), T.uppercase_ratio(F.lit("AbÑ1")), T.token_count(F.lit("  a b ")))
    assert list(r) == [3, round(2 / 3, 4), 2]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "dQw4w9WgXcQ"),
        ("https://youtu.be/dQw4w9WgXcQ", "dQw4w9WgXcQ"),
        ("https://www.youtube.com/shorts/dQw4w9WgXcQ", "dQw4w9WgXcQ"),
        ("https://m.youtube.com/watch?v=dQw4w9WgXcQ", "dQw4w9WgXcQ"),
        ("dQw4w9WgXcQ", "dQw4w9WgXcQ"),
        ("not a url", None),
        ("https://youtu.be/short", None),
    ],
)
def test_video_id(spark, url, expected):
    assert one(spark, T.extract_video_id(F.lit(url)))[0] == expected


def test_durations_and_dates(spark):
    d = ["PT1M05S", "PT45S", "PT2H", "PT", "", "x"]
    assert values(spark, [(x,) for x in d], "x string", T.iso_duration_seconds("x")) == [65, 45, 7200, 0, None, None]
    t = ["2024-01-01T00:00:00Z", "20240101", "1704067200", "1704067200000", "bad", None]
    got = values(spark, [(x,) for x in t], "x string", F.unix_micros(D.parse_ts("x")))
    assert got == [1704067200000000] * 4 + [None, None]


def test_term_index_counts_each_term_once(spark):
    index = TermIndex({"a": ("compra", "comprar", "x"), "b": ("ora",)})
    df = spark.createDataFrame([("COMPRAR comprar",), ("ahora",), (None,)], "t string").withColumn("f", index.scan("t"))
    got = [tuple(r) for r in df.select(index.hits("f", "a"), index.any("f", "b")).collect()]
    assert got == [(2, 0), (0, 1), (0, 0)]


def reference_score(text):
    """Independent row-wise version of the comment rule with its mutable loop."""
    import re

    clean = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower())).strip()
    words = clean.split()
    if not words:
        return 0.0
    pos = sum(t in clean for t in fv.SENTIMENT_POSITIVE_TERMS)
    neg = sum(t in clean for t in fv.SENTIMENT_NEGATIVE_TERMS)
    for i, w in enumerate(words):
        if w in fv.SENTIMENT_NEGATORS and any(t in " ".join(words[i + 1:i + 5]) for t in fv.SENTIMENT_POSITIVE_TERMS):
            neg, pos = neg + 1, max(0, pos - 1)
    boost = 1 + 0.3 * sum(w in fv.SENTIMENT_INTENSIFIERS for w in words)
    return max(-1.0, min(1.0, (pos - neg) * boost / max(pos + neg, 1)))


def test_comment_score_equals_loop(spark):
    texts = [
        "no no me encanta", "muy bueno, excelente y genial", "no a b c d excelente", "no a b c excelente", "???", "",
        "no sirve, horrible", "never great never love", "top top", "sin gracias ni excelente no genial", "like dislike",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.score_raw for r in M.score_comments(df).select("i", "score_raw").collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(reference_score(t)), t


def test_sentiment_tie_rules(spark):
    rows = [("a", "positivo", 1.0), ("a", "negativo", -1.0), ("b", "positivo", 1.0), ("b", "neutro", 0.0)]
    out = M.sentiment_summary(spark.createDataFrame(rows, "video_id string, label string, score double"))
    assert {r.video_id: r.sentimiento_dominante for r in out.collect()} == {"a": "positivo", "b": "neutro"}


def test_policy_levels(spark):
    rows = [(1, "un video normal"), (2, "esto es increíble"), (3, "cocaina"), (4, "cocaina, porno y betting"), (5, "")]
    df = spark.createDataFrame(rows, "i int, t string")
    out = P.policy_risk(df, "t", F.lit(True)).select("i", "policy.policy_risk_level", "policy.evaluation_coverage").collect()
    assert {r.i: r.policy_risk_level for r in out} == {1: "bajo", 2: "medio", 3: "alto", 4: "revisión humana", 5: "bajo"}
    assert {r.i: r.evaluation_coverage for r in out}[5] == "ninguna"


@pytest.mark.parametrize(
    "score, level, adjust, missing, text, expected",
    [
        (0.9, "revisión humana", False, False, True, DEC.REVIEW),
        (0.9, "bajo", False, True, False, DEC.REVIEW),
        (0.9, "alto", False, False, True, DEC.NO),
        (0.65, "bajo", False, False, True, DEC.BOOST),
        (0.65, "bajo", True, False, True, DEC.ADJUST),
        (0.42, "medio", False, True, True, DEC.ADJUST),
        (0.41, "bajo", False, False, True, DEC.NO),
    ],
)
def test_final_action(spark, score, level, adjust, missing, text, expected):
    action = DEC.final_action(F.lit(score), F.lit(level), F.lit(adjust), F.lit(missing), F.lit(text))
    assert one(spark, action)[0] == expected


def test_levels_and_clip(spark):
    p = [0.85, 0.8499, 0.65, 0.40, 0.39]
    got = values(spark, [(x,) for x in p], "p double", DEC.probability_level(F.col("p")))
    assert got == ["muy_alto", "alto", "alto", "medio", "bajo"]
    assert one(spark, N.clip_probability(F.lit(2.0)), N.clip_probability(F.lit(float("nan"))), N.clip(F.lit(None).cast("double"), 0, 1))[:] == (0.98, 0.5, None)


def test_weights_sum_to_one():
    assert math.isclose(sum(fv.HYBRID_WEIGHTS.values()), 1.0)
    assert math.isclose(sum(fv.LABEL_WEIGHTS.values()), 1.0)


def test_exact_quantiles_match_builtin(spark):
    df = spark.range(5000).select(
        F.expr("CASE WHEN id % 3 = 0 THEN 0.25D ELSE pow(-1, id) * exp((id % 700) / 50D) END").alias("x"), (F.col("id") % 7).alias("y")
    )
    probs = [0.0, 0.02, 0.333, 0.5, 0.7, 0.98, 1.0]
    want = df.select(F.percentile("x", probs), F.percentile("y", probs)).first()
    got = {(r.column, r.prob): r.quantile for r in exact_quantiles(df, ["x", "y"], probs).collect()}
    for c, w in zip(("x", "y"), want):
        assert [got[c, p] for p in probs] == pytest.approx(list(w))


def test_splits_are_exact_disjoint_and_stable(spark):
    df = spark.range(1003).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    out = S.stratified_split(df, "id", "y", 0.20)
    n = {r.y: (r.t, r.n) for r in out.groupBy("y").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()}
    assert n == {0: (150, 752), 1: (50, 251)}
    again = S.stratified_split(df.repartition(5), "id", "y", 0.20)
    assert out.where("is_test").select("id").exceptAll(again.where("is_test").select("id")).count() == 0
    folds = S.kfold_stratified(df, "id", "y", 5).groupBy("y", "fold").count().collect()
    assert len(folds) == 10 and max(r["count"] for r in folds if r.y == 0) - min(r["count"] for r in folds if r.y == 0) <= 1
    small = S.shuffle_split(spark.range(8), "id", 0.5)
    assert small.where("is_val").count() == 1


def test_dedup_is_idempotent_and_keeps_best(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("a", 3.0, 1), ("b", None, 1)], "video_id string, views double, t int")
    once = U.dedup_latest(df, "video_id", "views", ("t",))
    assert sorted(map(tuple, once.collect())) == [("a", 3.0, 1), ("b", None, 1)]
    assert once.exceptAll(U.dedup_latest(once, "video_id", "views", ("t",))).count() == 0
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_auc_and_psi_invariants(spark):
    df = spark.range(400).select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.md5(F.col("id").cast("string")).substr(1, 1).cast("string")).alias("h"))
    df = df.select("y", (F.ascii("h") / 120.0).alias("proba"), F.lit(1).alias("pred"))
    a = E.roc_auc(df).first()[0]
    b = E.roc_auc(df.withColumn("proba", 1 - F.col("proba"))).first()[0]
    assert a + b == pytest.approx(1.0)
    assert E.roc_auc(df.where("y = 1"), one_class=None).first()[0] is None
    assert E.psi(df, df, "proba").first()["psi"] == pytest.approx(0.0)


def test_fuzzy_and_containment_dedup(spark):
    lines = ["Oferta de hoy", "oferta de hoy", "oferta", "Oferta de hoi", "Otra cosa"]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    r = df.select(U.containment_dedup("l"), U.fuzzy_line_dedup("l")).first()
    assert r[0] == ["Oferta de hoy", "Oferta de hoi", "Otra cosa"]
    assert r[1] == ["Oferta de hoy", "Otra cosa"]


def test_previous_value_crosses_chunks(spark):
    df = spark.range(50).select(F.lit("v").alias("k"), (F.col("id") * 3).alias("i"), F.col("id").alias("x"))
    out = previous_value(df, ["k"], "i", "x", "p", chunk=7).orderBy("i").collect()
    assert [r.p for r in out] == [None, *range(49)]


def test_aliases_and_validation(spark):
    df = spark.createDataFrame([(1, 2, 3)], "view_count int, views int, likes_count int")
    assert rename_aliases(df).columns == ["view_count", "views", "likes"]
    with pytest.raises(ValueError):
        validate_dataset(spark.range(5).withColumn(fv.TARGET, F.lit(1)))


def test_label_rate_follows_percentile(spark):
    cols = {c: F.pmod(F.hash("id", F.lit(c)), F.lit(1000)) / 1000.0 for c in fv.LABEL_WEIGHTS}
    df = spark.range(1000).select("id", *[v.alias(k) for k, v in cols.items()])
    rate = organic_score_label(df, 0.70).agg(F.avg(fv.TARGET)).first()[0]
    assert rate == pytest.approx(0.30, abs=0.002)


def test_stream_equals_batch(spark, tmp_path):
    from reelscope.streaming import score_stream

    rows = [Row(video_id=str(i), title="Compra hoy", description="oferta", views=float(i), likes=1.0, comments=0.0, duration_seconds=5.0, category_id="x", published_at=None) for i in range(20)]
    schema = "video_id string, title string, description string, views double, likes double, comments double, duration_seconds double, category_id string, published_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = score_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "2024-02-01")
    q = stream.select("video_id", "probability").writeStream.format("memory").queryName("scored_stream").start()
    q.processAllAvailable()
    q.stop()
    batch = score_stream(spark.read.parquet(f"{tmp_path}/in"), "2024-02-01").select("video_id", "probability")
    assert spark.table("scored_stream").exceptAll(batch).count() == 0
