"""Groups and texts beyond what used to be cut off."""

from reelscope.operators import channels, sampling, sentiment


def test_all_comments_and_whole_texts_count(spark):
    long = " ".join(["palabra"] * 200 + ["distinta"])
    rows = [("v", i, "bueno" if i else long) for i in range(130)] + [("v", 200, "  ")]
    df = spark.createDataFrame(rows, "video_id string, position int, text string")
    scored = sentiment.score_comments(sentiment.written_comments(df))
    assert sentiment.sentiment_summary(scored).first().total == 130
    words = {r.word: r.n for r in sentiment.top_words(scored, keys=("video_id",)).collect()}
    assert words["palabra"] == 200 and words["distinta"] == 1


def test_recent_uploads_have_no_hidden_limit(spark):
    df = spark.range(120).selectExpr("'c' AS channel_id", "cast(id AS string) AS video_id", "timestamp_seconds(id) AS published_at")
    assert channels.recent_n(df, 80).count() == 80


def test_samplers_do_not_shuffle_rows_on_the_class(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 10 = 0, 'a', 'b') AS y", "repeat('x', 100) AS wide")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        for out in (sampling.stratified_split(df, "id", "y"), sampling.three_way_split(df, "id", "y")):
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan
        assert sampling.stratified_split(df, "id", "y").where("is_test and y = 'a'").count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
