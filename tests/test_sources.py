import json

from reelscope.sources import corpus


def test_transcript_shapes(spark, tmp_path):
    docs = {
        "a": [{"text": "hola"}, {"text": "mundo"}], "b": ["uno", "dos"], "c": {"transcript": " x  y "}, "d": {"text": "t"},
        "e": {"segments": [{"text": "s1"}, {"text": "s2"}]}, "f": [],
    }
    for k, v in docs.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v), encoding="utf-8")
    (tmp_path / "g.json").write_text("{broken", encoding="utf-8")
    got = {r.video_id: r.transcript for r in corpus.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"a": "hola mundo", "b": "uno dos", "c": "x y", "d": "t", "e": "s1 s2"}


def test_corpus_union(spark, tmp_path):
    (tmp_path / "b.csv").write_text("video_id,views\nv1,3\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text('video_id,title\nv2,"x, ""y"""\n', encoding="utf-8")
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    rows = corpus.read_corpus(spark, str(tmp_path)).collect()
    assert {(r.video_id, r.views, r.title, r.source_file) for r in rows} == {("v1", "3", None, "b.csv"), ("v2", None, 'x, "y"', "a.csv")}
