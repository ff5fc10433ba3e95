"""run() against a plain version of its stages."""

from collections import Counter

import plain as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelscope.llm import near_copies

SF = "/root/testdata/sf0.001"


def test_run_matches_plain_version(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {d: r.text for d, r in docs.items() if any(c.isalpha() for c in r.text)}
    fps = {d: P.fingerprint(t) for d, t in texts.items()}
    root = P.linked(fps.values())
    best = {}
    for d in sorted(texts):
        best.setdefault(root[fps[d]], d)
    kept = {}
    for d in best.values():
        n, hit, *_ = P.leaks(texts[d], bench)
        if hit <= 0.5 * n:
            kept[d] = n - hit
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= set(kept)
    assert all(len(P.folded(r.text)) == kept[r.doc_id] and not P.leaks(r.text, bench)[1] for r in out)
    copies = Counter(r.doc_id for r in out)
    assert max(copies.values()) <= 3
    size = Counter()
    for r in out:
        size[r.source] += len(P.plain(r.text))
    # texts as the mix saw them: rebuilt from what stays and, for those it left out, from the originals
    text = {d: texts[d] for d in kept} | {r.doc_id: r.text for r in out}
    want = P.mix([(docs[d].source, len(P.plain(text[d]))) for d in kept])
    assert sum(size.values()) == pytest.approx(sum(want.values()), rel=0.15)
    by = Counter()
    for r in out:
        by[r.shard] += r.bytes
    assert set(by) <= set(range(8)) and max(by.values()) - min(by.values()) <= 2 * max(r.bytes for r in out)
    assert sorted((r.shard, r.slot) for r in out) == sorted({(r.shard, r.slot) for r in out})


def test_stages_take_nulls_repeats_and_no_rows(spark):
    rows = [(None, "a b c d e", "en", None, None), (None, None, None, "s", 3), (1, "the same text here now", "en", "s", 1), (1, "the same text here now", "en", "s", 1), (2, "", "en", "s", 0), (3, "12 !", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, SF)
            out.collect()
            if k < 4:
                assert out.columns == docs.columns
    kept = corpus_pipeline.by_language(spark, docs, SF).select("text").distinct().collect()
    assert {r.text for r in kept} == {"a b c d e", "the same text here now"}
    assert corpus_pipeline.without_near_duplicates(spark, docs, SF).where(F.col("doc_id") == 1).count() == 1


def shingled(text, k=5):
    w = P.plain((text or "").translate(P.LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def test_near_copies_match_all_pairs(spark):
    """Jaccard of 5-word shingles, every pair compared: no link of 0.8 or more is left out, none below joins."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingled(r.text) for r in docs.collect()}
    holders, root = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for d, s in sets.items():
        for o in {o for x in s for o in holders[x] if o < d}:
            if len(s & sets[o]) >= 0.8 * len(s | sets[o]):
                near += s != sets[o]
                a, b = sorted((find(d), find(o)))
                root[b] = a
    assert near >= 12
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {d: find(d) for d in sets}
    kept = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()}
    assert kept == {d for d in sets if find(d) == d}


def test_rows_that_share_an_id_keep_their_texts(spark):
    a, b = "one two three four five six seven", "all other words stand in this text"
    rows = [(7, a), (7, b), (7, b), (3, a), (None, "x y z"), (9, "x y z"), (8, "p q r"), (8, "s t u")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(3, a), (7, b), (8, "p q r"), (8, "s t u"), (9, "x y z")]
