"""Toxicity by nearest examples, centroid clustering and cross-tokenizer alignment against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import plain as P
import pytest
from pyspark.sql import functions as F

from reelscope.llm import alignment, centroids, queries, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, score string, n_a long, holders long, text_id string, evidence string, t string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long, repeated and hot texts, texts that a tokenizer changes, names that the operators use."""
    base = "The quick brown fox, isn't it? 12345 naïve café\n\tdone"
    texts = [None, None, "", "   ", base, base, "ﬁ ﬂ", "x▁y", "日本語 text 🎉🎉", "<s> </s> <|endoftext|> <unk>", "a" * 3000, " " * 500, "\x00\x01 z", "word " * 6000, "é é"]
    rows = [(i if i % 7 else None, t, *["z", "s", 1, 2, "k", "v", "w"]) for i, t in enumerate(texts)]
    rows += [(100 + i, base, *["z", "s", 1, 2, "k", "v", "w"]) for i in range(50)]
    return spark.createDataFrame(rows, DOC).repartition(5).persist()


def test_alignment(spark, odd, monkeypatch):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        want = sorted(P.align([(r.doc_id, r.text) for r in df.collect()]), key=str)
        assert rows_of(alignment.align(df)) == want
        monkeypatch.setattr(alignment, "COMMON", 40)  # most pairs by key
        assert rows_of(alignment.align(df)) == want
        monkeypatch.setattr(alignment, "COMMON", 0)
        monkeypatch.setattr(alignment, "HOT", 1)  # no text is hot
        assert rows_of(alignment.align(df)) == want
        monkeypatch.undo()


def test_alignment_of_no_rows(spark, odd):
    assert alignment.align(odd.limit(0)).count() == 0
    assert rows_of(alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_links_of_a_group_without_cuts():
    """Ids of one long group are tallied before they are paired."""
    r = random.Random(3)
    a, b = np.array([r.randrange(5) for _ in range(4000)]), np.array([r.randrange(6) for _ in range(3000)])
    pairs, times = alignment.linked_pairs(a, np.zeros(4000, np.int64), b, np.zeros(3000, np.int64))
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == {x << 32 | y: ca[x] * cb[y] for x in ca for y in cb}


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(i % 5, 1) for _ in range(64)]) for i in range(300)] + [(9, [1.5] * 64)] * 40
    rows += [(500, None), (501, [None] * 64), (502, [float("nan")] * 64), (503, [float("inf")] + [0.0] * 63), (504, [1.0] * 63), (505, []), (None, [0.25] * 64)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("x"), "cluster": F.lit(1), "lead": F.lit(0)}).repartition(6).persist()


def test_clusters(spark, vectors):
    for df in (vectors, spark.read.parquet(f"{SF}/embeddings.parquet")):
        want = sorted(P.clusters([(r.vec_id, r.embedding) for r in df.collect()]), key=str)
        assert rows_of(centroids.cluster_vectors(df)) == want
        assert rows_of(centroids.cluster_vectors(df.repartition(3), leading=2)) == want


def test_few_far_and_no_vectors(spark, vectors):
    few = vectors.where("vec_id in (1, 2, 9)")
    assert rows_of(centroids.cluster_vectors(few)) == sorted(P.clusters([(r.vec_id, r.embedding) for r in few.collect()]), key=str)
    assert centroids.cluster_vectors(vectors.where("vec_id = 500")).count() == 0
    far = centroids.cluster_vectors(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.distance) for r in far.collect()) == [(1, 0), (2, 0)]


def test_bounds_stay_below_distances():
    rng = np.random.default_rng(2)
    v, c = rng.integers(-(1 << 20), 1 << 20, (400, 64)), rng.integers(-(1 << 20), 1 << 20, (16, 64))
    v[:16], v[16:32] = c, c + 1
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    for leading in (1, 8, 64):
        turn = centroids.Rotation(v.mean(0), axes, leading)
        true = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (centroids.lower_bounds(*turn(v.astype(float)), *turn(c.astype(float))) <= true).all()
        cluster, d, looked = centroids.nearest(v, *turn(v.astype(float)), c, *turn(c.astype(float)))
        assert (cluster == true.argmin(1)).all() and (d == true.min(1)).all()
    assert looked < 2 * len(v)


def test_index_equals_all_cosines():
    r = random.Random(8)
    counts = [Counter({r.randrange(60): r.randrange(1, 5) for _ in range(r.randrange(0, 12))}) for _ in range(300)] + [Counter({1: 2})] * 50
    idf = np.array([1 + r.random() for _ in range(60)])
    vectors = [toxicity.unit(c, idf) for c in counts]
    dense = np.zeros((len(vectors), 60))
    for row, (f, w) in zip(dense, vectors, strict=True):
        row[f] = w
    index = toxicity.BlockMaxIndex(vectors, 60, 16)
    for q, (f, w) in enumerate(vectors):
        cosine = (dense @ dense[q]).round(9)
        want = [(c, e) for c, e in sorted(((c, e) for e, c in enumerate(cosine.tolist()) if e != q), key=lambda x: (-x[0], x[1])) if c > 0][:7]
        got = index.top(f, w, 7, without=q)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-8)
        assert [cosine[e] for _, e in got] == pytest.approx([s for s, _ in want], abs=1e-8)
    same = index.top(*toxicity.unit(Counter({1: 2}), idf), 5)
    assert [e for s, e in same if s > 1 - 1e-9] == sorted(e for e in range(len(vectors)) if dense[e, 1] > 1 - 1e-9)[:5]


def test_calibration_rises_and_meets_the_labels():
    ones = [(i, int(i % 10 == 0), Counter({i % 3: 1})) for i in range(200)]
    m = toxicity.ToxicityModel([b"aaaa", b"bbbb", b"cccc"], np.ones(3), ones, {0: 4.0, 1: 1.0})
    votes = np.array([m.vote(m.index.top(*m.vectors[i], 15, without=i)) for i in range(200)])
    m.calibrate(votes)
    assert (np.diff(m.shares) > 0).all() and m.base == pytest.approx(20 / (20 + 4 * 180))
    got = m.shares[m.votes.searchsorted(votes, "right") - 1]
    assert float(m.weights @ got / m.weights.sum()) == pytest.approx(m.base, abs=0.01)


def plain_score(m, text):
    """Score of a text with every example compared."""
    counts = Counter()
    for w in P.folded(text):
        w = b" " + w.encode() + b" "
        counts.update(m.features.number[w[i : i + n]] for n in toxicity.GRAMS for i in range(len(w) - n + 1) if w[i : i + n] in m.features.number)
    f, w = toxicity.unit(counts, m.idf)
    mine, cosine = dict(zip(f.tolist(), w.tolist(), strict=True)), []
    for e, (g, x) in enumerate(m.vectors):
        cosine.append((-round(sum(mine.get(a, 0) * b for a, b in zip(g.tolist(), x.tolist(), strict=True)), 12), e))
    near = [(-c, e) for c, e in sorted(cosine)[: toxicity.NEIGHBOURS] if c < 0]
    weights = [toxicity.HALF / (toxicity.HALF + 1 - c) for c, _ in near]
    vote = sum(x * m.labels[e] for x, (_, e) in zip(weights, near, strict=True)) / sum(weights) if near else -1
    return m.shares[max(i for i, v in enumerate(m.votes) if v <= vote + 1e-9 or i == 0)], near


def test_toxicity_matches_plain_version_and_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.train(docs.select("doc_id", "text"), labels)
    out = toxicity.score(docs.select("doc_id", "text"), m).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    for r in out[::9]:
        want, near = plain_score(m, r.text)
        assert r.score == pytest.approx(want, abs=1e-9)
        assert [e.cosine for e in r.evidence] == pytest.approx([c for c, _ in near], abs=1e-9)
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    unseen = [(r.score, marks[r.doc_id]) for r in out if r.doc_id in marks and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    ones, zeros = [s for s, y in unseen if y], [s for s, y in unseen if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert auc > 0.85 and np.mean([s >= 0.7 for s in zeros]) < 0.03
    taught = {e.doc_id for r in out for e in r.evidence}
    assert taught and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in taught)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs.select("doc_id", "text"), flipped)).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in out}


def test_document_frequencies_and_bounded_examples(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chosen = [b" the ", b"tion", b"the ", b" zzz"]
    df, n = toxicity.document_frequencies(docs.repartition(4), "text", chosen)
    padded = [" " + "  ".join(P.folded(r.text)) + " " for r in docs.collect()]
    assert n == len(padded) and df.tolist() == [sum(g.decode() in t for t in padded) for g in chosen]
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    texts, weights = toxicity.examples_of(docs, labels, "doc_id", "text", "toxic", 50)
    n = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert all(0 < v <= 50 for v in n.values()) and all(weights[y] * n[y] == pytest.approx(labels.where((F.col("toxic") == y) & ~toxicity.held_out()).count()) for y in n)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (8, None), (100, 1), (101, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0), labels.where("toxic = 1")):
        m = toxicity.train(odd, marks)
        out = toxicity.score(odd, m).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
        same = {r.score for r in out if r.text is None or not r.text.strip()}
        assert len(same) == 1
        assert toxicity.score(odd.limit(0), m).count() == 0
    assert toxicity.train(odd.limit(0), labels).score(b"any text")[0] == 0
    assert set(toxicity.score(odd, m).columns) == set(odd.columns)


def test_new_queries_are_registered():
    assert {"op11_nearest_examples", "op12_pca_centroids", "op13_align_tokens"} <= set(queries.QUERIES)
