"""Every operator against its plain version on the smallest tables and on awkward rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain as P
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from oracle_check import compare, connect
from reelscope.llm import decontaminate as de
from reelscope.llm import language_id, license_scan, lm_score, mixing, preferences, queries, sharding, simhash, substrings, topk

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, shard int, h string, size string, taken string"
WORDS = "the of and to in is it for on with as was at by this that from have are not be or which you an all were when we there can".split()


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randrange(50)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeats, many copies, names that operators use themselves."""
    base, item = words(60, 1), words(12, 9)
    texts = [None, "", "   \t", "one", "one two three", base, base, base.replace(" ", "  "), base + " end", words(30_000, 2), "123 !!", "ÄÖ é", item + " " + words(20, 3)]
    texts += ["Released under the MIT License. under the mit license", "Apache License, Version 2.0; CC-BY-NC", "x " * 40, "x " * 41, "<|end|> <|"]
    rows = [(i, t, None if i % 4 == 0 else "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 3}", None, None, None, None, None) for i, t in enumerate(texts)]
    rows += [(100 + i, base, "en", "s1", 1, 1, "h", "z", "t") for i in range(60)]
    return spark.createDataFrame(rows, DOC).repartition(7).persist()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, words(12, 9)), (2, "one two"), (10, words(12, 9)), (3, ""), (4, None), (None, "x x x"), (5, words(60, 1))], "item_id long, text string")


def docs_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    assert compare(contract.queries()[name](spark, SF).toPandas(), connect(SF).execute(queries.ORACLES[name]).df()) is None


def test_mixing(spark, odd):
    for df in (odd, real(spark)):
        docs, slots = mixing.mix(mixing.sized(df), block=16)
        got = docs.collect()
        want = P.mix([(r.source, r.size) for r in got])
        taken, size = defaultdict(int), {r.doc_id: len(P.plain(t)) for r, t in zip(df.collect(), [r.text for r in df.collect()], strict=True)}
        for r in got:
            assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] and r.target == pytest.approx(want[r.source])
            taken[r.source] += r.taken
        assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())
        assert slots.agg(F.sum("words")).first()[0] == sum(taken.values())
        assert slots.count() == slots.select("source", "rank").distinct().count()
        assert sorted(map(tuple, mixing.mix(mixing.sized(df.repartition(3)), block=16)[0].collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixing_schedule_is_even(spark):
    plan = spark.createDataFrame([(0, 900_000, 900_000), (1, 100_000, 100_000)], "sno int, source_size long, goal long")
    slots = [r.sno for r in mixing.schedule(plan, 100).orderBy("slot").collect()]
    assert Counter(slots) == {0: 9000, 1: 1000}
    ones = np.cumsum(slots)
    assert abs(ones - 0.1 * np.arange(1, len(slots) + 1)).max() < 5


def test_preferences(spark):
    turn = lambda role, text: {"role": role, "text": text}
    a, b, c = turn("user", "hi"), turn("assistant", "yes"), turn("assistant", "no <|end|>")
    rows = [(1, [a, b], [a, c]), (2, [a, b], [a, b]), (3, [a, b], None), (4, [turn(None, None)], [turn(None, None), b]), (5, [], [a]), (6, [b, a, b], [c, a, b])]
    out = {r.id: r for r in preferences.format_preferences(spark.createDataFrame(rows, "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>").withColumn("prompt", F.lit("old"))).collect()}
    assert [out[i].n_common for i in range(1, 7)] == [1, 2, 0, 1, 0, 0]
    assert out[1].prompt == "<|user|>\nhi<|end|>\n" and out[1].chosen == "<|assistant|>\nyes<|end|>\n" and out[1].usable
    assert [out[1].chosen[s.a : s.b] for s in out[1].chosen_spans] == ["yes<|end|>\n"]
    assert [out[1].rejected[s.a : s.b] for s in out[1].rejected_spans] == ["no < |end|><|end|>\n"]
    assert out[2].chosen == out[2].rejected == "" and not out[2].usable and out[3].rejected == ""
    assert len(out[6].chosen_spans) == 2


def test_lm_scoring(spark, odd):
    docs = real(spark)
    got = {r.doc_id: r for r in lm_score.score_documents(docs).collect()}
    vocab = lm_score.vocabulary(docs)
    counts = lm_score.window_counts(docs, vocab)
    tokens = lm_score.Tokens(vocab)
    want = np.zeros(lm_score.TOKENS**3)
    for r in docs.collect():
        np.add.at(want, tokens.cells(r.text.encode()), 1)
    assert (counts.ravel() == want).all() and counts.sum() == sum(len(P.folded(r.text)) for r in docs.collect())
    net = lm_score.WindowNetwork()
    losses = net.fit(counts)
    unigram = counts.sum(0) / counts.sum()
    assert losses[-1] < -(unigram[unigram > 0] * np.log(unigram[unigram > 0])).sum() < losses[0] + 0.2
    logp = net.forward()[1].ravel()
    for r in docs.limit(20).collect():
        assert got[r.doc_id].log_likelihood == pytest.approx(logp[tokens.cells(r.text.encode())].sum(), rel=1e-4)
    ends = {r.doc_id: r for r in lm_score.score_documents(odd).collect()}
    assert ends[0].n_tokens == 0 and ends[0].per_token is None and ends[0].log_likelihood == 0 and len(ends) == odd.count()
    assert ends[100].log_likelihood == ends[101].log_likelihood


def test_network_gradient():
    net, rng = lm_score.WindowNetwork(), np.random.default_rng(0)
    counts = rng.integers(0, 3, (lm_score.TOKENS**2, lm_score.TOKENS)).astype(float)
    losses = net.fit(counts, 30)
    assert losses[-1] < losses[0]


def test_sharding(spark, odd):
    for df in (odd, real(spark)):
        raw = F.col("text").cast("binary")
        keyed = df.withColumns({"_size": (F.coalesce(F.length(raw), F.lit(0)) + 1).cast("long"), "_key": sharding.text_key(F.col("text"), F.col("doc_id"))}).drop("shard")
        rows = sharding.shard_by_bytes(keyed).collect()
        assert len(rows) == df.count()
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append((r.slot, r["_size"]))
        assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
        total, most = sum(r["_size"] for r in rows), max(r["_size"] for r in rows)
        assert all(abs(sum(n for _, n in by[k]) - total / 8) <= 2 * most + 0.1 * total / 8 for k in range(8))
        again = sharding.shard_by_bytes(keyed.repartition(3)).collect()
        assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in rows)
    got = contract.queries()["op4_sampled_splitters"](spark, SF).collect()
    texts = dict(docs_of(real(spark)))
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 1 and r.law == "bytes" for r in got)


def test_overfull_ranges_are_divided(spark):
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("doc_id"), F.when(F.col("id") < 12_000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"), F.lit(10).cast("long").alias("_size"))
    keyed = rows.withColumn("_key", sharding.text_key(F.col("text"), F.col("doc_id")))
    cuts = sharding.splitters_of(keyed, 200_000, 20_000)
    load = keyed.groupBy(sharding.range_of(F.col("_key"), cuts).alias("r")).count().toPandas()["count"]
    assert load.max() <= 4 * 20_000 / 20 / 2


def test_license_scan(spark, odd):
    for df in (odd, real(spark)):
        for r, t in zip(license_scan.license_scan(df.orderBy("doc_id").coalesce(1)).collect(), [t for _, t in sorted(docs_of(df))], strict=True):
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == P.license_base(t)
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_suppression():
    rules = license_scan.rules()
    assert len(rules) > 300 and len({r.label for r in rules}) > 60
    say = lambda t: license_scan.scan(t.encode(), rules)[5]
    assert say("This file is licensed under the GNU General Public License, version 3.") == "gnu-gpl-3"
    assert say("SPDX-License-Identifier: Apache-2.0") == "apache-2.0"
    assert say("licensed under a CC BY-SA 4.0 license") == "cc-by-sa-4.0"
    many = "cc by nc " * 20_000 + "licensed under the MIT license " * 20_000
    assert license_scan.scan(many.encode(), rules)[1:6] == (40_000, 0, 159_996, "cc-by-nc,mit", "cc-by-nc,mit")
    assert say("mit freundlichen Grüßen") == "" and say("All rights reserved") == "all-rights-reserved"


def test_license_rules_need_no_word_licence(spark):
    rules = license_scan.rules()
    label = lambda t: license_scan.scan(t.encode(), rules)[5:]
    assert label("Released under CC BY-SA 4.0") == ("cc-by-sa-4.0", 0.9) and label("distributed under the GNU GPL 3.0") == ("gpl-3.0", 0.9)
    assert label("this software is distributed under the terms of the BSD") == ("bsd", 0.95) and label("available under MIT") == ("mit", 0.9)
    assert label("this file is governed by the Apache 2.0") == ("apache-2.0", 0.95) and label("limit, submit under miscellaneous") == ("", 0.0)
    # every rule on its own matches, and the filters by words drop no match of any rule
    texts = [f"{a} {name} {v} {b}" for a in ("released under the", "this work is covered by", "spdx license identifier", "") for b in ("", "or any later version", "licence", "x") for name in ("mit", "gnu gpl", "lgpl", "affero general public license", "bsd 3 clause", "simplified bsd", "isc", "zlib libpng", "wtfpl", "creative commons cc0 1 0 universal", "cc by nc sa", "apache software", "unlicense", "proprietary", "sil open font license", "european union public licence", "creative commons attribution share alike") for v in ("", "2", "version 3 0", "v 1 1")]
    texts += [t.replace("licen", "") for t in texts] + ["all rights reserved", "released to the public domain", "mit by under spdx", "spdx"] + [r.text for r in real(spark).collect() if len(r.text) < 3000]
    for t in texts:
        joined = b" " + b" ".join(license_scan.folded_words(t.encode())) + b" "
        want = [r for r in rules if r.pattern.search(joined)]
        assert all(r.keyword in joined and any(n in joined for n in r.needs) for r in want)
        assert bool(license_scan.detections(joined, rules)) == bool(want)


def test_simhash(spark, odd):
    rng = random.Random(5)
    near = [(i, " ".join(w if rng.random() > 0.02 else "zz" for w in P.plain(words(400, 7)))) for i in range(300)]
    for df in (odd, real(spark), spark.createDataFrame(near, "doc_id long, text string")):
        docs = docs_of(df)
        fps = {d: P.fingerprint(t) for d, t in docs}
        root, low = P.linked(fps.values()), {}
        for d, f in fps.items():
            low[root[f]] = min(low.get(root[f], d), d)
        got = simhash.simhash_classes(df).collect()
        assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", low[root[f]]) for d, f in fps.items())


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(3)
    for dense in (1, 3, 6):
        seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        fps = np.unique(np.concatenate([seeds] + [seeds ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (dense, 40), dtype=np.uint64)) for _ in range(8)]))
        root = P.linked(fps.tolist())
        root_of = {f: f for f in fps.tolist()}

        def find(x):
            while root_of[x] != x:
                x = root_of[x]
            return x

        for a, b in simhash.trie_links(fps, None, 0, 4).tolist():
            root_of[find(a)] = find(b)
        same = lambda of: {frozenset(f for f in fps.tolist() if of(f) == r) for r in map(of, fps.tolist())}
        assert same(find) == same(root.get)


def test_hamming_links_split_hot_subtrees(spark):
    rng = np.random.default_rng(4)
    far = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    hot = far[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (5, 300), dtype=np.uint64))
    top = np.uint64(0xABCDEF << 40) | rng.integers(0, 1 << 20, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([far, hot, top, ~far[:5]]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(5)
    want = P.linked(fps.tolist())
    for per in (4, 64, 16384):
        nx = {f: f for f in fps.tolist()}

        def find(x):
            while nx[x] != x:
                x = nx[x]
            return x

        for r in simhash.hamming_links(df, per_subtree=per).collect():
            a, b = r.a % (1 << 64), r.b % (1 << 64)
            assert want[a] == want[b]
            nx[find(a)] = find(b)
        assert len({find(f) for f in nx}) == len(set(want.values()))


def test_bit_orders_cover_every_pair_within_the_budget():
    rng = np.random.default_rng(6)
    for equal in (1, 2, 3):
        plans, exact = simhash.orders(4, equal)
        for _ in range(200):
            x = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
            y = x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 4, dtype=np.uint64))
            lead = [(simhash.moved(x, p) ^ simhash.moved(y, p))[0] >> np.uint64(64 - exact) for p in plans]
            assert 0 in lead
            assert all(simhash.moved(simhash.moved(x, p), [(c, w, a) for a, w, c in p]) == x for p in plans)


def test_decontamination(spark, odd, items, monkeypatch):
    bench = [(r.item_id, r.text) for r in items.collect()]
    for limit in (8 << 20, 40):
        monkeypatch.setattr(de, "AUTOMATON_BYTES", limit)
        out = de.decontaminate(odd.withColumn("n_hit", F.lit(7)), items).collect()
        assert len(out) == odd.count()
        for r in out:
            n, hit, k, digest, bad = P.leaks(r.text, bench)
            assert (r.n_words, r.n_hit, len(r.hit_items)) == (n, hit, k)
            assert bad == (r.n_hit > 0) and (r.clean_text == r.text) == (not bad)
            assert not bad or P.folded(r.clean_text) == [w for i, w in enumerate(P.folded(r.text)) if not any(a <= i < b for a, b in r.hit_spans)]
    got = contract.queries()["op7_suffix_automaton"](spark, SF).collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = dict(docs_of(real(spark)))
    assert all((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == P.leaks(texts[r.doc_id], bench) for r in got)
    assert sum(r.contaminated for r in got) > 0


def test_topk(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [tuple(r) for r in contract.queries()["op8_cover_tree_topk"](spark, SF).collect()]
    assert sorted(got) == sorted(P.top_products(rows))
    rng = np.random.default_rng(1)
    odd = [(i, [1.0, 0.5, -0.25]) for i in range(300)] + [(300 + i, rng.normal(size=3).tolist()) for i in range(400)]
    odd += [(1000, None), (1050, [1.0, None, 2.0]), (1100, [float("nan"), 0.0, 0.0]), (1150, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    out = topk.nearest_by_product(df.select("vec_id", topk.quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, out.collect())) == sorted(P.top_products(odd))
    few = df.where("vec_id in (0, 1, 2)").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    assert [(r.rank, r.vec_id) for r in topk.nearest_by_product(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_cover_tree_invariants():
    x = np.random.default_rng(2).normal(size=(900, 5))
    tree = topk.CoverTree(x)
    assert sorted(tree.order) == list(range(900)) and sum(not k for k in tree.kids) > 10
    for a, b, centre, radius in tree.nodes:
        assert np.linalg.norm(x[tree.order[a:b]] - x[centre], axis=1).max() <= radius + 1e-9


def test_substrings(spark, odd):
    for df in (odd, real(spark)):
        out = substrings.substring_dedup(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("s"), "spans").collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.s) for r in out) == sorted(P.without_repeats(docs_of(df)))
        texts = {d: P.plain(t) for d, t in docs_of(df)}
        for r in out:
            for a, b, d, s in np.frombuffer(bytes(r.spans), "<i8").reshape(-1, 4).tolist():
                assert d < r.doc_id and texts[r.doc_id][a:b] == texts[d][s : s + b - a]


def test_language(spark, odd):
    docs = real(spark)
    model = language_id.train(docs, ~language_id.held_out())
    out = language_id.identify(docs.withColumn("score", F.lit("x")), model).withColumn("held_out", language_id.held_out()).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in out)
    a, b = (next(r.text for r in out if r.lang == v and len(r.text) > 3000)[:3000] for v in ("en", "fr"))
    shares = model.infer(a + "\n" + b)[2]
    assert set(shares) == {"en", "fr"} and all(0.3 < v < 0.7 for v in shares.values())
    und = {r.doc_id: r.lang_pred for r in language_id.identify(odd, model).collect()}
    assert all(model.infer(t)[0] == "und" for t in ("½ ² ③ 12", "_", "。")) and model.infer("ª")[0] != "und"
    assert all(und[i] == "und" for i in (0, 1, 2, 10)) and und[3] != "und"
    empty = language_id.train(docs, F.lit(False))
    assert language_id.identify(docs.limit(1), empty).first().lang_pred == "und"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    vectors = spark.createDataFrame([], "vec_id long, v array<long>")
    items = spark.createDataFrame([], "item_id long, text string")
    keyed = docs.drop("shard").withColumns({"_size": F.lit(1).cast("long"), "_key": F.lit("")})
    results = [
        mixing.mix(mixing.sized(docs))[0], mixing.mix(mixing.sized(docs))[1], lm_score.score_documents(docs), sharding.shard_by_bytes(keyed), license_scan.license_scan(docs),
        simhash.simhash_classes(docs), de.decontaminate(docs, items), topk.nearest_by_product(vectors, F.col("vec_id") % 50 == 0), substrings.substring_dedup(docs),
        language_id.identify(docs, language_id.train(docs, F.lit(True))), preferences.conversations_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_ten_queries_are_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
