"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.llm import decontaminate as de
from reelscope.llm import alignment, centroids, language_id, license_scan, lm_score, mixing, preferences, sharding, simhash, substrings, topk, toxicity
from reelscope.llm.common import utf8
from reelscope.session import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))[0].select("doc_id", "size", "source_size", "target", "taken")


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as chosen, against the same one with the last answer of its neighbour (2k and 2k + 1 are neighbours).

    Without an answer of its own or of its neighbour there is no rejected conversation.
    """
    convs = preferences.conversations_of(table(spark, sf_dir, "conversations"))
    answers = F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"].eqNullSafe(F.lit("assistant"))), True)
    convs = convs.withColumn("last", F.when(answers > 0, F.size("turns") - answers.cast("int") + 1))
    answer = convs.where("last is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.slice("turns", F.col("last"), F.lit(1)).alias("answer"))
    other = F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.col("answer"))
    pairs = convs.join(answer, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), other.alias("rejected"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["a"], s["b"])), ",")
    return preferences.format_preferences(pairs).select(
        "conv_id", F.col("n_common").cast("long"), "prompt", "chosen", "rejected",
        text("chosen_spans").alias("chosen_mask"), text("rejected_spans").alias("rejected_mask"), "usable",
    )


def op3_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = utf8("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.length(raw), F.lit(0)) + 1).cast("long").alias("_size"), F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"),
        sharding.text_key(F.col("text"), F.col("doc_id")).alias("_key"),
    )
    return sharding.shard_by_bytes(docs).select(
        "doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op7_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = de.decontaminate(docs, table(spark, sf_dir, "benchmark"), clean=False)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.nearest_by_product(vectors, F.col("vec_id") % 50 == 0, 5)


def op9_de_bruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, ~language_id.held_out() & F.col("doc_id").isNotNull())
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("evidence.doc_id").alias("evidence"))


def op12_pca_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_preference_format, op3_masked_likelihood, op4_sampled_splitters, op5_license_scan, op6_simhash_trie,
        op7_suffix_automaton, op8_cover_tree_topk, op9_de_bruijn_spans, op10_language_mixture, op11_nearest_examples, op12_pca_centroids,
        op13_align_tokens,
    )
}

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sno FROM d GROUP BY source
), w AS (
  SELECT *, CASE sno % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, CAST(3 * source_size AS DOUBLE) AS cap, sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, cap / w AS full_at,
    (total - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, sno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, sno LIMIT 1)) AS target FROM l
), g AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS goal FROM t
), p AS (
  SELECT d.*, g.source_size, g.target, g.goal,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (goal // greatest(source_size, 1)) * size + greatest(0, least(size, goal % greatest(source_size, 1) - start)) END AS BIGINT) AS taken
FROM p
"""

OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, role, text
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT conv_id, max(n) AS n FROM c WHERE role = 'assistant' GROUP BY conv_id
), answer AS (
  SELECT xor(c.conv_id, 1) AS conv_id, role, text FROM c JOIN last USING (conv_id, n)
), t AS (
  SELECT TRUE AS good, * FROM c
  UNION ALL SELECT FALSE, conv_id, c.n, c.role, c.text FROM c JOIN last USING (conv_id) JOIN answer USING (conv_id) WHERE c.n < last.n
  UNION ALL SELECT FALSE, conv_id, last.n, role, text FROM last JOIN answer USING (conv_id)
), m AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.n, b.n) AS n,
    a.n IS NOT NULL AND b.n IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM t WHERE good) a FULL JOIN (SELECT * FROM t WHERE NOT good) b ON a.conv_id = b.conv_id AND a.n = b.n
), k AS (
  SELECT conv_id, coalesce(min(n) FILTER (WHERE NOT same) - 1, max(n)) AS n_common FROM m GROUP BY conv_id
), x AS (
  SELECT t.*, n_common, '<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10) AS head, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM t JOIN k USING (conv_id)
), y AS (
  SELECT *, sum(CASE WHEN n > n_common THEN length(head || body) ELSE 0 END) OVER (PARTITION BY conv_id, good ORDER BY n) AS till FROM x
), z AS (
  SELECT *, CASE WHEN n > n_common AND role = 'assistant' THEN CAST(till - length(body) AS BIGINT) || '-' || CAST(till AS BIGINT) END AS span FROM y
)
SELECT conv_id, CAST(max(n_common) AS BIGINT) AS n_common,
  coalesce(string_agg(head || body, '' ORDER BY n) FILTER (WHERE good AND n <= n_common), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY n) FILTER (WHERE good AND n > n_common), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY n) FILTER (WHERE NOT good AND n > n_common), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY n) FILTER (WHERE good), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY n) FILTER (WHERE NOT good), '') AS rejected_mask,
  count(span) FILTER (WHERE good) > 0 AND count(span) FILTER (WHERE NOT good) > 0 AS usable
FROM z GROUP BY conv_id
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT item_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM b
), ba AS (
  SELECT *, string_agg(word, ' ') OVER f AS ahead, count(*) OVER f AS len
  FROM bw WINDOW f AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)
), win AS (
  SELECT DISTINCT item_id, word, ahead, len FROM ba WHERE len = 10 OR (n < 10 AND pos = 1)
), dw AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
), da AS (
  SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM dw
), found AS (
  SELECT da.doc_id, da.pos, win.len, win.item_id FROM da JOIN win ON da.ahead = win.ahead AND win.len = 10
  UNION ALL
  SELECT da.doc_id, da.pos, win.len, win.item_id FROM da JOIN win ON da.word = win.word AND win.len < 10 AND starts_with(da.ahead || ' ', win.ahead || ' ')
), far AS (
  SELECT doc_id, pos, max(pos + len) AS till FROM found GROUP BY doc_id, pos
), hit AS (
  SELECT doc_id, coalesce(max(till) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) > pos AS hit FROM dw LEFT JOIN far USING (doc_id, pos)
), h AS (
  SELECT doc_id, count(*) FILTER (WHERE hit) AS n_hit FROM hit GROUP BY doc_id
), i AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM found WHERE item_id IS NOT NULL GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

OP8_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
), g AS (
  SELECT *, CASE WHEN count(*) OVER f = 13 THEN string_agg(word, ' ') OVER f END AS ahead
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), source AS (
  SELECT ahead, min(doc_id) AS source FROM g WHERE ahead IS NOT NULL GROUP BY ahead
), m AS (
  SELECT g.doc_id, g.pos, g.word, coalesce(source.source < g.doc_id, FALSE) AS again FROM g LEFT JOIN source ON g.ahead = source.ahead
), k AS (
  SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m
), r AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""

_DIST = "CAST(list_inner_product(v.x, v.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(v.x, c.x) AS BIGINT)"


def _round(n: int) -> str:
    """Clusters of every vector around the centroids c<n>, and the centroids after it."""
    return f"""a{n} AS MATERIALIZED (
  SELECT row, CAST(arg_min(k, (d, k)) AS INTEGER) AS cluster, min(d) AS distance FROM (SELECT v.row, c.k, {_DIST} AS d FROM v CROSS JOIN c{n} c) GROUP BY row
), p{n} AS (
  SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS pos FROM v JOIN a{n} USING (row)) GROUP BY cluster, pos
), c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT cluster, list(CAST(floor(s / n) AS DOUBLE) ORDER BY pos) AS x FROM p{n} GROUP BY cluster) m ON m.cluster = c.k
)"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)
), {_round(0)}, {_round(1)}, {_round(2)}, {_round(3)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a3 JOIN v USING (row) JOIN c3 c ON c.k = a3.cluster
"""

ORACLES = {
    "op1_mix_sources": OP1_SQL, "op2_preference_format": OP2_SQL, "op7_suffix_automaton": OP7_SQL, "op8_cover_tree_topk": OP8_SQL,
    "op9_de_bruijn_spans": OP9_SQL, "op12_pca_centroids": OP12_SQL,
}
