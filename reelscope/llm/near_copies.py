"""Near copies by shingles: MinHash bands and op6's links of fingerprints bring texts together, their shingles decide."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm import simhash
from reelscope.llm.common import components, join_counted, texts_in, utf8
from reelscope.session import materialize

#: Words of a shingle. Texts are linked from a Jaccard similarity of 4 / 5 of their shingles on.
SHINGLE, SEED = 5, 42
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 7e-5, a closer one less often.
BANDS, ROWS = 24, 5
#: Of BANDS * ROWS sketch bytes, those that agree at least before shingles are compared: 5 deviations below 0.8.
AGREE = 74
_RNG = np.random.default_rng(SEED)
FACTORS, SHIFTS = (_RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(k) for k in (1, 0))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of the lower-cased words; a shorter text is one shingle, none without words."""
    words = text.lower().split() if text else []
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)] if k else [], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[i : i + 1024] * FACTORS + SHIFTS).min(1))
    return low


def marks_of(docs: DataFrame, id_: Column, text_col: str) -> DataFrame:
    """Per document: its id, node (equal for equal sets of shingles), band keys, sketch, the shingles as 32 bits each, and op6's fingerprint."""

    def mark(text):
        h = shingles(text)
        low = minima(h)
        bands = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))]
        return xxhash.xxh64_intdigest(h.tobytes(), SEED), bands, low.astype(np.uint8).tobytes(), h.astype(np.uint32).tobytes(), simhash.fingerprint(text)

    def run(batches):
        for b in batches:
            node, bands, sketch, sets, fps = list(zip(*map(mark, b.column(1).to_pylist()), strict=True)) or [()] * 5
            keys = np.array(bands, np.uint64).view(np.int64).ravel()
            at = pa.array(range(0, len(keys) + 1, BANDS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.ListArray.from_arrays(at, pa.array(keys)), pa.array(sketch, pa.binary()), pa.array(sets, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))],
                ["doc_id", "node", "bands", "sketch", "shingles", "fp"],
            )

    rows = texts_in(docs).select(id_.alias("doc_id"), utf8(text_col).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, node long, bands array<long>, sketch binary, shingles binary, fp long")


def alike(a: frozenset, b: frozenset) -> bool:
    """Jaccard similarity 0.8 or more, in whole numbers."""
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def bucket_links(rows: list[tuple[int, bytes, bytes]]) -> list[tuple[int, int]]:
    """(node, node) of a forest that connects what links of the bucket's (node, sketch, shingles) connect; every link is one."""
    sketch = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
    size = np.array([len(r[2]) // 4 for r in rows])
    sets: dict[int, frozenset] = {}
    label, found = np.arange(len(rows)), []

    def of(i):
        if i not in sets:
            sets[i] = frozenset(np.frombuffer(rows[i][2], np.uint32).tolist())
        return sets[i]

    for i in range(len(rows) - 1):
        near = (sketch[i + 1 :] == sketch[i]).sum(1) >= AGREE
        near &= 5 * np.minimum(size[i + 1 :], size[i]) >= 4 * np.maximum(size[i + 1 :], size[i])
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if label[i] != label[j] and alike(of(i), of(j)):
                label[label == label[j]] = label[i]
                found.append((rows[i][0], rows[j][0]))
    return found


def fingerprint_buckets(marks: DataFrame) -> DataFrame:
    """(node, key): nodes of one fingerprint share a key, and so do the nodes of the two ends of a link of op6."""
    fps = materialize(marks.select("node", "fp").distinct())
    links = simhash.hamming_links(fps.select("fp").distinct())
    ends = links.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp"))
    return materialize(fps.select("node", F.xxhash64("fp").alias("key")).union(ends.join(fps, "fp").select("node", "key")).distinct())


def links_of(marks: DataFrame) -> DataFrame:
    """(a, b): a forest of links between nodes that connects what all links connect.

    Of buckets with the same members one is compared, all its pairs; a bucket is one task's.
    """
    members = marks.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    members = members.union(fingerprint_buckets(marks))
    digest = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    heads = members.groupBy("key").agg(*digest).where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    wanted = materialize(members.join(heads.select("key"), "key", "left_semi"))
    sets = marks.select("node", "sketch", "shingles").dropDuplicates(["node"])  # tasks drop their own copies first

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, bucket in groupby(rows, lambda r: r[0]):
            if found := bucket_links([r[1:] for r in bucket]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    dealt = wanted.join(sets, "node").select("key", "node", "sketch", "shingles").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long")


def node_classes(marks: DataFrame) -> DataFrame:
    """(node, n, low, root): how many documents a node stands for, the smallest of them, and the node of its component."""
    nodes = marks.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    return nodes.join(components(links_of(marks)), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, component_id), one per document; component_id is the smallest doc_id of the component.

    Documents are linked when the sets of their shingles have a Jaccard similarity of 0.8 or more. Null and empty texts
    have no shingle and link with each other. Equal sets are joined as one. Frequent nodes and roots are not join keys.
    """
    marks = materialize(marks_of(docs, F.col(id_col).cast("long"), text_col))
    classes = materialize(node_classes(marks))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes"))
    named = join_counted(classes, lows, "root", "nodes").select("node", "n", "component_id")
    return join_counted(marks.select("doc_id", "node"), named, "node", "n").select("doc_id", "component_id")


def survivors(docs: DataFrame, order: Column, text_col: str = "text") -> DataFrame:
    """(doc_id) of one document of each component: the one that is first in ``order``, a struct of longs.

    A component's documents meet in two aggregates, of equal sets and of nodes, so none of any size is a join key.
    """
    marks = materialize(marks_of(docs, order, text_col))
    return node_classes(marks).groupBy("root").agg(F.min("low").alias("doc_id")).select("doc_id")
