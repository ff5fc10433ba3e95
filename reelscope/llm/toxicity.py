"""Toxicity from the nearest labelled texts: exact TF-IDF cosine over a block-max inverted index, votes by distance.

Texts are described by grams (4 to 6 bytes of a folded word with a space at either end) that tell the two labels apart in
a bounded sample of labelled rows; their document frequencies come from all documents. The examples' postings lie in
blocks, each with the highest weight of every gram in it: a block whose bound stays below the k-th best cosine is skipped.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.llm.common import folded_words, texts_in, utf8
from reelscope.session import materialize

GRAMS = (4, 5, 6)
#: Labelled rows of each label that teach, at most: those with the smallest hash of their id.
EXAMPLES = 2048
#: Grams that describe a text, at most, by chi-squared; and the least chi-squared of one (by chance: one gram in a million).
FEATURES, LEAST_CHI2 = 4096, 24.0
BLOCK, NEIGHBOURS = 32, 15
#: Blocks that are scored at a time, in falling order of their bounds.
TOGETHER = 8
#: Distance at which a vote counts half, and the pull of the base rate, in examples, on a step of the calibration.
HALF, PULL = 0.3, 2.0


@lru_cache(maxsize=200_000)
def grams(word: bytes) -> frozenset[bytes]:
    w = b" " + word + b" "
    return frozenset(w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))


class Features:
    """Numbers of the chosen grams; those of a word are looked up once."""

    def __init__(self, chosen: list[bytes]):
        self.number = {g: i for i, g in enumerate(chosen)}
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            w = b" " + word + b" "
            number = self.number
            found = tuple(number[g] for n in GRAMS for i in range(len(w) - n + 1) if (g := w[i : i + n]) in number)
            self.memo[word] = found
        return found

    def present(self, text: bytes | None) -> set[int]:
        """The chosen grams that stand in the text."""
        return set().union(*map(self.of_word, set(folded_words(text))))

    def counts(self, text: bytes | None) -> Counter:
        """How often each chosen gram stands in the text."""
        out: Counter = Counter()
        for w, n in Counter(folded_words(text)).items():
            for f in self.of_word(w):
                out[f] += n
        return out


def unit(counts: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams in ascending order and their TF-IDF weights, of length 1."""
    f = np.array(sorted(counts), np.int64)
    w = np.array([1 + math.log(counts[i]) for i in f.tolist()]) * idf[f]
    return f, w / math.sqrt(float(w @ w)) if len(f) else w


class BlockMaxIndex:
    """Postings of the examples, cut into blocks of examples; each (gram, block) knows its highest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_features: int, block: int = BLOCK):
        self.block = block
        self.n_blocks = -(-len(vectors) // block)
        f = np.concatenate([np.zeros(0, np.int64), *(v[0] for v in vectors)])
        w = np.concatenate([np.zeros(0), *(v[1] for v in vectors)])
        ex = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        order = np.lexsort((ex, f))
        f, self.example, self.weight = f[order], ex[order], w[order]
        run = f * max(self.n_blocks, 1) + self.example // block  # one run of postings for each (gram, block)
        new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
        self.start = np.r_[new, len(run)]
        self.of_block = self.example[new] // block
        self.highest = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.runs = np.searchsorted(f[new], np.arange(n_features + 1))

    def top(self, f: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k highest cosines above 0 with their examples, ties to the smaller number; example ``without`` takes no part."""
        first, many = self.runs[f], self.runs[f + 1] - self.runs[f]
        runs = spread(first, many)
        if not len(runs):
            return []
        q = np.repeat(w, many)
        blocks = self.of_block[runs]
        bound = np.bincount(blocks, q * self.highest[runs], self.n_blocks)
        by_block, size = blocks.argsort(kind="stable"), np.bincount(blocks, minlength=self.n_blocks)
        begin = size.cumsum() - size
        order = np.lexsort((np.arange(self.n_blocks), -bound))
        order = order[bound[order] > 0]
        found: list[tuple[float, int]] = []
        for i in range(0, len(order), TOGETHER):
            some = order[i : i + TOGETHER]
            if len(found) == k:
                some = some[bound[some] >= found[-1][0] - 1e-9]
                if not len(some):
                    break
            mine = by_block[spread(begin[some], size[some])]
            r = runs[mine]
            many = self.start[r + 1] - self.start[r]
            at = spread(self.start[r], many)
            scores = np.bincount(self.example[at], np.repeat(q[mine], many) * self.weight[at]).round(12)
            on = np.flatnonzero(scores > 0)
            on = on[on != without]
            s = scores[on]
            if len(on) > k:
                good = s >= np.partition(s, -k)[-k]
                on, s = on[good], s[good]
            found = sorted([*found, *zip(s.tolist(), on.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        return found


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for many[0] numbers, and so on."""
    return np.repeat(first - many.cumsum() + many, many) + np.arange(many.sum())


class ToxicityModel:
    """Index of the examples, the labels, and the steps that turn a vote into the share of label 1."""

    def __init__(self, features: list[bytes], idf: np.ndarray, examples: list[tuple[int, int, dict]], weight_of: dict[int, float]):
        self.features, self.idf = Features(features), idf
        vectors = [(i, y, *unit(c, idf)) for i, y, c in examples]
        # examples with the same strongest gram share blocks, so that bounds are tight
        vectors.sort(key=lambda v: (int(v[2][v[3].argmax()]) if len(v[2]) else -1, v[0]))
        self.ids = np.array([v[0] for v in vectors], np.int64)
        self.labels = np.array([v[1] for v in vectors], float)
        self.weights = np.array([weight_of[v[1]] for v in vectors], float)
        self.vectors = [(v[2], v[3]) for v in vectors]
        self.index = BlockMaxIndex(self.vectors, len(features))
        self.base = float(self.weights @ self.labels / self.weights.sum()) if len(vectors) else 0.0
        self.votes, self.shares = np.array([-1.0]), np.array([self.base])

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, nearer ones counting more; -1 without neighbours."""
        if not near:
            return -1.0
        w = np.array([HALF / (HALF + 1 - s) for s, _ in near])
        return round(float(w @ self.labels[[e for _, e in near]] / w.sum()), 9)

    def calibrate(self, votes: np.ndarray) -> None:
        """Rising steps (pooled violators) through the labels of the examples, each voted on without itself."""
        steps: list[list[float]] = []  # lowest vote, weight, weight of label 1
        for v in np.unique(votes):
            on = votes == v
            steps.append([float(v), float(self.weights[on].sum()), float(self.weights[on] @ self.labels[on])])
            while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
                _, w, y = steps.pop()
                steps[-1][1] += w
                steps[-1][2] += y
        if steps:
            pull = PULL * float(self.weights.min())
            self.votes = np.array([s[0] for s in steps])
            self.shares = np.array([(s[2] + pull * self.base) / (s[1] + pull) for s in steps])

    def score(self, text: bytes | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.top(*unit(self.features.counts(text), self.idf), NEIGHBOURS)
        at = max(int(self.votes.searchsorted(self.vote(near), "right")) - 1, 0)
        return float(min(max(self.shares[at], 0.0), 1.0)), near


def held_out(id_col: str = "doc_id") -> Column:
    """True for documents that never teach: crc32 of the id's text leaves remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[DataFrame, dict[int, float]]:
    """Sampled labelled texts (doc_id, label, t), and for each label how many labelled ids an example stands for.

    The sample takes ids below a cut-off of their hash, set so that ``most`` of a label are not exceeded; the ids go to the
    documents, whose texts are not shuffled for it. Labels of one id count as 1 if any is 1, texts of one id as the first by hash.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    marks = marks.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r.label: r.n for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    spans = {y: 1.0 if n <= most else (most - 4 * math.sqrt(most)) / n for y, n in sizes.items()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    wanted = F.lit(False)
    for y, span in sorted(spans.items()):
        wanted = wanted | ((F.col("label") == y) & (place < span))
    chosen = F.broadcast(marks.where(wanted))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")).join(chosen, "doc_id")
    texts = materialize(texts.groupBy("doc_id", "label").agg(F.min_by("t", F.xxhash64("t")).alias("t")))
    got = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return texts, {y: sizes[y] / n for y, n in got.items()}


def telling_grams(examples: DataFrame, weights: dict[int, float]) -> list[bytes]:
    """The grams of the examples with the highest chi-squared, in order."""

    def run(batches):
        both: dict[bytes, list[int]] = {}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for g in frozenset().union(*map(grams, set(folded_words(text)))):
                    both.setdefault(g, [0, 0])[label] += 1
        names = list(both)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([both[g][y] for g in names], pa.int64()) for y in (0, 1))], ["gram", "n0", "n1"])

    n = {r.label: r.n for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return []
    a, b, c, d = F.col("n1"), F.col("n0"), n[1] - F.col("n1"), n[0] - F.col("n0")
    chi2 = (sum(n.values()) * F.pow((a * d - b * c).cast("double"), F.lit(2)) / ((a + b) * (c + d)).cast("double") / float(n[0] * n[1])).alias("chi2")
    counted = examples.select("t", "label").mapInArrow(run, "gram binary, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = counted.where("n0 + n1 >= 3").where(c + d > 0).select("gram", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "gram").limit(FEATURES)
    return sorted(bytes(r.gram) for r in best.collect())


def document_frequencies(docs: DataFrame, text_col: str, chosen: list[bytes]) -> tuple[np.ndarray, int]:
    """How many of all documents hold each chosen gram; tasks count in arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        features, total = Features(shared.value), np.zeros(len(shared.value) + 1, np.int64)
        for b in batches:
            total[-1] += b.num_rows
            for text in b.column(0).to_pylist():
                total[list(features.present(text))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["f", "n"])

    rows = texts_in(docs).select(utf8(text_col).alias("t")).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(chosen) + 1, np.int64)
    out[rows.f.to_numpy(int)] = rows.n
    return out[:-1], int(out[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = EXAMPLES) -> ToxicityModel:
    """Model of the sampled labelled texts: at most ``most`` of each label, so its size is bounded."""
    texts, weights = examples_of(docs, labels, id_col, text_col, label_col, most)
    chosen = telling_grams(texts, weights)
    df, n = document_frequencies(docs, text_col, chosen)
    idf = np.log((n + 1) / (df + 1)) + 1

    def run(batches):
        features = Features(chosen)
        for b in batches:
            counts = [features.counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(c.items()) for c in counts], pa.map_(pa.int64(), pa.int64()))], ["doc_id", "label", "counts"])

    rows = texts_in(texts).select("doc_id", "label", "t").mapInArrow(run, "doc_id long, label int, counts map<long,long>").collect()
    model = ToxicityModel(chosen, idf, sorted((r.doc_id, r.label, r.counts) for r in rows), weights)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def votes(batches):
        for b in batches:
            m = shared.value
            out = [m.vote(m.index.top(*m.vectors[i], NEIGHBOURS, without=i)) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["id", "vote"])

    got = spark.range(len(model.ids)).mapInArrow(votes, "id long, vote double").toPandas().sort_values("id")
    model.calibrate(got.vote.to_numpy())
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """Add ``score`` (share of label 1 among texts with such neighbours, 0 to 1) and ``evidence`` (doc_id, cosine and label
    of the nearest examples, nearest first).

    Texts without any telling gram, null and empty ones among them, have no evidence and the score of such examples; a
    model without examples gives 0. Whole texts are read in one pass without a shuffle; equal texts score alike; columns
    with these names are replaced.
    """
    cols = [c for c in docs.columns if c.lower() not in ("score", "evidence")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        m = shared.value
        for b in batches:
            out = [m.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            near = [[{"doc_id": int(m.ids[e]), "cosine": s, "label": int(m.labels[e])} for s, e in o[1]] for o in out]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([o[0] for o in out], pa.float64()), pa.array(near, kind)], [*cols, "score", "evidence"])

    near = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    schema = T.StructType([*(docs.schema[c] for c in cols), T.StructField("score", T.DoubleType()), T.StructField("evidence", near)])
    return texts_in(docs).select(*cols, utf8(text_col).alias("_text")).mapInArrow(run, schema)
