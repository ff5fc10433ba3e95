"""Masked pseudo-likelihood: a window network predicts each token from both its neighbours and scores documents.

Tokens are the most frequent words of the corpus; other words share hashed ids. A window has finitely many contexts, so all
windows of the corpus are counted in Spark, the network is fitted in numpy on the counts of every context (the exact
gradient over the whole corpus, whatever its size), and its log-probabilities are laid out once for all contexts.

A word among those that share an id has, given the id, its share of the id's tokens. These shares come from a Spark table of
all different words of the corpus with their counts, which grows with it: P(word | neighbours) = P(id | neighbours) *
P(word | id), a distribution over all words. The commonest words are sent along with the tasks, all others joined by word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import folded_words, texts_in, utf8
from reelscope.session import materialize

#: Token ids: 0 stands before and after a text, 1 to RARE for all other words by hash, then the vocabulary.
TOKENS, RARE, HIDDEN, STEPS, RATE = 96, 15, 32, 150, 0.05
#: Distinct words that a task holds before it hands on its counts.
HELD = 500_000
#: So many of the commonest words, of SENT_BYTES bytes each at most, go to every task; the others are joined.
SENT, SENT_BYTES = 50_000, 64


class Tokens(dict):
    """Word to id; a word outside the vocabulary is hashed once."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__({w: RARE + 1 + k for k, w in enumerate(vocabulary)})
        self.fixed = len(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.fixed + HELD:
            for w in [w for w, v in self.items() if v <= RARE]:
                del self[w]
        self[word] = v = 1 + zlib.crc32(word) % RARE
        return v

    def cells(self, text: bytes | None) -> np.ndarray:
        """Cell (left, right, token) of every token of the text."""
        words = folded_words(text)
        x = np.zeros(len(words) + 2, np.int64)
        x[1:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return (x[:-2] * TOKENS + x[2:]) * TOKENS + x[1:-1]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of every different word of all texts. Tasks count first; only their counts are shuffled."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(folded_words(t))
                if len(counts) > HELD:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return texts_in(docs).select(utf8(text_col)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, words: int = TOKENS - RARE - 1) -> list[bytes]:
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]


def vocabulary(docs: DataFrame, text_col: str = "text", words: int = TOKENS - RARE - 1) -> list[bytes]:
    """The most frequent words of all texts, ties to the smaller word."""
    return most_frequent(word_counts(docs, text_col), words)


def word_shares(counts: DataFrame, words: list[bytes]) -> DataFrame:
    """(word, n, share): log of a word's share of the tokens of its id, for every word outside the vocabulary."""
    rare = counts.where(~F.col("word").isin(words)) if words else counts
    rare = rare.withColumn("id", 1 + F.crc32("word") % RARE)
    total = F.broadcast(rare.groupBy("id").agg(F.sum("n").alias("total")))  # RARE rows at most
    return rare.join(total, "id").select("word", "n", (F.log("n") - F.log("total")).alias("share"))


def window_counts(docs: DataFrame, words: list[bytes], text_col: str = "text") -> np.ndarray:
    """How often each (left, right, token) occurs in all texts: TOKENS cubed at most, whatever the corpus."""

    def run(batches):
        tokens, counts = Tokens(words), np.zeros(TOKENS**3, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                cells = tokens.cells(t)
                if len(cells) < 20_000:
                    np.add.at(counts, cells, 1)
                else:
                    counts += np.bincount(cells, minlength=len(counts))
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(counts[on])], ["cell", "n"])

    got = texts_in(docs).select(utf8(text_col)).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TOKENS**3)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(TOKENS * TOKENS, TOKENS)


class WindowNetwork:
    """Embeddings of the left and the right neighbour add up, pass tanh, and give a softmax over tokens."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.left, self.right = rng.normal(0, 0.3, (2, TOKENS, HIDDEN))
        self.bias, self.out, self.base = np.zeros(HIDDEN), rng.normal(0, 0.3, (HIDDEN, TOKENS)), np.zeros(TOKENS)

    def parts(self) -> list[np.ndarray]:
        return [self.left, self.right, self.bias, self.out, self.base]

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log-probabilities of every context (left, right)."""
        h = np.tanh(self.left[:, None] + self.right[None] + self.bias).reshape(-1, HIDDEN)
        z = h @ self.out + self.base
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, counts: np.ndarray, steps: int = STEPS) -> list[float]:
        """Adam on the mean negative log-probability of all counted tokens; the loss of every step."""
        total, losses = counts.sum(), []
        if not total:
            return losses
        self.base = np.log((counts.sum(0) + 1) / (total + TOKENS))
        share, weight = counts / total, counts.sum(1, keepdims=True) / total
        first = [np.zeros_like(p) for p in self.parts()]
        second = [np.zeros_like(p) for p in self.parts()]
        for step in range(1, steps + 1):
            h, logp = self.forward()
            losses.append(float(-(share * logp).sum()))
            dz = np.exp(logp) * weight - share
            dh = (dz @ self.out.T) * (1 - h * h)
            square = dh.reshape(TOKENS, TOKENS, HIDDEN)
            grads = [square.sum(1), square.sum(0), dh.sum(0), h.T @ dz, dz.sum(0)]
            for p, g, m, v in zip(self.parts(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return losses


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, word_log_likelihood, per_token): log-probabilities given both neighbours.

    log_likelihood sums those of the tokens' ids, word_log_likelihood those of the words themselves, and per_token is the
    latter over n_tokens. The network is trained on all documents of the table. Null and empty texts have no tokens, sums 0
    and a null per_token; repeated rows score alike; an empty table gives no rows. Whole texts are read, three times. Words
    that were not sent along meet their shares by word, once for each document that holds them.
    """
    counts = materialize(word_counts(docs, text_col))
    words = most_frequent(counts)
    network = WindowNetwork()
    network.fit(window_counts(docs, words, text_col))
    table = network.forward()[1].astype(np.float32).ravel()
    shares = word_shares(counts, words)
    sent = shares.where(F.length("word") <= SENT_BYTES).orderBy(F.desc("n"), "word").limit(SENT).toArrow()
    known = dict(zip(sent.column("word").to_pylist(), sent.column("share").to_pylist(), strict=True))
    known.update((w, 0.0) for w in words)
    shared = docs.sparkSession.sparkContext.broadcast((words, table, known))  # TOKENS cubed floats, SENT words at most

    def run(batches):
        words, logp, known = shared.value
        tokens = Tokens(words)
        for b in batches:
            texts = b.column(2).to_pylist()
            cells = [tokens.cells(t) for t in texts]
            n, s = [len(c) for c in cells], [float(logp[c].sum(dtype=np.float64)) for c in cells]
            own, rest = [], []
            for t in texts:
                found = list(map(known.get, w := folded_words(t)))
                own.append(math.fsum(x for x in found if x is not None))
                rest.append(list(Counter(x for x, y in zip(w, found, strict=True) if y is None).items()))
            lists = pa.array(rest, pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))
            sums = [pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(own, pa.float64()), lists]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *sums], ["row", "doc_id", "n_tokens", "log_likelihood", "own", "rest"])

    read = texts_in(docs).select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), utf8(text_col))
    kinds = "row long, doc_id long, n_tokens long, log_likelihood double, own double, rest array<struct<word: binary, times: long>>"
    rows = materialize(read.mapInArrow(run, kinds))
    met = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    joined = met.join(shares.select("word", "share"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("share")).alias("joined"))
    total = F.col("log_likelihood") + F.col("own") + F.coalesce("joined", F.lit(0.0))
    out = rows.drop("rest").join(joined, "row", "left").withColumn("word_log_likelihood", total)
    mean = F.when(F.col("n_tokens") > 0, F.col("word_log_likelihood") / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", "log_likelihood", "word_log_likelihood", mean.alias("per_token"))
