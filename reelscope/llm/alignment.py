"""Cross-tokenizer alignment: every distinct text is tokenised twice and aligned once; measures go back to its documents.

Tokens of both tokenizers are byte ranges of one space and the text. Offsets at which tokens of both end cut them into
groups; every token of one side is linked to every token of the other side in its group.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import texts_in
from reelscope.session import materialize

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how the byte-level vocabulary cuts a text before its merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: So many of the commonest pairs at most, 16 bytes each, are sent to every task; all others are joined by key.
COMMON = 1 << 17
#: A text held by more than one in so many documents is joined by broadcast; there are fewer of them than that.
HOT = 1000
NONE = (0, 0, 0, 0, "", (), ())


class ByteTokens:
    """Byte-level vocabulary whose ids are in the order of its merges."""

    def __init__(self, file: bytes):
        import tiktoken

        # printable stand-ins of the 256 bytes: the printable ones are themselves, the rest follow from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        spec = json.loads(file)
        special = {t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        self._encoding = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks={t: i for i, t in self.bytes.items()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(" " + text)


class PieceTokens:
    """Pieces with byte fallback; the tokenizer itself puts a space before the text."""

    def __init__(self, file: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=file)
        ids = range(self._model.get_piece_size())
        piece = self._model.id_to_piece
        self.bytes = {i: bytes([int(piece(i)[3:5], 16)]) if self._model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in ids}

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text)


class Side:
    """A tokenizer with the length and the written form of every id."""

    def __init__(self, tokens):
        self.tokens, size = tokens, max(tokens.bytes) + 1
        self.length = np.zeros(size, np.int64)
        self.inner, self.last = np.empty(size, object), np.empty(size, object)
        for i, b in tokens.bytes.items():
            self.length[i] = len(b)

    def written(self, end: str) -> Side:
        for i in range(len(self.length)):
            self.inner[i], self.last[i] = f"{i},", f"{i}{end}"
        return self

    def cut(self, text: str, whole: bytes) -> np.ndarray | None:
        ids = self.tokens.encode(text)
        of = self.tokens.bytes
        return np.array(ids, np.int64) if b"".join([of[i] for i in ids]) == whole else None


class Aligner:
    def __init__(self, byte_file: bytes, piece_file: bytes):
        self.a, self.b = Side(ByteTokens(byte_file)).written("|"), Side(PieceTokens(piece_file)).written(";")

    def measures(self, text: str | None) -> tuple:
        """(n_a, n_b, n_groups, n_links, digest of the groups, linked id pairs, occurrences of each) of a text."""
        if not text:
            return NONE
        whole = b" " + text.encode("utf-8", "replace")
        a, b = self.a.cut(text, whole), self.b.cut(text, whole)
        if a is None or b is None:
            return NONE
        ends_a, ends_b = self.a.length[a].cumsum(), self.b.length[b].cumsum()
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ga, gb = common.searchsorted(ends_a), common.searchsorted(ends_b)
        na, nb = np.bincount(ga), np.bincount(gb)
        # groups in order, in each the ids of A, then those of B
        words = np.concatenate([np.where(np.r_[ga[1:] != ga[:-1], True], self.a.last[a], self.a.inner[a]), np.where(np.r_[gb[1:] != gb[:-1], True], self.b.last[b], self.b.inner[b])])
        order = np.concatenate([2 * ga, 2 * gb + 1]).argsort(kind="stable")
        digest = hashlib.sha256("".join(words[order].tolist())[:-1].encode()).hexdigest()
        pairs, times = linked_pairs(a, ga, b, gb)
        return len(a), len(b), len(common), int((na * nb).sum()), digest, pairs, times


def tallied(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in order, and how often each occurs."""
    key, n = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


def linked_pairs(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs ``a << 32 | b`` that share a group, and the number of linked occurrences of each.

    Ids are tallied within a group first, so a group without a common cut costs its distinct ids, not its tokens.
    """
    group, ids_a, times_a = tallied(ga, a)
    group_b, ids_b, times_b = tallied(gb, b)
    first = group_b.searchsorted(np.arange(len(group_b) and group_b[-1] + 2))
    many = (first[group + 1] - first[group]) if len(group) else group
    left = np.repeat(np.arange(len(group)), many)
    right = np.arange(len(left)) - np.repeat(many.cumsum() - many, many) + np.repeat(first[group], many)
    pairs, at = np.unique(ids_a[left] << 32 | ids_b[right], return_inverse=True)
    return pairs, np.bincount(at, times_a[left] * times_b[right], len(pairs)).astype(np.int64)


@lru_cache(maxsize=1)
def aligner(byte_file: bytes, piece_file: bytes) -> Aligner:
    return Aligner(byte_file, piece_file)


def lists(rows: list, kind: pa.DataType) -> pa.ListArray:
    at = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), kind))


def text_id(text: Column) -> Column:
    """SHA-256 of the text; null stands beside every text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def aligned_texts(docs: DataFrame, text_col: str, byte_file: bytes, piece_file: bytes) -> DataFrame:
    """A row for every distinct text: its id, how many documents hold it, its measures, its id pairs and their occurrences.

    Texts meet by their full bytes; tasks count their own copies before the shuffle, so a text of many copies is no hot key.
    """
    files = docs.sparkSession.sparkContext.broadcast((byte_file, piece_file))

    def run(batches):
        tool = aligner(*files.value)
        for b in batches:
            for part in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                out = list(zip(*(tool.measures(t.decode("utf-8", "replace")) for t in part.column(1).to_pylist()), strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()), lists(out[5], pa.int64()), lists(out[6], pa.int64())],
                    ["text_id", "holders", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    texts = docs.select(F.col(text_col).cast("string").alias("t")).where("t <> ''").groupBy("t").agg(F.count("*").alias("holders"))
    texts = texts.select(text_id(F.col("t")).alias("text_id"), F.col("t").cast("binary").alias("t"), "holders")
    out = "text_id binary, holders long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return texts_in(texts).mapInArrow(run, out)


def common_pairs(counts: DataFrame) -> tuple[dict, int]:
    """The commonest pairs, ``COMMON`` at most, and the count from which a pair is one of them.

    Pairs are counted by the binary logarithm of their count, so the cut comes from a table of at most 64 rows.
    """
    sizes = {r.level: r.n for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()}
    level, total = max(sizes, default=-1) + 1, 0
    while level > 0 and total + sizes.get(level - 1, 0) <= COMMON:
        level -= 1
        total += sizes.get(level, 0)
    got = counts.where(F.floor(F.log2("n")) >= level).orderBy("pair").toPandas() if total else None
    return ({"pair": got.pair.to_numpy(np.int64), "n": got.n.to_numpy(np.int64)} if total else {"pair": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}), level


def scored_texts(texts: DataFrame) -> DataFrame:
    """Measures of every distinct text with ``n_best`` and ``count_sum``.

    Counts of the commonest pairs and the highest count of each id of A (as many as its vocabulary has ids) go to the
    tasks; the rest of the pairs is joined by key, and each of them is held by few documents.
    """
    spark = texts.sparkSession
    counts = materialize(texts.select(F.explode("pairs").alias("pair"), "holders").groupBy("pair").agg(F.sum("holders").alias("n")))
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).toPandas()
    best = np.zeros(int(top.a.max()) + 1 if len(top) else 1, np.int64)
    best[top.a.to_numpy(int)] = top.n
    common, level = common_pairs(counts)
    shared = spark.sparkContext.broadcast((common["pair"], common["n"], best))

    def run(batches):
        known, n_of, best = shared.value
        for b in batches:
            ids, pairs, times = b.column(0), b.column(1), b.column(2)
            flat, occ = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = known.searchsorted(flat)
            at[at == len(known)] = 0
            found = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            n = np.where(found, n_of[at], 0) if len(known) else np.zeros(len(flat), np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(pairs.offsets.to_numpy()))
            is_best = found & (n == best[flat >> 32]) if len(flat) else found
            total = lambda w: np.diff(np.r_[0, w.cumsum()][np.r_[0, np.bincount(row, minlength=b.num_rows).cumsum()]])
            rest = ~found
            at = pa.array(np.r_[0, np.bincount(row[rest], minlength=b.num_rows).cumsum()].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(total(occ * is_best)), pa.array(total(occ * n)), pa.ListArray.from_arrays(at, pa.array(flat[rest])), pa.ListArray.from_arrays(at, pa.array(occ[rest]))],
                ["text_id", "n_best", "count_sum", "pairs", "times"],
            )

    part = materialize(texts.select("text_id", "pairs", "times").mapInArrow(run, "text_id binary, n_best long, count_sum long, pairs array<long>, times array<long>"))
    rest = part.select("text_id", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("text_id", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    # "n" of the pairs that the tasks did not know, with the highest count of their id of A
    rare = counts.where(F.floor(F.log2("n")) < level)
    of_a = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(best.tolist()) if n], "a long, most long"))
    joined = rest.join(rare, "pair").withColumn("a", F.shiftright("pair", 32)).join(of_a, "a")
    added = joined.groupBy("text_id").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = texts.drop("pairs", "times").join(part.select("text_id", "n_best", "count_sum"), "text_id").join(added, "text_id", "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE) -> DataFrame:
    """Row for row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The count of an id pair is the number of documents, copies included, that hold it linked; ``n_best`` counts links
    whose count is the highest of their id of A, ``count_sum`` adds the counts of all links. A text that is null or empty,
    or that a tokenizer does not give back byte for byte, has no tokens: zeros and an empty digest, and no part in counts.
    Whole texts are read; a very long one costs a few dozen bytes of a task for each of its bytes. Repeated rows and rows
    that share an id are documents of their own with equal results; other columns are left out, whatever their names; an
    empty table gives no rows. The files of the tokenizers are read on the driver (2 MB) and sent along.
    """
    texts = materialize(aligned_texts(docs, text_col, Path(byte_path).read_bytes(), Path(piece_path).read_bytes()))
    measured = materialize(scored_texts(texts))
    keys = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_id(F.nullif(F.col(text_col).cast("string"), F.lit(""))).alias("text_id")))
    total = keys.count()
    hot = measured.where(F.col("holders") * HOT > total)
    rare = measured.where(F.col("holders") * HOT <= total)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    # texts of many copies and documents without a text never meet in a shuffle
    first = keys.join(F.broadcast(hot), "text_id", "left")
    done = first.where("holders is not null or text_id is null").select("doc_id", *names)
    others = first.where("holders is null and text_id is not null").select("doc_id", "text_id").join(rare, "text_id", "left").select("doc_id", *names)
    out = done.unionByName(others)
    return out.select("doc_id", *(F.coalesce(n, F.lit("" if n == "groups_sha256" else 0)).alias(n) for n in names))
