"""Substring dedup on the De Bruijn graph of a corpus: runs of words that stand in an earlier document are removed.

An edge of the graph is a window of consecutive words. Shipping every edge would cost more than the texts, so the edges
travel through their anchors: the k-mer of a window with the smallest hash. Equal windows have equal anchors, hence a
window whose anchor no other document has is unique and stays home. Documents are dealt to chunks once; then

1. chunks send their distinct anchors to buckets by hash, and learn which ones repeat;
2. chunks send the distinct windows on repeated anchors, each with its first place, and learn the earlier places;
3. consecutive windows that follow one line of source coordinates (same document, next word) are one compact path, a
   repeated span; the span's words are removed.

Every exchange is a grouping by chunk or by bucket: a passage that a third of all documents share is one entry per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import plain_words, utf8

ANCHOR = 7
#: A chunk, the unit of a task, holds about so many documents or bytes of text, whichever makes more chunks.
DOCS_PER_CHUNK, BYTES_PER_CHUNK = 4096, 32 << 20
NO_ID = (1 << 63) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class RollingHash:
    """Hashes of byte spans from prefix sums: sum of table[byte] * base^position modulo 2^64, shifted back and mixed."""

    def __init__(self, base: int):
        self.table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base | 1) ** np.uint64(3))
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.backs = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            n = 2 * len(data) + 1
            self.powers, self.backs = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (self.base, self.inverse))
        return np.r_[np.uint64(0), np.cumsum(self.table[data] * self.powers[: len(data)], dtype=np.uint64)]

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((prefix[ends] - prefix[starts]) * self.backs[starts] + (ends - starts).astype(np.uint64))


FIRST, SECOND = RollingHash(0xD1342543DE82EF95), RollingHash(0xAF251AF3B0F025B5)


def laid_out(text: bytes | None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words, the bytes of the words joined by one space, and where each word starts and ends."""
    words = plain_words(text)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    return words, np.frombuffer(b" ".join(words), np.uint8), ends - n, ends


def windows(text: bytes | None, width: int, anchors: bool, hashes: bool) -> tuple[np.ndarray | None, ...]:
    """(anchor, first hash, second hash) of each window of the text, what is asked for."""
    words, data, starts, ends = laid_out(text)
    if len(words) < width:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    one, low, high, two = FIRST.prefix(data), None, None, None
    if anchors:
        k = min(ANCHOR, width)
        kmers, low = FIRST.spans(one, starts[: len(starts) - k + 1], ends[k - 1 :]), None
        n = len(words) - width + 1
        low = kmers[:n].copy()
        for i in range(1, width - k + 1):
            np.minimum(low, kmers[i : i + n], out=low)
    if hashes:
        a, b = starts[: len(starts) - width + 1], ends[width - 1 :]
        high, two = FIRST.spans(one, a, b), SECOND.spans(SECOND.prefix(data), a, b)
    return low, high, two


def dealt(buckets: int, chunk: int, key: np.ndarray, *arrays: np.ndarray) -> dict:
    """Rows (bucket, chunk, a blob for each array) by the upper bits of the first hash, given in its order."""
    which = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.searchsorted(which, np.arange(buckets + 1, dtype=np.uint64)).tolist()
    on = [(b, x, y) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
    return {"bucket": [b for b, _, _ in on], "chunk": [chunk] * len(on)} | {f"x{k}": [v[x:y].tobytes() for _, x, y in on] for k, v in enumerate(arrays)}


def table_of(rows: dict, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({n: pa.array(rows.get(n, []), kinds[k]) for n, k in (f.split() for f in schema.split(", "))})


def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def same_as_before(*keys: np.ndarray) -> np.ndarray:
    """For arrays in sorted order: whether each entry equals the one before it in all keys."""
    out = np.zeros(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return out


def chunk_rows(table: pa.Table) -> tuple[int, list[int], list[bytes | None]]:
    ids = [NO_ID if x is None else x for x in table.column("doc_id").to_pylist()]
    return (table.column("chunk")[0].as_py() if len(ids) else 0), ids, table.column("text").to_pylist()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text): every document without the words that stand in an earlier one.

    A word goes if it lies in a window of ``width`` words that also starts in a document with a smaller id; windows are
    judged on the input. ``spans``: (first word, end, source document, its first word) of each compact path, one blob of
    four longs each. ``kept_text``: the words left, joined by one space. Null and empty texts have no words; shorter
    texts lose nothing; rows of equal id, such as repeated rows, are no source for each other; a null id is after all
    others. Windows are told apart by two hashes, 128 bits.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    rows, size = source.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    chunks = max(48, -(-rows // DOCS_PER_CHUNK), -(-size // BYTES_PER_CHUNK))
    source = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long"))
    # one exchange of the texts; all three steps below read it
    source = source.repartition("chunk")

    def anchors(t: pa.Table) -> pa.Table:
        chunk, _, texts = chunk_rows(t)
        each = [np.unique(windows(x, width, True, False)[0]) for x in texts]
        found, n = np.unique(np.concatenate(each), return_counts=True) if each else (np.empty(0, np.uint64), np.empty(0))
        return table_of(dealt(chunks, chunk, found, found, (n > 1).astype(np.uint8)), ASK)

    def repeated(t: pa.Table) -> pa.Table:
        all_, twice = joined(t, "x0", "<u8"), joined(t, "x1", "u1") > 0
        order = np.argsort(all_, kind="stable")
        v = all_[order]
        again = same_as_before(v)
        known = np.unique(np.r_[v[again], all_[twice]])
        out = [(c, np.frombuffer(b, "<u8")) for c, b in zip(t.column("chunk").to_pylist(), t.column("x0").to_pylist(), strict=True)]
        out = [(c, x[np.isin(x, known, assume_unique=True)]) for c, x in out]
        return table_of({"chunk": [c for c, x in out if len(x)], "x0": [x.tobytes() for _, x in out if len(x)]}, KNOWN)

    def places(t: pa.Table, r: pa.Table) -> pa.Table:
        chunk, ids, texts = chunk_rows(t)
        known, parts = np.sort(joined(r, "x0", "<u8")), []
        for i, x in zip(ids, texts, strict=True) if len(known) else ():
            low, one, two = windows(x, width, True, True)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low)
            if len(at):
                parts.append((one[at], two[at], np.full(len(at), i, np.int64), at))
        if not parts:
            return table_of({}, PLACE)
        one, two, doc, at = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((at, doc, two, one))
        one, two, doc, at = one[order], two[order], doc[order], at[order]
        first = ~same_as_before(one, two)
        return table_of(dealt(chunks, chunk, one[first], one[first], two[first], doc[first], at[first].astype(np.int32)), PLACE)

    def earlier(t: pa.Table) -> pa.Table:
        one, two, doc, at = (joined(t, f"x{k}", kind) for k, kind in enumerate(("<u8", "<u8", "<i8", "<i4")))
        sizes = [len(b) // 8 for b in t.column("x0").to_pylist()]
        chunk = np.repeat(np.array(t.column("chunk").to_pylist(), np.int64), sizes)
        order = np.lexsort((at, doc, two, one))
        new = ~same_as_before(one[order], two[order])
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        src = order[head]
        tell = np.flatnonzero(doc[src] < doc[order])
        tell = tell[np.argsort(chunk[order[tell]], kind="stable")]
        to = chunk[order[tell]]
        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, int)
        out: dict[str, list] = {n: [] for n in ("chunk", "x0", "x1", "x2", "x3")}
        for x, y in zip(cut, cut[1:]):
            s = tell[x:y]
            for n, v in (("x0", one[order[s]]), ("x1", two[order[s]]), ("x2", doc[src[s]]), ("x3", at[src[s]])):
                out[n].append(v.tobytes())
            out["chunk"].append(int(to[x]))
        return table_of(out, EARLIER)

    def removed(t: pa.Table, r: pa.Table) -> pa.Table:
        _, ids, texts = chunk_rows(t)
        told = [joined(r, f"x{k}", kind) for k, kind in enumerate(("<u8", "<u8", "<i8", "<i4"))]
        marks = [windows(x, width, False, True)[1:] for x in texts]
        sizes = [len(m[0]) for m in marks]
        one, two = (np.concatenate([m[k] for m in marks]) if marks else np.empty(0, np.uint64) for k in (0, 1))
        row = np.repeat(np.arange(len(ids)), sizes)
        doc, at = np.array(ids, np.int64)[row], np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int64)
        # only windows that occur twice here, or that the buckets told of, can go
        order = np.argsort(one, kind="stable")
        dup = same_as_before(one[order])
        dup[:-1] |= dup[1:]
        maybe = np.zeros(len(one), bool)
        maybe[order[dup]] = True
        if len(told[0]):
            known = np.sort(told[0])
            maybe |= known[np.minimum(np.searchsorted(known, one), len(known) - 1)] == one
        pick = np.flatnonzero(maybe)
        one_, two_ = np.r_[told[0], one[pick]], np.r_[told[1], two[pick]]
        doc_, at_ = np.r_[told[2], doc[pick]], np.r_[told[3].astype(np.int64), at[pick]]
        order = np.lexsort((at_, doc_, two_, one_))
        head = np.maximum.accumulate(np.where(~same_as_before(one_[order], two_[order]), np.arange(len(order)), 0))
        src = np.empty(len(order), np.int64)
        src[order] = order[head]
        gone = np.flatnonzero(doc_[src[len(told[0]) :]] < doc[pick])
        where = pick[gone]
        from_doc, from_at = doc_[src[len(told[0]) :]][gone], at_[src[len(told[0]) :]][gone]
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_removed", "spans", "kept_text")}
        cut = np.searchsorted(row[where], np.arange(len(ids) + 1))
        for k, (i, text) in enumerate(zip(ids, texts, strict=True)):
            words, w = plain_words(text), slice(cut[k], cut[k + 1])
            spans, keep = paths(at[where[w]], from_doc[w], from_at[w], width), np.ones(len(words), bool)
            for a, b, _, _ in spans:
                keep[a:b] = False
            left = words if not spans else [words[j] for j in np.flatnonzero(keep)]
            for n, v in (("doc_id", None if i == NO_ID else i), ("n_words", len(words)), ("n_removed", len(words) - len(left))):
                out[n].append(v)
            out["spans"].append(np.array(spans, "<i8").tobytes())
            out["kept_text"].append(b" ".join(left).decode("utf-8", "replace"))
        return table_of(out, RESULT)

    known = source.groupBy("chunk").applyInArrow(anchors, ASK).groupBy("bucket").applyInArrow(repeated, KNOWN)
    found = source.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(places, PLACE).groupBy("bucket").applyInArrow(earlier, EARLIER)
    return source.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(removed, RESULT)


def paths(at: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """Windows in order of their word become spans: a path goes on while word and source coordinate move together."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[cut[1:], len(at)] - 1
    return [(int(at[a]), int(at[b]) + width, int(doc[a]), int(start[a])) for a, b in zip(cut, last, strict=True)]


ASK = "bucket long, chunk long, x0 binary, x1 binary"
KNOWN = "chunk long, x0 binary"
PLACE = "bucket long, chunk long, x0 binary, x1 binary, x2 binary, x3 binary"
EARLIER = "chunk long, x0 binary, x1 binary, x2 binary, x3 binary"
RESULT = "doc_id long, n_words long, n_removed long, spans binary, kept_text string"
