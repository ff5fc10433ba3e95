"""Benchmark decontamination: training tokens stream through a suffix automaton of the test items."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.llm.common import folded_words, texts_in, utf8

#: An automaton holds items up to so many bytes of text in all; more items make further automata, each a pass of its own.
AUTOMATON_BYTES = 8 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers: every run of words of any item is a path from state 0."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.of: list[set[int]] = [set()]  # items with an occurrence of the state's strings
        self.whole: list[set[int]] = [set()]  # short items that are the state's longest string
        self.names = [name for name, _ in items]
        tracks = []
        for _, words in items:
            last, track = 0, []
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                track.append(last)
            tracks.append(track)
        for k, (_, words) in enumerate(items):  # after all items are in: clones exist, paths are final
            state = 0
            for w in words:
                state = up = self.next[state][self.vocabulary[w]]
                while up > 0 and k not in self.of[up]:
                    self.of[up].add(k)
                    up = self.link[up]
            if 0 < len(words) < window:
                self.whole[state].add(k)
        self.shortest = min([min(len(w), window) for _, w in items if w], default=window)
        self._seen: dict[int, tuple[int, frozenset, tuple]] = {}

    def _new(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.of.append(set())
        self.whole.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for its strings of up to length[p] + 1; p and its suffixes now lead there."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _ends(self, state: int) -> tuple[int, frozenset, tuple]:
        """Of the suffixes that end in a state: the items of the full window, and (length, item) of whole short items."""
        if state not in self._seen:
            s, full, short = state, frozenset(), []
            while s > 0:
                if self.length[s] >= self.window > self.length[self.link[s]]:
                    full = frozenset(self.of[s])
                short += [(self.length[s], k) for k in self.whole[s]]
                s = self.link[s]
            self._seen[state] = (self.length[state], full, tuple(short))
        return self._seen[state]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans [start, end) of hit words, and the numbers of the items with an occurring window."""
        if len(words) < self.shortest or not self.vocabulary:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False].view(np.int8)))
        spans, items = [], set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = length = 0
            for at, c in enumerate(ids[a:b].tolist(), a + 1):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if c not in self.next[state]:
                    continue
                state, length = self.next[state][c], length + 1
                if length < self.shortest:
                    continue
                _, full, short = self._ends(state)
                longest = 0
                if length >= self.window:
                    longest = self.window
                    items |= full
                for n, k in short:
                    if n <= length:
                        items.add(k)
                        longest = max(longest, n)
                if longest:
                    spans.append((at - longest, at))
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [(m.start(), m.end()) for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def groups_of_items(benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> list[list[tuple[str, list[bytes]]]]:
    """The items in groups of at most about ``limit`` bytes, each small enough to be sent to every executor.

    The number of groups follows the size of the benchmark; a group is fetched by the hash of its items, id and text.
    """
    held = benchmark.select(F.col(item_id).cast("string").alias("i"), utf8(item_text).alias("t")).where("t is not null").distinct()
    total = held.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // limit))
    return [[(r.i, folded_words(bytes(r.t))) for r in held.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()] for k in range(n)]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, max_coverage: float = 0.5, clean: bool = True,
) -> DataFrame:
    """Add what of each document occurs in the test items, and the text without it.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a word of a document inside any
    occurrence of a window is hit. New columns: ``n_words``, ``n_hit``, ``hit_items`` (ids as strings), ``hit_spans``
    (word ranges), ``dropped`` (more than ``max_coverage`` of the words are hit), ``clean_text`` (the text without its hit
    spans; null for a null text). Null and empty texts have no words and no hits; items without words hit nothing, and
    items without an id hit but are not listed. With an empty benchmark nothing is hit. Columns of the documents with the
    names of the new ones are replaced. No shuffle: the items go to the documents, in groups of bounded size.
    """
    cols = [c for c in docs.columns if c.lower() not in NEW]
    kept = [docs.schema[c] for c in cols]
    ids, ranges = T.ArrayType(T.StringType()), T.ArrayType(T.ArrayType(T.LongType()))
    so_far = T.StructType([*kept, T.StructField("_items", ids), T.StructField("_spans", ranges)])
    done = T.StructType([
        *kept, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", ids), T.StructField("hit_spans", ranges),
        T.StructField("dropped", T.BooleanType()), T.StructField("clean_text", T.StringType()),
    ])
    groups = groups_of_items(benchmark, item_id, item_text, AUTOMATON_BYTES)
    out = texts_in(docs).select(*cols)
    for number, items in enumerate(groups):
        shared, last = docs.sparkSession.sparkContext.broadcast(items), number == len(groups) - 1

        def run(batches, shared=shared, first=number == 0, last=last):
            automaton = SuffixAutomaton(shared.value, window)
            for b in batches:
                texts, at = b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist(), len(cols)
                names, spans = ([[] for _ in texts] for _ in "ab") if first else (b.column(at).to_pylist(), b.column(at + 1).to_pylist())
                n_words = []
                for k, text in enumerate(texts):
                    words = folded_words(text)
                    n_words.append(len(words))
                    found, which = automaton.hits(words)
                    if found:
                        spans[k] = [list(x) for x in merged([*map(tuple, spans[k]), *found])]
                        names[k] = sorted({*names[k], *(automaton.names[i] for i in which if automaton.names[i] is not None)})
                made = [pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
                if last:
                    n_hit = [sum(y - x for x, y in s) for s in spans]
                    cut = [(without(t, s) if s else t) if clean else None for t, s in zip(texts, spans, strict=True)]
                    gone = pa.array([h > max_coverage * n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_())
                    made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), *made, gone, pa.array(cut, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], *made], names=(done if last else so_far).names)

        out = out.mapInArrow(run, done if last else so_far)
    return out


NEW = ("n_words", "n_hit", "hit_items", "hit_spans", "dropped", "clean_text", "_items", "_spans")
