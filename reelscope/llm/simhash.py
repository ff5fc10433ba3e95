"""Near-duplicates by SimHash: fingerprints, then a binary trie joined with itself."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import components, if_small, texts_in, utf8
from reelscope.session import materialize

SEED = 42
PAIRS_AT_ONCE = 1 << 17


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64 bits, each set if set in over half of the shingles' XXH64; 0 for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, at, ends, starts = b" ".join(words), 0, [], []
    for n in map(len, words):
        starts.append(at)
        at += n + 1
        ends.append(at - 1)
    digest, k = xxhash.xxh64_intdigest, min(shingle, len(words))
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts_in(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


class Trie:
    """Binary trie over sorted, distinct fingerprints below a common prefix: a node is a range of them at a depth."""

    def __init__(self, fps: np.ndarray, depth: int):
        self.fps, self.first, self.kids = fps, depth, {}
        self.starts = {depth: np.flatnonzero(np.r_[True, self.bits(depth)[1:] != self.bits(depth)[:-1]])}

    def bits(self, depth: int) -> np.ndarray:
        return self.fps >> np.uint64(64 - depth) if depth else np.zeros(len(self.fps), np.uint64)

    def ends(self, depth: int) -> np.ndarray:
        return np.r_[self.starts[depth][1:], len(self.fps)]

    def children(self, depth: int) -> np.ndarray:
        """Two columns: the node's child for bit 0 and bit 1 at the next depth, -1 if there is none."""
        if depth not in self.kids:
            b = self.bits(depth + 1)
            below = self.starts[depth + 1] = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            at = np.searchsorted(below, self.starts[depth])
            n = np.diff(np.r_[at, len(below)])
            bit = (b[below[at]] & np.uint64(1)).astype(np.int64)
            out = np.full((len(at), 2), -1, np.int64)
            out[np.arange(len(at)), bit] = at
            out[n == 2, 1] = at[n == 2] + 1
            self.kids[depth] = out
        return self.kids[depth]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest position of a component) after linking positions a and b."""
    while True:
        low = np.minimum(labels[a], labels[b])
        odd = labels[a] != labels[b]
        if not odd.any():
            return labels
        a, b, low = a[odd], b[odd], low[odd]
        top = np.maximum(labels[a], labels[b])
        np.minimum.at(labels, top, low)
        while (labels != labels[labels]).any():
            labels = labels[labels]


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int, exact: int = 0) -> np.ndarray:
    """Links among sorted distinct fingerprints within ``budget`` bits: each row (fingerprint, one of its component).

    Node pairs are traversed together from ``depth`` on; a pair's differing bits add up on the way down, and it is
    dropped beyond the budget, on a difference in the first ``exact`` bits, or when everything below it is one component
    already. ``right`` None joins left with itself. What is returned is a forest, so a dense group yields as many rows as it has members, not all its pairs.
    """
    own = right is None
    a, b = Trie(left, depth), Trie(left if own else right, depth)
    if own:
        b = a
    shift = 0 if own else len(left)
    labels = np.arange(len(left) + (0 if own else len(right)))
    fps = left if own else np.r_[left, right]
    zero = np.zeros(len(a.starts[depth]) * len(b.starts[depth]), np.int64)
    i, j = np.repeat(np.arange(len(a.starts[depth])), len(b.starts[depth])), np.tile(np.arange(len(b.starts[depth])), len(a.starts[depth]))
    gap = zero + np.bitwise_count(left[a.starts[depth]][i] >> np.uint64(64 - depth) ^ b.fps[b.starts[depth]][j] >> np.uint64(64 - depth)) if depth else zero
    keep = (gap <= budget) & ((i <= j) if own else True)
    stack, stop = [(depth, i[keep], j[keep], gap[keep].astype(np.int8))], None
    while stack:
        d, i, j, gap = stack.pop()
        if len(i) > PAIRS_AT_ONCE:
            half = len(i) // 2
            stack += [(d, i[:half], j[:half], gap[:half]), (d, i[half:], j[half:], gap[half:])]
            continue
        if stop is None:  # the end of the run of equal labels from each position on
            cut = np.flatnonzero(np.r_[labels[1:] != labels[:-1], True])
            stop = cut[np.searchsorted(cut, np.arange(len(labels)))] + 1
        sa, ea, sb, eb = a.starts[d][i], a.ends(d)[i], b.starts[d][j], b.ends(d)[j]
        one = (stop[sa] >= ea) & (stop[sb + shift] >= eb + shift) & (labels[sa] == labels[sb + shift])
        leaf = (ea - sa == 1) & (eb - sb == 1) & ~one
        if leaf.any():
            x, y = sa[leaf], sb[leaf]
            near = np.bitwise_count(a.fps[x] ^ b.fps[y]) <= budget
            if near.any():
                labels, stop = merge(labels, x[near], y[near] + shift), None
        go = ~one & ~leaf
        i, j, gap = i[go], j[go], gap[go]
        if not len(i) or d == 64:
            continue
        ka, kb, parts = a.children(d)[i], b.children(d)[j], []
        same = (i == j) if own else np.zeros(len(i), bool)
        for p, q in ((0, 0), (1, 1), (0, 1), (1, 0)):
            ok = (ka[:, p] >= 0) & (kb[:, q] >= 0)
            if p != q:
                ok &= (gap < budget) & (d >= exact)
                if p == 1:
                    ok &= ~same
            parts.append((ka[ok, p], kb[ok, q], gap[ok] + np.int8(p != q)))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    on = np.flatnonzero(labels != np.arange(len(labels)))
    return np.stack([fps[on], fps[labels[on]]], 1) if len(on) else np.empty((0, 2), np.uint64)


def orders(budget: int, equal: int) -> tuple[list[list[tuple[int, int, int]]], int]:
    """Bit orders, as moves (low bit, width, new low bit), and the number of leading bits in which a pair must agree.

    64 bits are cut into budget + equal blocks, so two values within the budget agree in ``equal`` blocks at least: each
    order brings one choice of these to the front.
    """
    n = budget + equal
    edges = [64 * k // n for k in range(n + 1)]
    plans = []
    for front in combinations(range(n), equal):
        at, plan = 64, []
        for k in [*front, *(k for k in range(n) if k not in front)]:
            width = edges[k + 1] - edges[k]
            at -= width
            plan.append((64 - edges[k + 1], width, at))
        plans.append(plan)
    return plans, 64 // n * equal


def moved(x: np.ndarray, plan: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros_like(x)
    for low, width, to in plan:
        out |= (x >> np.uint64(low) & np.uint64((1 << width) - 1)) << np.uint64(to)
    return out


def moved_column(c: str, plan: list[tuple[int, int, int]]) -> Column:
    mask = lambda width: F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    return reduce(Column.bitwiseOR, (F.shiftleft(F.shiftrightunsigned(c, low).bitwiseAND(mask(width)), to) for low, width, to in plan))


def prefix(c: str, depth: int) -> Column:
    """The node at a depth above the value."""
    return F.shiftrightunsigned(c, 64 - depth) if depth else F.lit(0).cast("long")


def node_pairs(spread: DataFrame, depth: int, exact: int, budget: int, limit: int) -> DataFrame:
    """(t, depth, one, two, fp): the fingerprints of each pair of trie nodes that a task walks.

    ``spread``: t (the bit order), fp, w (fp in that order). A node starts paired with itself. A pair that holds over
    ``limit`` fingerprints gives way to the pairs of its descendants four levels down, as often as it takes: these are
    distinct values, so any hot prefix falls apart in the end.
    """
    names = ["t", "depth", "one", "two", "fp"]
    start = spread.withColumns({"depth": F.lit(depth), "one": prefix("w", depth)}).withColumn("two", F.col("one"))
    heavy = materialize(start.groupBy("t", "one").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("t", "one"))
    if heavy.isEmpty():
        return start.select(names)
    out = start.join(if_small(heavy), ["t", "one"], "left_anti").select(names)
    rest = materialize(start.join(if_small(heavy), ["t", "one"], "left_semi").select("t", "fp", "w"))
    pairs = heavy.select("t", "one", F.col("one").alias("two"))
    while depth < 64 and not pairs.isEmpty():
        above, depth = depth, min(64, depth + 4)
        nodes = rest.groupBy("t", prefix("w", depth).alias("node")).agg(F.count("*").alias("n"))
        up = F.shiftrightunsigned("node", depth - above) if above else F.lit(0).cast("long")
        x = nodes.select("t", up.alias("one"), F.col("node").alias("x"), F.col("n").alias("nx"))
        y = nodes.select("t", up.alias("two"), F.col("node").alias("y"), F.col("n").alias("ny"))
        apart = F.col("x").bitwiseXOR(F.col("y"))
        kids = pairs.join(x, ["t", "one"]).join(y, ["t", "two"]).where("one <> two or x <= y").where(F.bit_count(apart) <= budget)
        kids = kids.where((F.shiftrightunsigned(apart, depth - exact) if depth > exact else apart) == 0)
        held = F.col("nx") + F.when(F.col("x") == F.col("y"), 0).otherwise(F.col("ny"))
        kids = materialize(kids.select("t", F.col("x").alias("one"), F.col("y").alias("two"), ((held > limit) & F.lit(depth < 64)).alias("more")))
        sides = kids.where("not more").withColumn("node", F.explode(F.array_distinct(F.array("one", "two"))))
        out = out.union(rest.withColumns({"node": prefix("w", depth), "depth": F.lit(depth)}).join(sides, ["t", "node"]).select(names))
        pairs = kids.where("more").select("t", "one", "two")
    return out


def hamming_links(distinct: DataFrame, budget: int = 4, per_subtree: int = 16384) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within ``budget`` bits of each other, given distinct ``fp``.

    The trie stands in a few bit orders. In each, pairs must agree in the leading bits, and two values within the budget
    do so in one order at least; so the top levels deal the fingerprints to tasks, a few copies of each. The prefix grows
    with the number of fingerprints (with more blocks, hence more orders, where one block is too short), so a subtree stays
    near ``per_subtree``; one over four times that is split. Fingerprints are distinct, hence copies add nothing here.
    """
    n, equal = distinct.count(), 1
    while equal < 64 - budget and per_subtree << 64 // (budget + equal) * equal < n:
        equal += 1
    plans, exact = orders(budget, equal)
    p = min(exact, max(0, math.ceil(math.log2(max(n, 1) / per_subtree))))
    spread = distinct.select("fp", F.posexplode(F.array(*(moved_column("fp", plan) for plan in plans))).alias("t", "w"))
    units = node_pairs(spread, p, exact, budget, 4 * per_subtree)

    def run(key, pdf):
        t, depth, one, two = map(int, key)
        w = np.sort(moved(np.ascontiguousarray(pdf.fp.to_numpy()).view(np.uint64), plans[t]))
        own = (w >> np.uint64(64 - depth) if depth else np.zeros_like(w)).view(np.int64)
        left, right = w[own == one], None if one == two else w[own == two]
        back = [(to, width, low) for low, width, to in plans[t]]
        found = moved(trie_links(left, right, depth, budget, exact), back).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    # the work of a group is much larger than its rows: as many tasks as there are groups, up to a limit
    units = units.repartition(min(1 << 14, len(plans) << p), "t", "depth", "one", "two")
    return units.groupBy("t", "depth", "one", "two").applyInPandas(run, "a long, b long")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per document.

    Fingerprints differing in at most ``budget`` bits are linked; component_id is the smallest doc_id of the component
    (null if it has none). Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints are
    joined as one, so groups of copies cost nothing more. Repeated rows each get a row; an empty table gives none.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, shingle))
    heads = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(hamming_links(heads.select("fp"), budget)).withColumnsRenamed({"node": "fp"})
    whole = heads.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    names = whole.join(lows, "root").select("fp", "component_id")
    return marks.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
