"""Exact top-k by inner product: a cover tree over queries against a cover tree over data, both walked together.

Vectors are dealt to groups by their nearest pivot, so that a group is a ball; a large group is several blocks. A tree is
built for every block inside a task. A pair of nodes is dropped when no product between their balls can reach the worst
k-th score of the node's queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.session import materialize

LEAF = 64
#: One pivot for so many vectors, but no more than MAX_PIVOTS: a bounded sample by hash of the id. Every vector gets one.
PER_PIVOT, MAX_PIVOTS = 4096, 1024
BLOCK = 8192
#: Below any score, with room to be negated; above any id.
NONE, LAST = -(1 << 62), (1 << 63) - 1


def quantised(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as whole numbers; null unless all components are finite numbers."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(wide, lambda x: F.floor(x * scale)))


class CoverTree:
    """Nested nets at halving radii: children of a node are points of it more than r apart that cover it within r.

    Nodes are ranges of a permutation of the points, with their centre's number and the exact covering radius. A node of
    no more than LEAF points, or of equal points, or whose net would be of single points, is a leaf.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        self.nodes: list[tuple[int, int, int, float]] = []  # start, end, centre, radius
        self.kids: list[list[int]] = []
        if len(x):
            d = np.linalg.norm(x - x[0], axis=1)
            todo = [(self._add(0, len(x), 0, d.max()), d.max() / 2)]
            while todo:
                node, r = todo.pop()
                todo += self._split(node, r)

    def packed(self) -> tuple[np.ndarray, bytes]:
        """The permutation, and the tree over the points in that order."""
        place = np.argsort(self.order)
        parent = np.full(len(self.nodes), -1.0)
        for k, below in enumerate(self.kids):
            parent[below] = k
        rows = [(a, b, place[c], r, parent[k]) for k, (a, b, c, r) in enumerate(self.nodes)]
        return self.order, np.array(rows, "<f8").reshape(-1, 5).tobytes()

    @classmethod
    def unpacked(cls, x: np.ndarray, blob: bytes) -> CoverTree:
        tree = cls(x[:0])
        tree.x, tree.order = x, np.arange(len(x))
        for a, b, c, r, parent in np.frombuffer(blob, "<f8").reshape(-1, 5).tolist():
            node = tree._add(int(a), int(b), int(c), r)
            if parent >= 0:
                tree.kids[int(parent)].append(node)
        return tree

    def _add(self, a: int, b: int, centre: int, radius: float) -> int:
        self.nodes.append((a, b, centre, float(radius)))
        self.kids.append([])
        return len(self.nodes) - 1

    def _split(self, node: int, r: float) -> list[tuple[int, float]]:
        a, b, centre, radius = self.nodes[node]
        if b - a <= LEAF or radius == 0:
            return []
        own = self.order[a:b]
        points = self.x[own]
        while True:
            near = np.linalg.norm(points - self.x[centre], axis=1)
            owner, chosen = np.zeros(len(own), int), [centre]
            while near.max() > r and len(chosen) <= max(8, len(own) // LEAF):
                far = int(near.argmax())
                d = np.linalg.norm(points - points[far], axis=1)
                closer = d < near
                owner[closer], near[closer] = len(chosen), d[closer]
                chosen.append(int(own[far]))
            if len(chosen) > 1 or r == 0:
                break
            r /= 2
        if len(chosen) < 2:
            return []
        rank = np.argsort(owner, kind="stable")
        self.order[a:b] = own[rank]
        sizes, at, out = np.bincount(owner, minlength=len(chosen)), a, []
        for k, n in enumerate(sizes.tolist()):
            if n:
                child = self._add(at, at + n, chosen[k], near[owner == k].max())
                self.kids[node].append(child)
                out.append((child, r / 2))
                at += n
        return out


def bound(a: CoverTree, i: int, b: CoverTree, j: int) -> float:
    """No inner product between the balls of node i and node j is larger."""
    p, q, r, s = a.x[a.nodes[i][2]], b.x[b.nodes[j][2]], a.nodes[i][3], b.nodes[j][3]
    return float(p @ q + np.linalg.norm(p) * s + np.linalg.norm(q) * r + r * s)


def dual_search(queries: CoverTree, qid: np.ndarray, data: CoverTree, vid: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) of each query's best k in this block; ``floor``: scores below are of no use.

    Both trees are walked together, most promising pairs first. ``worst`` holds each query's k-th score so far; a query
    node's worst is the smallest of its queries. A bound equal to it is followed, since ties go to the smaller id.
    """
    worst = floor.astype(np.int64).copy()
    best_s = np.full((len(qid), k), NONE)
    best_v = np.full((len(qid), k), LAST)
    stack = [(0, 0, bound(queries, 0, data, 0))]
    while stack:
        i, j, top = stack.pop()
        a, b = queries.nodes[i][:2]
        rows = queries.order[a:b]
        if top + 1e-6 * abs(top) + 1e-3 < worst[rows].min():
            continue
        if not queries.kids[i] and not data.kids[j]:
            c, d = data.nodes[j][:2]
            cols = data.order[c:d]
            s = np.rint(queries.x[rows] @ data.x[cols].T).astype(np.int64)
            s[vid[cols] == qid[rows][:, None]] = NONE
            some = (s >= worst[rows][:, None]).any(1)  # the others gain nothing here
            if not some.any():
                continue
            rows, s = rows[some], s[some]
            v = np.where(s == NONE, LAST, vid[cols])
            s, v = np.concatenate([best_s[rows], s], 1), np.concatenate([best_v[rows], v], 1)
            pick = np.lexsort((v, -s), axis=1)[:, :k] if s.shape[1] else np.empty((len(rows), 0), int)
            best_s[rows], best_v[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(v, pick, 1)
            worst[rows] = np.maximum(worst[rows], best_s[rows][:, k - 1])
            continue
        down_q = queries.kids[i] if queries.kids[i] and (not data.kids[j] or queries.nodes[i][3] >= data.nodes[j][3]) else [i]
        down_d = data.kids[j] if data.kids[j] and (down_q == [i]) else [j]
        stack += sorted(((p, q, bound(queries, p, data, q)) for p in down_q for q in down_d), key=lambda t: t[2])
    on = (best_v < LAST) & (best_s >= floor[:, None])
    return np.nonzero(on)[0], best_v[on], best_s[on]


def packed(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def longs(blob: Column) -> Column:
    """Array of the longs in a blob."""

    @F.pandas_udf("array<bigint>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x, "<i8"))

    return unpack(blob)


def blocks_of(vectors: DataFrame, pivots: np.ndarray, salt: str) -> DataFrame:
    """(blk, pivot, centre, radius, ids, data, tree): vectors and their cover tree, by nearest pivot, BLOCK at most on average for each.

    A pivot with many vectors, such as copies of one, has as many blocks as its number asks for, dealt by hash.
    """

    @F.pandas_udf("long")
    def nearest(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="int64")
        x = np.stack(v.to_numpy()).astype(float)
        return pd.Series((((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1)))

    at = materialize(vectors.withColumn("pivot", nearest("v")))
    parts = at.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))  # a row for each pivot: MAX_PIVOTS at most
    dealt = at.join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(salt)), "parts"))

    def build(key, pdf):
        x, ids = np.stack(pdf.v.to_numpy()).astype(np.int64), pdf.vec_id.to_numpy()
        centre = np.rint(x.mean(0)).astype(np.int64)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        order, tree = CoverTree(x.astype(float)).packed()
        return pd.DataFrame({
            "blk": [int(key[0]) << 32 | int(key[1])], "pivot": [int(key[0])], "centre": [packed(centre)], "radius": [radius],
            "ids": [packed(ids[order])], "data": [packed(x[order])], "tree": [tree],
        })

    return dealt.groupBy("pivot", "part").applyInPandas(build, "blk long, pivot long, centre binary, radius double, ids binary, data binary, tree binary")


def nearest_by_product(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller vec_id.

    ``vectors``: vec_id and v, an array of whole numbers; rows with a null in either take no part. All vectors must have
    one length. Candidates are all rows with another vec_id than the query's; repeated ids are rows of their own. Each
    block of queries first meets the data of its own pivot; then it meets every other block whose ball can still hold a
    product as high as the block's worst k-th score. No queries or no data: no rows.
    """
    vectors = materialize(vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long"), F.col("v").cast("array<bigint>"), is_query.alias("q")))
    sample = vectors.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(min(MAX_PIVOTS, max(8, vectors.count() // PER_PIVOT))).select("v").collect()
    out = "query_id long, vec_id long, score long"
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = np.unique(np.array([r.v for r in sample], float), axis=0)
    dim = pivots.shape[1]
    data = materialize(blocks_of(vectors.select("vec_id", "v"), pivots, "d"))
    queries = materialize(blocks_of(vectors.where("q").select("vec_id", "v"), pivots, "q").withColumnsRenamed({c: f"q_{c}" for c in ("blk", "pivot", "centre", "radius", "ids", "data", "tree")}))

    def unpack(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, "<i8"), np.frombuffer(x, "<i8").reshape(-1, dim).astype(float)

    def search(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                (qid, q), (vid, x) = unpack(row.q_ids, row.q_data), unpack(row.ids, row.data)
                low = np.frombuffer(row.floors, "<i8") if getattr(row, "floors", None) is not None else np.full(len(qid), NONE)
                n, v, s = dual_search(CoverTree.unpacked(q, row.q_tree), qid, CoverTree.unpacked(x, row.tree), vid, k, low)
                yield pd.DataFrame({"query_id": qid[n], "vec_id": v, "score": s})

    own = queries.join(data, queries.q_pivot == data.pivot)
    first = materialize(own.mapInPandas(search, out))
    # each query's k-th score so far, in the order of its block's ids
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    members = queries.select("q_blk", F.posexplode(longs(F.col("q_ids"))).alias("pos", "query_id"))
    low = members.join(kth.dropDuplicates(["query_id"]), "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE)))

    def gather(key, pdf):
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"q_blk": [key[0]], "floors": [packed(pdf.kth.to_numpy())], "least": [int(pdf.kth.min())]})

    floors = low.groupBy("q_blk").applyInPandas(gather, "q_blk long, floors binary, least long")
    queries = materialize(queries.join(floors, "q_blk"))

    @F.pandas_udf("double")
    def highest(c: pd.Series, r: pd.Series, d: pd.Series, s: pd.Series) -> pd.Series:
        if not len(c):
            return pd.Series([], dtype=float)
        x, y = (np.stack([np.frombuffer(b, "<i8") for b in v]).astype(float) for v in (c, d))
        return pd.Series((x * y).sum(1) + np.linalg.norm(x, axis=1) * s.to_numpy() + np.linalg.norm(y, axis=1) * r.to_numpy() + r.to_numpy() * s.to_numpy())

    # pairs of block descriptions (no vectors): the top nodes of both trees
    tops = queries.select("q_blk", "q_pivot", "q_centre", "q_radius", "least").join(
        data.select("blk", "pivot", "centre", "radius"), F.col("q_pivot") != F.col("pivot")
    )
    todo = tops.where(highest("q_centre", "q_radius", "centre", "radius") * (1 + 1e-6) + 1e-3 >= F.col("least")).select("q_blk", "blk")
    todo = materialize(todo)
    pairs = todo.join(queries.select("q_blk", "q_ids", "q_data", "q_tree", "floors"), "q_blk").join(data.select("blk", "ids", "data", "tree"), "blk")
    n = max(1, todo.count())
    rest = pairs.repartition(min(n, 4096), "q_blk", "blk").mapInPandas(search, out)
    ranked = first.union(rest).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
