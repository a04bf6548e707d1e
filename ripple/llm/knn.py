"""Exact top-k search by inner product with a KD-tree in each shard.

Vectors are dealt by hash into shards of about ``SHARD_ROWS`` rows.  In its
task a shard becomes a KD-tree: median splits along the widest component,
each node with the tight bounding box of its points.  A query walks the tree
best-first: the box bound ``sum(max(q*low, q*high))`` is the largest score a
node can hold, and the walk ends when the best bound left is below the kth
score so far (an equal bound is still opened, for ties).

Two rounds propagate the kth score: every query first searches one home
shard; its kth score there is the floor with which it enters all others,
where most nodes fall below it.  Queries meet the shards in blocks of
``QUERY_BLOCK``; a task holds one shard and one block.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple.llm.common import stored

SHARD_ROWS = 16_384
QUERY_BLOCK = 8_192
LEAF_ROWS = 128
BOUND_BLOCK = 256
ROWS = "id long, vector array<long>"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
              scale: float = 256.0) -> DataFrame:
    """``id, vector array<long>``: floor(scale * x) of every component, x as double.

    Vectors that are null or hold a null or non-finite component take no
    part, nor do rows without an id.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(x, lambda v: F.floor(v * scale)).alias("vector")))


class KdTree:
    """Nodes in arrays; the points of a leaf are a run of ``order``, in rising id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order, low, high, kids, runs = np.lexsort((ids,)), [], [], [], []
        self.ids, self.points = ids, points
        todo = [(0, len(ids))]
        while todo:                                      # breadth first: children get the next free numbers
            nxt = []
            for a, b in todo:
                own = points[order[a:b]]
                lo, hi = own.min(axis=0), own.max(axis=0)
                low.append(lo)
                high.append(hi)
                runs.append((a, b))
                widest = int(np.argmax(hi - lo)) if points.shape[1] else 0
                if b - a <= LEAF_ROWS or not points.shape[1] or hi[widest] == lo[widest]:
                    kids.append(-1)
                    continue
                mid = (b - a) // 2
                part = np.argpartition(own[:, widest], mid)
                for s in (part[:mid], part[mid:]):
                    s.sort()                             # keeps rising ids inside each half
                order[a:b] = order[a:b][part]
                kids.append(len(runs) - 1)               # marked; numbered below
                nxt += [(a, a + mid), (a + mid, b)]
            base = len(runs)
            at = base
            for i in range(base - len(todo), base):
                if kids[i] >= 0:
                    kids[i], at = at, at + 2
            todo = nxt
        self.low, self.high = np.array(low), np.array(high)
        self.kids, self.runs = kids, runs
        self.ids, self.points = ids[order], points[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest score each node can hold, for each query."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.high.T + down @ self.low.T

    def search(self, own_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor) -> list[tuple[int, int]]:
        """Up to k best ``(-score, id)`` with a score of at least ``floor``, the query's own row left out."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if floor is not None and -bound < floor:
                break
            kid = self.kids[node]
            if kid >= 0:
                for c in (kid, kid + 1):
                    if floor is None or bounds[c] >= floor:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            a, b = self.runs[node]
            scores = self.points[a:b] @ query
            ids = self.ids[a:b]
            ok = ids != own_id
            if floor is not None:
                ok &= scores >= floor
            at = np.flatnonzero(ok)
            if len(at) > k:                              # of a leaf's points only the k best can matter
                at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            best = sorted(best + [(-int(scores[i]), int(ids[i])) for i in at])[:k]
            if len(best) == k:
                kth = -best[-1][0]
                floor = kth if floor is None else max(floor, kth)
        return best


def _searched(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best candidates of each query row in the shard and block it meets."""

    def matrix(t: pa.Table, dim: int) -> np.ndarray:
        flat = t.column("vector").combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.Array) else pa.chunked_array(flat.chunks).combine_chunks().flatten()
        return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(t), dim)

    def run(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        dim = key[2].as_py()
        if len(shard) and len(block):
            tree = KdTree(shard.column("id").to_numpy(), matrix(shard, dim))
            rows, uids = matrix(block, dim), block.column("uid").to_pylist()
            ids, floors = block.column("id").to_pylist(), block.column("floor").to_pylist()
            for a in range(0, len(rows), BOUND_BLOCK):
                bounds = tree.bounds(rows[a:a + BOUND_BLOCK])
                for i in range(a, min(a + BOUND_BLOCK, len(rows))):
                    for score, found in tree.search(ids[i], rows[i], bounds[i - a], k, floors[i]):
                        for column, x in zip(out, (uids[i], ids[i], found, -score)):
                            column.append(x)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["uid", "query_id", "vec_id", "score"])

    return (points.groupBy("shard", "block", "dim").cogroup(queries.groupBy("shard", "block", "dim"))
            .applyInArrow(run, "uid long, query_id long, vec_id long, score long"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row, by score, then smaller id."""
    w = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best points of each query, over all points.

    ``points`` and ``queries`` are ``id, vector array<long>``.  A point with
    the query's id is the query's own row and no candidate; ties go to the
    smaller id.  Only vectors of equal length are compared.  Repeated points
    are candidates each; queries with equal id and vector count once.  With
    fewer than k candidates all are returned; an empty table gives an empty
    one.  Scores are 64-bit integers: components times components must fit.
    """
    points = stored(points.withColumn("dim", F.size("vector")), "points")
    asked = stored(queries.dropDuplicates(["id", "vector"]).withColumn("dim", F.size("vector"))
                   .withColumn("uid", F.monotonically_increasing_id()), "queries")
    n, n_asked = points.count(), asked.count()
    n_shards, n_blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(n_asked / QUERY_BLOCK))
    points = points.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(n_shards)))
    asked = asked.withColumns({"block": F.pmod(F.xxhash64("uid"), F.lit(n_blocks)),
                               "home": F.pmod(F.hash("uid"), F.lit(n_shards))})
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    points = points.withColumn("block", blocks)
    first = stored(_searched(points, asked.withColumn("shard", F.col("home").cast("long"))
                             .withColumn("floor", F.lit(None).cast("long")), k), "first")
    if n_shards == 1:
        found = first
    else:
        # the kth score of the home shard, where it held k candidates, is the floor elsewhere
        kth = first.groupBy("uid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        others = asked.join(kth, "uid", "left").withColumn(
            "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))).where(
            F.col("shard") != F.col("home"))
        found = first.unionByName(_searched(points, others, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
