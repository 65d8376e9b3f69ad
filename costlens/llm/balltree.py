"""Exact top-k inner products by branch and bound over a ball tree per shard.

A ball with centre ``c`` and radius ``r`` holds no vector whose inner product with ``q`` is
above ``q.c + |q| r``.  A query descends the child with the higher bound first and skips balls
below its k-th score so far.  The k-th score is shared: each query is first searched in its own shard only, and
the score found there is where all other shards start.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shards as sh
from .common import stored

LEAF = 64
SCALE = 1024
#: Sums of whole numbers below this are exact in double precision.
EXACT = float(1 << 53)
_NONE = np.iinfo(np.int64).min + 1


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.order = np.arange(len(ids))
        self.ids, self.whole = ids, vectors
        points = vectors.astype(np.float64)
        self.nodes: list[tuple] = []  # centre, radius, start, end, left, right
        self._grow(points, 0, len(ids))
        self.ids, self.whole, self.points = ids[self.order], vectors[self.order], points[self.order]
        self.most = float(np.abs(self.points).max(initial=0))

    def _grow(self, points: np.ndarray, start: int, end: int) -> int:
        own = points[self.order[start:end]]
        centre = own.mean(0)
        distance = np.sqrt(((own - centre) ** 2).sum(1))
        at = len(self.nodes)
        self.nodes.append((centre, float(distance.max()) * (1 + 1e-9), start, end, -1, -1))
        if end - start > LEAF:
            far = own[distance.argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            half = (end - start) // 2
            cut = np.argpartition(own @ (other - far), half)
            self.order[start:end] = self.order[start:end][cut]
            left = self._grow(points, start, start + half)
            right = self._grow(points, start + half, end)
            self.nodes[at] = (*self.nodes[at][:4], left, right)
        return at

    def search(self, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int):
        """Query ids, vector ids and scores of the up to ``k`` best with at least ``kth`` each."""
        real = queries.astype(np.float64)
        norms = np.sqrt((real**2).sum(1))
        exact = self.most * float(np.abs(real).max(initial=0)) * real.shape[1] < EXACT
        scores = np.full((len(ids), k), _NONE, np.int64)
        found = np.full((len(ids), k), -1, np.int64)
        slack = 1e-9 * norms

        def bound(node: int, some: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            return real[some] @ centre + norms[some] * radius + slack[some] * (np.sqrt(centre @ centre) + radius) + 1e-6

        def visit(node: int, some: np.ndarray) -> None:
            some = some[bound(node, some) >= kth[some]]
            if not len(some):
                return
            _, _, start, end, left, right = self.nodes[node]
            if left >= 0:
                better = bound(left, some) >= bound(right, some)
                visit(left, some[better])
                visit(right, some)
                visit(left, some[~better])
                return
            if exact:
                got = np.rint(real[some] @ self.points[start:end].T).astype(np.int64)
            else:
                got = queries[some] @ self.whole[start:end].T
            got = np.where(self.ids[start:end] == ids[some][:, None], _NONE, got)
            hit = got.max(1) >= kth[some]
            some, got = some[hit], got[hit]
            if not len(some):
                return
            all_scores = np.concatenate([scores[some], got], 1)
            all_ids = np.concatenate([found[some], np.broadcast_to(self.ids[start:end], got.shape)], 1)
            pick = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[some], found[some] = np.take_along_axis(all_scores, pick, 1), np.take_along_axis(all_ids, pick, 1)
            kth[some] = np.maximum(kth[some], scores[some, -1])

        visit(0, np.arange(len(ids)))
        row, column = np.nonzero((scores != _NONE) & (scores >= kth[:, None]))
        return ids[row], found[row, column], scores[row, column]


def top_k(vectors: DataFrame, divisor: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query.

    ``vectors(vec_id, embedding)``; components count as ``floor(1024 * x)``, and sums beyond 64 bits wrap.
    Queries are the ids divisible by ``divisor``.  Vectors that are null, empty or
    hold null or non-finite components, and rows without an id, take no part.
    Only vectors of one length are compared.  Equal scores go to the smaller id; rows that repeat
    an id count once, with the smallest vector.
    """
    points = vectors.where(F.col("vec_id").isNotNull() & sh.finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"),
    )
    shards = sh.shard_count(points)
    queries = sh.own_queries(points, divisor)
    schema = "query_id long, vec_id long, score long"

    def find(tree, ids, matrix, bounds):
        kth = np.where(np.isnan(bounds), _NONE, np.nan_to_num(bounds)).astype(np.int64)
        return tree.search(ids, matrix, kth, k)

    def over(asked: DataFrame) -> DataFrame:
        return sh.search(points, asked, BallTree, find, np.int64, schema, shards)

    home = over(queries.select("vec_id", "v", sh.shard_of(shards).alias("shard"), F.lit(None).cast("double").alias("bound")))
    if shards > 1:
        home = stored(home, "home")
        # a double below the k-th score; scores of this size are exact or rounded by at most one part in 2^53
        kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        below = F.col("kth").cast("double")
        below = below - F.abs(below) * 2.0**-51
        asked = (
            sh.everywhere(queries.withColumn("own", sh.shard_of(shards)), shards)
            .where("shard <> own")
            .join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
            .select("vec_id", "v", "shard", F.when(F.abs(below) < 9e18, below).alias("bound"))
        )
        home = home.unionByName(over(asked))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        home.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
