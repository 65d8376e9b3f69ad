"""Approximate nearest neighbours by collision counting over single random projections.

Every vector, brought to length one, is projected on ``PROJECTIONS`` random lines; a shard keeps
each line's values sorted.  A query opens a window around its own value on every line
and widens all windows step by step (virtual rehashing).  A vector seen in enough
windows is verified with the exact cosine.  The search ends when the k-th verified vector is
nearer than the reach of the windows.  Where vectors lie so far apart that a share of the shard has been verified by then,
all others are compared as well, and the answer is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shards as sh

PROJECTIONS = 64
SEED = 20
#: Half width of the first windows and its growth.
WIDTH, GROWTH = 0.15, 1.25
#: Share of the windows a vector must be seen in.
THRESHOLD = 0.5
#: Distance at which half of the windows of half width 1 see a vector.
REACH = 1 / 0.67449
#: The k-th distance must be below this share of the reach.
MARGIN = 0.75
#: Share of a shard above which its other vectors are compared at once: dearer than that windows would be.
VERIFIED = 0.35
#: More than the rounding of a product of vectors.
_ROUNDING = 1e-9


class Lines:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        width = vectors.shape[1]
        self.lines = np.random.default_rng(SEED + width).standard_normal((width, PROJECTIONS))
        values = ((vectors / self.norms[:, None]) @ self.lines).T
        self.order = values.argsort(1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, 1)
        self.flat = self.order.ravel()

    def cosine(self, query: np.ndarray, some: np.ndarray) -> np.ndarray:
        dot = (self.vectors[some] * query).sum(1)
        return dot / (np.sqrt((query * query).sum()) * self.norms[some])

    def rest(self, query: np.ndarray, some: np.ndarray, least: float) -> np.ndarray:
        """Those of ``some`` that may reach the cosine ``least``."""
        near = self.vectors[some] @ query / (self.norms[some] * np.sqrt((query * query).sum()))
        return some[near >= least - _ROUNDING]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int):
        n = len(self.ids)
        values = (queries / np.sqrt((queries * queries).sum(1))[:, None]) @ self.lines
        base = np.arange(PROJECTIONS) * n
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        out: list[tuple] = []
        active = np.arange(len(ids))
        low = np.stack([np.searchsorted(self.sorted[j], values[:, j]) for j in range(PROJECTIONS)], 1)
        high = low.copy()
        counts = np.zeros((len(ids), n), np.uint8 if PROJECTIONS < 256 else np.uint16)
        done = [np.zeros(0, np.int64)] * len(ids)
        cosines = [np.zeros(0)] * len(ids)
        half = WIDTH
        while len(active):
            to_low, to_high = low.copy(), high.copy()
            for j in range(PROJECTIONS):
                to_low[active, j] = np.searchsorted(self.sorted[j], values[active, j] - half)
                to_high[active, j] = np.searchsorted(self.sorted[j], values[active, j] + half, "right")
            going = []
            for q in active:
                starts = np.concatenate([base + to_low[q], base + high[q]])
                lengths = np.concatenate([low[q] - to_low[q], to_high[q] - high[q]])
                seen = self.flat[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
                before = counts[q]
                after = before + np.bincount(seen, minlength=n).astype(before.dtype)
                new = np.flatnonzero((after >= need) & (before < need))
                counts[q] = after
                new = new[self.ids[new] != ids[q]]
                done[q] = np.concatenate([done[q], new])
                cosines[q] = np.concatenate([cosines[q], self.cosine(queries[q], new)])
                if len(done[q]) >= k:
                    kth = np.partition(cosines[q], len(cosines[q]) - k)[len(cosines[q]) - k]
                    near = np.sqrt(max(0.0, 2 - 2 * kth)) <= MARGIN * REACH * half
                    if near:
                        continue
                    if len(done[q]) >= VERIFIED * n + k:
                        rest = self.rest(queries[q], np.flatnonzero((counts[q] < need) & (self.ids != ids[q])), kth)
                        done[q] = np.concatenate([done[q], rest])
                        cosines[q] = np.concatenate([cosines[q], self.cosine(queries[q], rest)])
                        continue
                if (to_low[q] == 0).all() and (to_high[q] == n).all():
                    continue  # the windows hold everything
                going.append(q)
            low, high = to_low, to_high
            active = np.array(going, np.int64)
            half *= GROWTH
        for q in range(len(ids)):
            at = np.arange(len(done[q]))
            pick = sh.best(at, cosines[q], self.ids[done[q]], k)
            out.append((np.full(len(pick), ids[q]), self.ids[done[q][pick]], cosines[q][pick]))
        return tuple(np.concatenate(x) for x in zip(*out))


def nearest(vectors: DataFrame, divisor: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for each query, by cosine.

    ``vectors(vec_id, embedding)``; queries are the ids divisible by ``divisor``.  Vectors
    that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part.
    Only vectors of one length are compared.  Ties go to the smaller id; rows that repeat an id
    count once, with the smallest vector.  Scores are exact, the choice of neighbours is not.
    """
    points = vectors.where(
        F.col("vec_id").isNotNull() & sh.finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    ).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    shards = sh.shard_count(points)
    queries = sh.everywhere(sh.own_queries(points, divisor), shards).withColumn("bound", F.lit(None).cast("double"))
    found = sh.search(
        points, queries, Lines, lambda index, ids, matrix, _: index.search(ids, matrix, k), np.float64,
        "query_id long, vec_id long, score double", shards,
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
