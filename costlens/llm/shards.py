"""Search a stated query set against all vectors, shard by shard.

Vectors are dealt into shards by a hash of their id.  A task gets a shard's vectors first, builds
its index, and then streams the queries past it in Arrow batches: it holds one shard and one batch, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a shard, on average.
SHARD = 8192
#: Queries that are searched together.
BLOCK = 1024


def finite(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def shard_count(points: DataFrame, size: int = SHARD) -> int:
    return max(1, -(-points.count() // size))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def search(
    points: DataFrame, queries: DataFrame, build: Callable, find: Callable, kind, schema: str, shards: int
) -> DataFrame:
    """``find(index, ids, vectors, bounds)`` for every shard and every batch of its queries.

    points: ``vec_id, v``; queries: ``vec_id, v, shard, bound``.  Vectors meet those of their own
    length only.  Of several vectors under one id a shard keeps the smallest.
    ``build(ids, vectors)`` makes the index; ``find`` returns arrays for ``schema``.
    """
    rows = (
        points.select(F.size("v").alias("width"), shard_of(shards).alias("shard"), F.lit(0).alias("query"), "vec_id", "v", F.lit(None).cast("double").alias("bound"))
        .unionByName(queries.select(F.size("v").alias("width"), "shard", F.lit(1).alias("query"), "vec_id", "v", "bound"))
        .repartition(shards, "width", "shard")
        .sortWithinPartitions("width", "shard", "query", "vec_id", "v")
    )
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, index = None, [], [], None
        for batch in batches:
            group = batch.column("width").to_numpy().astype(np.int64) << 33 | batch.column("shard").to_numpy().astype(np.int64) << 1
            group |= batch.column("query").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if group[a] >> 1 != at:
                    at, ids, vectors, index = group[a] >> 1, [], [], None
                part = batch.slice(a, b - a)
                some, width = part.column("vec_id").to_numpy(), int(group[a] >> 33)
                matrix = _matrix(part.column("v"), width, kind)
                if not group[a] & 1:
                    ids.append(some)
                    vectors.append(matrix)
                    continue
                if not ids:
                    continue
                if index is None:
                    known, first = np.unique(np.concatenate(ids), return_index=True)
                    index = build(known, np.concatenate(vectors)[first])
                    ids, vectors = [known], []
                bounds = part.column("bound").to_numpy(zero_copy_only=False)
                for c in range(0, len(some), BLOCK):
                    out = find(index, some[c : c + BLOCK], matrix[c : c + BLOCK], bounds[c : c + BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    return rows.mapInArrow(run, schema)


def own_queries(points: DataFrame, divisor: int) -> DataFrame:
    """One vector for each id divisible by ``divisor`` (the smallest, if several)."""
    return points.where(F.col("vec_id") % divisor == 0).groupBy("vec_id", F.size("v").alias("w")).agg(F.min("v").alias("v")).drop("w")


def everywhere(queries: DataFrame, shards: int) -> DataFrame:
    """A copy of each query for every shard."""
    return queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def best(indices: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of ``indices`` with the highest score, ties to the smaller id."""
    if len(indices) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        indices, scores = indices[keep], scores[keep]
    return indices[np.lexsort((ids[indices], -scores))[:k]]
