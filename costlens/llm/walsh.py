"""Centroid clustering of whole-number vectors by progressive search in the Walsh-Hadamard domain.

The transform of vectors and centroids is exact and keeps squared distances, times the width.  Differences are
accumulated from the coarsest coefficients to the finest; a centroid whose partial sum already exceeds
the full distance of another one is strictly worse and goes, the others finish all coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as sh
from .common import stored

WIDTH = 64
#: Vectors that are searched together.
BLOCK = 4096
#: Coefficients after which centroids are compared; every one has twice as many as the last.
LEVELS = (0, 1, 2, 4, 8, 16, 32, 64)
#: Largest component for which sums of squares fit 64 bits; beyond, Python's whole numbers are used.
NARROW = 1 << 24
_LONGEST = (1 << 63) - 1


def _sequency(width: int) -> np.ndarray:
    """Order of the Hadamard rows by their number of sign changes."""
    at = np.arange(width)
    bits = at[:, None] & at[None, :]
    signs = np.zeros_like(bits)
    while bits.any():
        signs ^= bits & 1
        bits >>= 1
    return (signs[:, 1:] != signs[:, :-1]).sum(1).argsort(kind="stable")


_COARSE_FIRST = _sequency(WIDTH)


def transform(vectors: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, coarse to fine."""
    out, half = vectors, 1
    while half < WIDTH:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(out), -1)
        half *= 2
    return out[:, _COARSE_FIRST]


def exact(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type whose sums of squares can't overflow."""
    reach = max((abs(int(x)) for a in (vectors, centroids) if a.size for x in (a.max(), a.min())), default=0)
    kind = np.int64 if reach <= NARROW else object
    return vectors.astype(kind), centroids.astype(kind)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row, ties to the smaller number."""
    vectors, centroids = exact(vectors, centroids)
    a, b = transform(vectors), transform(centroids)
    n, k = len(a), len(b)
    row, centroid = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = np.zeros(n * k, a.dtype)
    whole = np.full((n, k), None if a.dtype == object else np.iinfo(np.int64).max, a.dtype)
    bound = None
    for low, high in zip(LEVELS, LEVELS[1:]):
        difference = a[row, low:high] - b[centroid, low:high]
        part = part + (difference * difference).sum(1)
        if high == WIDTH:
            break
        # full distance of the centroid that leads so far
        first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        least = np.minimum.reduceat(part, first)
        leads = np.flatnonzero(part == np.repeat(least, np.diff(np.concatenate([first, [len(row)]]))))
        leads = leads[np.concatenate([[0], np.flatnonzero(np.diff(row[leads])) + 1])]
        rest = a - b[centroid[leads]]
        full = (rest * rest).sum(1)
        bound = full if bound is None else np.minimum(bound, full)
        stays = (part <= bound[row]).astype(bool)
        row, centroid, part = row[stays], centroid[stays], part[stays]
    if a.dtype == object:
        whole[:] = 1 + part.max()
    whole[row, centroid] = part
    best = whole.argmin(1)
    return best, whole[np.arange(n), best] // WIDTH


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, WIDTH)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _sums(points: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and sums of components by nearest centroid, added up in each task before they move.

    What comes back is one number for each centroid and component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), WIDTH), object)
        for batch in _blocks(batches):
            vectors = _vectors(batch)
            best, _ = nearest(vectors, centroids)
            for c in np.unique(best):
                mine, _ = exact(vectors[best == c], centroids)
                counts[c] += len(mine)
                sums[c] += mine.sum(0).astype(object)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some.astype(np.int32)), pa.array(counts[some]),
                pa.array([[Decimal(int(x)) for x in sums[c]] for c in some], pa.list_(pa.decimal128(38, 0))),
            ],
            ["cluster", "n", "sums"],
        )

    parts = points.mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    added = parts.select("cluster", "n", F.posexplode("sums").alias("at", "sum")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added.orderBy("cluster", "at").collect():
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["sum"]))
    return out


def _assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            best, distance = nearest(_vectors(batch), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(np.minimum(distance, _LONGEST).astype(np.int64))],
                ["vec_id", "cluster", "distance"],
            )

    return points.mapInArrow(run, "vec_id long, cluster int, distance long")


SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, scale: int = WIDTH) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` for each vector of 64 finite components.

    ``vectors(vec_id, embedding)``; a component x counts as ``floor(scale * x)``, cut off at the ends of a long.  Vectors that
    are null, of another length, or hold null or non-finite components take no part.  The first centroids
    are the vectors with the smallest ``sha256("1:" + vec_id)`` (null ids last, then by components), fewer if there are fewer vectors;
    rows that repeat an id count each.  Sums of distances beyond a long are cut off at its end.  No vectors: no rows.

    Centroids and their sums are the only rows that reach the driver: ``clusters`` times 64 numbers.
    """
    spark = vectors.sparkSession
    good = sh.finite(F.col("embedding")) & (F.size("embedding") == WIDTH)
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    points = stored(vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")), "vectors")
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    seeds = points.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()
    if not seeds:
        return spark.createDataFrame([], SCHEMA)
    centroids = np.array([r["v"] for r in seeds], np.int64)
    for _ in range(rounds):
        for c, (n, sums) in _sums(points, centroids).items():
            centroids[c] = [s // n for s in sums]
    found = stored(_assigned(points, centroids), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), _LONGEST)
    about = spark.createDataFrame(
        [(c, min(s, _LONGEST), total, centroids[c].tolist()) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    )
    # one row for each centroid
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

