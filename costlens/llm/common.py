"""Helpers of the corpus operators: written tables, text buffers, 64-bit hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from costlens.session import scratch_table

#: Bytes of text that one step of a task works on; a single longer text is taken alone.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = frame.sparkSession
    path = scratch_table(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def tasks(frame: DataFrame) -> int:
    """Partitions for a shuffle of this session."""
    return max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and the bounds of each; null counts as empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over the batches of a task, which gives memory back to the system at its end.

    Python workers live on between tasks and stages; without this each keeps the most it ever held.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (public constants of MurmurHash3)."""
    x = np.asarray(x, np.uint64).copy()
    for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(33)
        x *= factor
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base & 0xFFFFFFFFFFFFFFFF), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: A random 64-bit value for each byte and an odd multiplier, the same in every task.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9FB21C651E98DF25


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of all texts: starts, ends, and the text of each."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= space[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    shift = np.cumsum(lengths) - lengths
    inside = np.repeat(starts - shift, lengths) + np.arange(lengths.sum())
    place = np.arange(len(inside)) - np.repeat(shift, lengths)
    value = BYTE_VALUES[data[inside]] * powers(BASE, int(lengths.max()))[place]
    return mix(np.add.reduceat(value, shift))
