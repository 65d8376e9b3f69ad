"""Pack documents into fixed-length sequences along a space-filling curve.

A document's hashed word counts, brought to length one, are projected on a few fixed random
directions; the Hilbert index of the quantised projections is its place on the curve.  Documents
are range-partitioned and sorted by place, and each partition cuts the stream of
its ids into full sequences.  What is left at the end of a partition is cut into
powers of two, which need no padding.

Equal documents share a place; a hash of the id orders them, so that a large group of
copies spreads over partitions too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import erf

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix, steps, tasks, utf8, word_hashes, words
from .tokens import STEP, Encoder

LENGTH = 1024
#: Hashed features, dimensions they are projected to, and bits of each.
FEATURES, DIMENSIONS, BITS = 256, 3, 10
#: Documents from which the range bounds are estimated; they only balance the tasks.
SAMPLE = 50_000
SEED = 3
END = 0

_LINES = np.random.default_rng(SEED).standard_normal((FEATURES, DIMENSIONS))
_QUANTILES = np.array([(1 + erf(x / 2**0.5)) / 2 for x in np.linspace(-8, 8, 4097)])


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of rows of whole numbers below ``2**bits`` (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> bit & 1)
    return out


def places(texts: pa.Array) -> np.ndarray:
    """Place of each text on the curve; texts without words share one."""
    data, bounds = utf8(texts)
    starts, ends, doc = words(data, bounds)
    value = word_hashes(data, starts, ends)
    feature = (value % np.uint64(FEATURES)).astype(np.int64)
    sign = 1.0 - 2.0 * ((value >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    counts = np.bincount(doc * FEATURES + feature, sign, len(texts) * FEATURES).reshape(-1, FEATURES)
    counts /= np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-12)
    spread = np.interp(counts @ _LINES, np.linspace(-8, 8, 4097), _QUANTILES)
    return hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def placed(docs: DataFrame, bounds: Broadcast | None = None) -> DataFrame:
    """``docs(doc_id, text)`` with ``place``: curve index above, hash of the id below; with ``bounds`` also the ``part`` it lies in."""

    def rows(batches):
        for batch in steps(batches, "text"):
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            place = places(batch.column("text")) << 32 | (mix(ids.view(np.uint64)) >> np.uint64(32)).astype(np.int64)
            columns = [*batch.columns, pa.array(place)]
            if bounds is not None:
                columns.append(pa.array(np.searchsorted(bounds.value, place, "right").astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "place", "part"][: len(columns)])

    schema = "doc_id long, text string, place long" + (", part int" if bounds is not None else "")
    return docs.select("doc_id", "text").mapInArrow(lean(rows), schema)


def range_bounds(docs: DataFrame, parts: int, sample: int = SAMPLE) -> np.ndarray:
    """Places that cut the curve into stretches of about equal text, from at most about ``sample`` documents."""
    rows = docs.count()
    share = min(1.0, sample / max(rows, 1))
    some = placed(docs.sample(share, SEED) if share < 1 else docs).select("place", (F.coalesce(F.length("text"), F.lit(0)) + 1).alias("n"))
    found = some.toPandas().sort_values("place")
    if not len(found):
        return np.zeros(0, np.int64)
    total = found["n"].cumsum().to_numpy()
    cut = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    return np.unique(found["place"].to_numpy()[np.minimum(cut, len(found) - 1)])


class _Stream:
    """Ids of consecutive documents, cut into sequences."""

    def __init__(self, part: int):
        self.part, self.made = part, 0
        self.units: list[tuple] = []  # doc, first id's place in it, ids, tokens of the document
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.units.append((doc, 0, ids, len(ids)))
        self.held += len(ids)

    def _take(self, size: int) -> Iterator[tuple]:
        """Pieces of one sequence of ``size`` ids from the front."""
        sequence, filled = (self.part << 40) + self.made, 0
        self.made += 1
        while filled < size:
            doc, start, ids, tokens = self.units[self.at]
            some = ids[: size - filled]
            yield doc, start, len(some), zlib.crc32(some.astype("<u4").tobytes()), tokens, sequence, filled
            filled += len(some)
            if len(some) == len(ids):
                self.at += 1
            else:
                self.units[self.at] = doc, start + len(some), ids[len(some) :], tokens
        self.held -= size

    def full(self) -> list[tuple]:
        out, self.at = [], 0
        while self.held >= LENGTH:
            out += self._take(LENGTH)
        del self.units[: self.at]
        return out

    def rest(self) -> list[tuple]:
        out, self.at = [], 0
        for bit in reversed(range(LENGTH.bit_length())):
            if self.held & 1 << bit:
                out += self._take(1 << bit)
        return out


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row for each piece of each row of ``docs(doc_id, text)``.

    ``path`` and ``ranks`` name the tokenizer's files.  Null text is empty and has its end id only; rows without an id and rows that
    repeat one are packed like others; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = tasks(docs)
    bounds = range_bounds(docs, parts)
    held = docs.sparkSession.sparkContext.broadcast(bounds)

    def sequences(batches):
        encoder, stream = Encoder(path, ranks), None

        def made(rows):
            columns = zip(*rows) if rows else [[]] * len(_COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _COLUMNS)

        for batch in steps(batches, "text", STEP):
            part = batch.column("part").to_numpy()
            ids, ends = encoder.encode(batch.column("text"))
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                if stream is None or stream.part != part[i]:
                    if stream is not None:
                        yield made(stream.full() + stream.rest())
                    stream = _Stream(int(part[i]))
                stream.add(doc, np.append(ids[ends[i] : ends[i + 1]], np.uint32(END)))
            yield made(stream.full())
        if stream is not None:
            yield made(stream.rest())

    return (
        placed(docs, held)
        .repartitionById(parts, "part")
        .sortWithinPartitions("part", "place", "doc_id", "text")
        .mapInArrow(lean(sequences), ", ".join(f"{c} long" for c in _COLUMNS))
    )
