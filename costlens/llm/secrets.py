"""Secret scan: fixed patterns plus a battery of randomness tests under false-discovery control.

The patterns give the base spans.  The battery looks at every other long run of token characters, and at its
pieces between ``+ /``, between ``- _`` and between all four, as a secret may stand in a path or beside words:
the smallest encoding alphabet that holds it is inferred, and the run is tested for
uniform use of that alphabet and of its digits, capitals and small letters (chi-squared), for runs
about the middle symbol, and for serial correlation.  The p-values are combined (Fisher).  Under the hypothesis "random" small
values speak for ordinary text; Benjamini-Hochberg, within strata of length, decides which runs
are ordinary, and what it can't reject is reported as ``random``.

Two passes over the texts: the first only fills a histogram of p-values (strata times
bins, whatever the size of the corpus), the second scans again with the limits known, so
neither texts nor spans are shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, steps, utf8

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Shortest run that the battery can tell from ordinary text.
LEAST_RANDOM = 24
#: Share of true secrets among the runs called ordinary, at most.
RATE = 0.01
#: Lower ends of the strata of length.
STRATA = (24, 32, 48, 64, 128)
#: Bins of a p-value: tenths of its decimal logarithm.
BINS = 200

#: Encodings by size of their alphabet; fixed values of RFC 4648 and of plain digits and letters.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    DIGITS + "abcdef",
    DIGITS + "ABCDEF",
    UPPER + "234567",
    DIGITS + LOWER,
    DIGITS + UPPER,
    DIGITS + UPPER + LOWER,
    UPPER + LOWER + DIGITS + "+/",
    UPPER + LOWER + DIGITS + "-_",
)
_BETWEEN = tuple(re.compile(x) for x in ("[^+/]+", "[^_-]+", "[^+/_-]+"))
_SETS = [(frozenset(e), {c: i for i, c in enumerate(e)}) for e in ENCODINGS]


def _sort(c: str) -> int:
    return 0 if c in DIGITS else 1 if c in UPPER else 2 if c in LOWER else 3


_IS_HEX, _IS_TOKEN = np.zeros(256, bool), np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_TOKEN[list((DIGITS + LOWER + UPPER + "+/_-").encode())] = True


def _normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def chi2_tail(x: float, freedom: int) -> float:
    """Survival function, Wilson and Hilferty's normal approximation."""
    if x <= 0:
        return 1.0
    s = 2 / (9 * freedom)
    return _normal_tail(((x / freedom) ** (1 / 3) - 1 + s) / math.sqrt(s))


def randomness(token: str) -> float | None:
    """Combined p-value of the battery under "random"; None if no encoding of letters and digits holds the token."""
    used = set(token)
    if not (used & set(DIGITS)) or not (used & set(LOWER + UPPER)):
        return None
    place = next((at for held, at in _SETS if used <= held), None)
    if place is None:
        return None
    x = np.fromiter((place[c] for c in token), float, len(token))
    n, k = len(x), len(place)
    cells = max(2, min(k, n // 4))
    cell = np.arange(k) * cells // k
    sorts = np.unique([_sort(c) for c in place], return_inverse=True)[1]

    def chi2(of: np.ndarray) -> float:
        """Do the symbols fall into the classes ``of`` the alphabet as it is divided?"""
        expected = n * np.bincount(of) / k
        seen = np.bincount(of[x.astype(int)], minlength=len(expected))
        return chi2_tail(float(((seen - expected) ** 2 / expected).sum()), len(expected) - 1)

    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if not a or not b:
        runs = 2.0 ** (1 - n)
    else:
        mean = 2 * a * b / n + 1
        deviation = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        runs = 2 * _normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / deviation)
    centred = x - x.mean()
    spread = float((centred**2).sum())
    serial = 2 * _normal_tail(abs(float((centred[1:] * centred[:-1]).sum()) / spread) * math.sqrt(n)) if spread else 0.0
    fisher = -2 * sum(math.log(max(min(p, 1.0), 1e-20)) for p in (chi2(cell), chi2(sorts), runs, serial))
    return max(chi2_tail(fisher, 8), 1e-20)


def pieces(run: str) -> list[tuple[int, int]]:
    """The run and its long pieces between separators."""
    return sorted({(0, len(run))} | {m.span() for cut in _BETWEEN for m in cut.finditer(run) if m.end() - m.start() >= LEAST_RANDOM})


def stratum(length: int) -> int:
    return max(i for i, least in enumerate(STRATA) if length >= least)


def p_bin(p: float) -> int:
    return min(BINS - 1, int(-10 * math.log10(p)))


def limits(histogram: dict[tuple[int, int], int], rate: float = RATE) -> list[float]:
    """Per stratum the p-value below which Benjamini and Hochberg reject "random"."""
    out = []
    for s in range(len(STRATA)):
        counts = {b: n for (at, b), n in histogram.items() if at == s}
        total, below, limit = sum(counts.values()), 0, 0.0
        for b in sorted(counts, reverse=True):
            below += counts[b]
            if (edge := 10 ** (-b / 10)) <= rate * below / total:
                limit = edge
        out.append(limit)
    return out


def _runs(mask: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` bytes; a run ends with its text."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(mask))]
    first[cuts], last[cuts - 1] = mask[cuts], mask[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def _marked(data: bytes, needles, bounds: np.ndarray) -> set[int]:
    """Texts that hold one of the needles (a needle across two texts marks one too many)."""
    found = set()
    for needle in needles:
        at = data.find(needle)
        while at >= 0:
            doc = int(np.searchsorted(bounds, at, "right")) - 1
            found.add(doc)
            at = data.find(needle, max(at + 1, int(bounds[doc + 1]) - len(needle) + 1))
    return found


def scan(texts: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]]:
    """For each text the base spans ``(start, kind, end)`` in order and the tested runs ``(start, end, p)``, in code points."""
    data, bounds = utf8(texts)
    raw = data.tobytes()
    assigned, accessed = _marked(raw.lower(), WORDS, bounds), _marked(raw, (b"AKIA",), bounds)
    points = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with a byte
    base = np.concatenate([[0], points])[bounds]
    found: dict[int, list] = {}

    def place(starts, ends):
        docs = np.searchsorted(bounds, starts, "right") - 1
        return zip(docs.tolist(), (points[starts] - 1 - base[docs]).tolist(), (points[ends - 1] - base[docs]).tolist())

    for doc, start, end in place(*_runs(_IS_HEX[data], bounds, LEAST_HEX)):
        found.setdefault(doc, []).append((start, 2, end))
    for doc in assigned | accessed:
        text = raw[bounds[doc] : bounds[doc + 1]].decode()
        spans = found.setdefault(doc, [])
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    tested: dict[int, list] = {}
    starts, ends = _runs(_IS_TOKEN[data], bounds, LEAST_RANDOM)
    for (doc, start, end), a, b in zip(place(starts, ends), starts, ends):
        run, base_spans = raw[a:b].decode(), found.get(doc, ())
        for low, high in pieces(run):
            if any(x <= start + low and start + high <= y for x, _, y in base_spans):
                continue
            p = randomness(run[low:high])
            if p is not None:
                tested.setdefault(doc, []).append((start + low, start + high, p))
    for doc in range(len(texts)):
        yield sorted(found.get(doc, ())), tested.get(doc, [])


def random_limits(docs: DataFrame, rate: float = RATE) -> list[float]:
    """First pass: the p-value limit of each stratum of length over all of ``docs(text)``."""

    def histogram(batches):
        counts: dict[tuple[int, int], int] = {}
        for batch in steps(batches, "text"):
            for _, tested in scan(batch.column("text")):
                for start, end, p in tested:
                    key = stratum(end - start), p_bin(p)
                    counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_pydict(
            {"s": pa.array([k[0] for k in counts], pa.int32()), "b": pa.array([k[1] for k in counts], pa.int32()),
             "n": pa.array(list(counts.values()), pa.int64())}
        )

    rows = docs.select("text").mapInArrow(histogram, "s int, b int, n long").groupBy("s", "b").agg(F.sum("n").alias("n"))
    return limits({(r.s, r.b): r.n for r in rows.collect()}, rate)


def _all_spans(base, tested, limit):
    out, at = [], 0
    for a, b, _ in sorted((x for x in tested if x[2] > limit[stratum(x[1] - x[0])]), key=lambda x: (x[0], -x[1])):
        if b > at:  # not a piece of the span before
            out.append((a, 3, b))
            at = b
    return sorted(base + out)


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: counts of base spans, their digest, and all spans.

    Null and empty texts have no spans.  A span of the battery inside a base span is left out.
    Rows that repeat a ``doc_id`` are scanned one by one; an empty table gives no rows.
    """
    limit = random_limits(docs, rate)

    def rows(batches):
        for batch in steps(batches, "text"):
            found = list(scan(batch.column("text")))
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(3)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    **{f"n_{KINDS[k]}": pa.array(counts[k], pa.int64()) for k in range(3)},
                    "base_sha256": [hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found],
                    "spans": [_listed(_all_spans(base, tested, limit)) for base, tested in found],
                }
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(rows), schema)


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = RATE) -> DataFrame:
    """All rows and columns of ``docs``, each stretch of secret text replaced by ``mark`` (``n_chars`` follows if it is there)."""
    limit = random_limits(docs, rate)

    def covered(text: str, spans) -> str:
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:]

    def rows(batches):
        for batch in steps(batches, "text"):
            texts, spans = batch.column("text"), [_all_spans(*x, limit) for x in scan(batch.column("text"))]
            if any(spans):
                clean = pa.array(
                    [covered(t, s) if s else t for t, s in zip(texts.to_pylist(), spans)], texts.type
                )
                batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), clean)
            yield batch

    out = docs.mapInArrow(lean(rows), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
