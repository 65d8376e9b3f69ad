"""Fill-in-the-middle transformation: texts cut at unit bounds found in 64-bit words (SWAR).

A unit is a run of ASCII letters or one other character.  The UTF-8 bytes of many texts are viewed as
``uint64`` words; arithmetic on whole words marks every byte that ends a unit, ``bitwise_count`` counts the marks of a word,
a binary search over the running counts finds the word that holds the wanted mark, and a byte-wise prefix sum selects it there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of texts that are changed, and percent of these that begin with their suffix.
RATE, SPM_RATE = 90, 20


def _each(byte: int) -> np.uint64:
    """A word with ``byte`` eight times."""
    return np.uint64(0x0101010101010101 * byte)


_TOP, _LOW = _each(0x80), _each(0x7F)
_ONE, _SEVEN, _EIGHT = np.uint64(1), np.uint64(7), np.uint64(8)


def _words(data: np.ndarray) -> np.ndarray:
    """Little-endian words, zero bytes after the end; at least one byte of padding."""
    out = np.zeros(len(data) // 8 + 1, "<u8")
    out.view(np.uint8)[: len(data)] = data
    return out


def _letters(words: np.ndarray) -> np.ndarray:
    """Top bit of each byte that is A-Z or a-z."""
    low = (words | _each(0x20)) & _LOW
    from_a = low + _each(0x80 - ord("a"))
    past_z = low + _each(0x7F - ord("z"))
    return from_a & ~past_z & ~words & _TOP


def _followers(words: np.ndarray) -> np.ndarray:
    """Top bit of each byte that continues a character (10xxxxxx)."""
    return words & ~(words << _ONE) & _TOP


def _next(marks: np.ndarray) -> np.ndarray:
    """Marks moved to the byte before."""
    out = marks >> _EIGHT
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


class Marks:
    """Marked bytes with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before byte ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (_ONE << (byte * _EIGHT)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Byte of the ``nth`` mark, from 1."""
        word = np.searchsorted(self.before, nth, "left") - 1
        inside = (nth - self.before[word]).astype(np.uint64)
        # byte i of ``sums`` counts the marks in bytes 0 to i, at most 8
        sums = (self.words[word] >> _SEVEN) * _each(1)
        # a byte with fewer marks than wanted borrows its top bit
        fewer = ~((sums | _TOP) - inside * _each(1)) & _TOP
        return word * 8 + np.bitwise_count(fewer)


class Units:
    """Unit ends of many texts in one buffer."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.bounds = bounds
        words = _words(data)
        letters, followers = _letters(words), _followers(words)
        ends = ~_next(followers) & ~(letters & _next(letters)) & _TOP
        starts = ~followers & _TOP
        for marks in (ends, starts):
            marks.view(np.uint8)[len(data) :] = 0
        # the last byte of a text ends a unit whatever follows
        full = bounds[1:] > bounds[:-1]
        ends.view(np.uint8)[bounds[1:][full] - 1] = 0x80
        self.ends, self.starts = Marks(ends), Marks(starts)
        self.first = self.ends.rank(bounds)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def offsets(self, units: np.ndarray) -> np.ndarray:
        """Byte behind the first ``units`` units of each text."""
        at = self.bounds[:-1].copy()
        some = np.flatnonzero(units > 0)
        at[some] = self.ends.select(self.first[:-1][some] + units[some]) + 1
        return at

    def characters(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.starts.rank(high) - self.starts.rank(low)


def _draws() -> list[Column]:
    """Four whole numbers below 2**32 for each document."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("doc_id").cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of ``docs(doc_id, text)``.

    ``n`` units; the cuts and the form follow from the hash of the id.  Form ``plain`` keeps the text: where it is
    null or empty (output empty), holds a marker, has no id, or by chance.  Rows that repeat an id count each.  Texts are
    taken whole, in steps of about 1 MB; a longer text is a step of its own.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *_draws())
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            data, bounds = utf8(batch.column("text"))
            units = Units(data, bounds)
            n = units.counts()
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            h = [batch.column(f"h{i}").fill_null(0).to_numpy() for i in range(1, 5)]
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            low, high = units.offsets(np.minimum(one, two)), units.offsets(np.maximum(one, two))
            changed = known & (n > 0) & (h[2] % 100 < rate)
            turned = h[3] % 100 < spm_rate
            raw = data.tobytes()
            forms, outputs = [], []
            for a, b, c, d, change, turn in zip(
                bounds[:-1].tolist(), low.tolist(), high.tolist(), bounds[1:].tolist(), changed.tolist(), turned.tolist()
            ):
                if not change or any(raw.find(x, a, d) >= 0 for x in marks):
                    forms.append(PLAIN)
                    outputs.append(raw[a:d])
                elif turn:
                    forms.append(SPM)
                    outputs.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                else:
                    forms.append(PSM)
                    outputs.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
            plain = np.array([f == PLAIN for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n), pa.array(forms, pa.string()),
                    pa.array(units.characters(bounds[:-1], low), mask=plain), pa.array(units.characters(low, high), mask=plain),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                [f.split()[0] for f in _SCHEMA.split(", ")],
            )

    return source.mapInArrow(run, _SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text an output was made of; its pieces hold no marker, so each marker stands once."""

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def behind(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, -1)

    middle = behind(output, MIDDLE)
    head = before(output, MIDDLE)
    psm = F.concat(behind(before(head, SUFFIX), PREFIX), middle, behind(head, SUFFIX))
    spm = F.concat(behind(head, PREFIX), middle, behind(before(head, PREFIX), SUFFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
