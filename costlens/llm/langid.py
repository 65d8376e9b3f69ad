"""Language identification by prediction by partial matching.

For each language a context tree over bytes holds how often each byte followed the last
0 to ``ORDER`` bytes.  A byte costs ``-log2`` of its probability in the longest known context; a byte not
seen there escapes to the next shorter one (method C, with exclusion of the bytes already ruled
out), at last to equal chances for all bytes.  The statistics are frozen after training,
so the cost of a byte depends on the ``ORDER`` bytes before it alone.  All costs are
therefore laid out once as a table (context, byte) -> bits per language, and a text is
scored by table look-ups over whole arrays.  The language with the shortest code wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, release, steps, utf8

ORDER = 3
#: Labelled documents that the trees are grown from, for each language.
SAMPLE = 400
#: Languages at most; more labels than this are refused, not cut.
LANGUAGES = 256
#: A cost is stored in 1/256 bit.
UNIT = 256
#: Bytes scored at a time.
STEP = 1 << 20
_PAD = 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``ORDER`` spaces before each, and the place of each text byte in that."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(data)) + ORDER * (doc + 1)
    out = np.full(len(data) + ORDER * (len(bounds) - 1), _PAD, np.uint8)
    out[at] = data
    return out, at


def grams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each byte with the ``ORDER`` bytes before it, as one number."""
    text, at = padded(data, bounds)
    out = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        out = out << 8 | text[at - back]
    return out


def count_grams(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``lang, gram, n`` over the ``sample`` labelled documents of each language with the smallest hash.

    The counts of the languages say below which hash these lie, so that no more than
    a few times the sample is shuffled, however frequent a language is.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    shares = [x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, 4 * sample / r["count"])))]
    share = F.element_at(F.create_map(*shares), F.col("lang")) if shares else F.lit(1.0)
    value = F.xxhash64("doc_id")
    first = Window.partitionBy("lang").orderBy("value", "doc_id", "text")
    chosen = (
        labelled.where(F.col("text").isNotNull() & (value.cast("double") <= (2 * share - 1) * 2.0**63))
        .select("doc_id", "lang", "text", value.alias("value"))
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= sample)
        .select("lang", "text")
    )

    def count(batches):
        for batch in steps(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                some = batch.filter(pa.array(langs == lang))
                values, n = np.unique(grams(*utf8(some.column("text"))), return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(values), pa.string()), "gram": values, "n": n.astype(np.int64)}
                )

    counted = chosen.mapInArrow(lean(count), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen cost table: ``bits[language][row of the context, byte]`` in 1/256 bit.

    Bytes never seen in training share one column; ``row`` maps the last ``ORDER`` bytes to the longest known context.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        last = gram & 255
        seen = np.unique(np.concatenate([(gram >> 8 * k) & 255 for k in range(ORDER + 1)] + [np.array([_PAD])]))
        self.symbol = np.full(256, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        width = self.width = len(seen) + 1
        unseen = max(256 - len(seen), 1)
        weight = np.ones(width)  # bytes behind a column
        weight[-1] = unseen
        # order -1: all 256 bytes alike; cost of the shared column is that of one of its bytes
        below = (weight / weight.sum())[None]
        own = [lang == l for l in range(len(langs))]
        rows, count, tables = None, 0, [[] for _ in langs]
        for k in range(ORDER + 1):
            code = np.zeros(len(gram), np.int64)
            for back in range(k, 0, -1):
                code = code * width + self.symbol[(gram >> 8 * back) & 255]
            contexts, where = np.unique(code, return_inverse=True)
            parent = rows[contexts % width ** (k - 1)] if k else None
            # one language at a time: the tables of all of them in full precision need several times the driver's memory
            for l, table in enumerate(tables):
                low = below
                if k:
                    low, first = np.zeros((len(contexts), width)), 0
                    for part in table:
                        inside = (parent >= first) & (parent < first + len(part))
                        low[inside] = part[parent[inside] - first]
                        first += len(part)
                table.append(self._chances(len(contexts), where[own[l]], self.symbol[last[own[l]]], n[own[l]], low))
            dense = np.zeros(width**k, np.int32) if not k else np.tile(rows, width).astype(np.int32)
            dense[contexts] = count + np.arange(len(contexts))
            rows, count = dense, count + len(contexts)
        self.row = rows
        self.bits = np.empty((len(langs), count * width), np.uint16)
        for bits, table in zip(self.bits, tables):
            at = 0
            for part in table:
                cost = np.rint(-np.log2(np.maximum(part / weight, 1e-70)) * UNIT)
                bits[at : at + cost.size] = np.minimum(cost, 65535).astype(np.uint16).ravel()
                at += cost.size

    def _chances(self, contexts: int, where: np.ndarray, symbol: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Chances of all columns in each context of one language; ``low`` are those of the next shorter context."""
        counts = np.zeros((contexts, self.width))
        np.add.at(counts, (where, symbol), n)
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        rest = np.where(counts > 0, 0, low).sum(1, keepdims=True)
        escape = kinds / np.maximum(total + kinds, 1)
        p = np.where(counts > 0, counts / np.maximum(total + kinds, 1), escape * low / np.maximum(rest, 1e-300))
        return np.where(total > 0, p, low)

    def costs(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length of each text in bits, one column for each language."""
        out = np.zeros((len(bounds) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            return out
        text, at = padded(data, bounds)
        symbols = self.symbol[text]
        code = np.zeros(len(symbols), np.int32)
        for back in range(ORDER, 0, -1):
            code[ORDER:] = code[ORDER:] * self.width + symbols[ORDER - back : len(symbols) - back]
        cell = (self.row[code].astype(np.int64) * self.width + symbols)[at]
        for l, bits in enumerate(self.bits):
            out[full, l] = np.add.reduceat(bits[cell], bounds[full], dtype=np.int64) / UNIT
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> ContextTrees | None:
    """Trees for every language with labelled text, or None without any.

    What reaches the driver is the counts of at most ``sample`` documents for each language.
    """
    counts = count_grams(docs, sample).toPandas()
    langs = sorted(set(counts["lang"]))
    if not langs:
        return None
    at = {x: i for i, x in enumerate(langs)}
    trees = ContextTrees(langs, counts["lang"].map(at).to_numpy(np.int64), counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))
    del counts
    release()
    return trees


def has_letter(texts: pa.Array) -> np.ndarray:
    data, bounds = utf8(texts)
    fold = data | 32
    ascii_letters = np.concatenate([[0], np.cumsum((fold >= 97) & (fold <= 122))])
    out = np.diff(ascii_letters[bounds]) > 0
    for i in np.flatnonzero(~out & (np.diff(bounds) > 0)):
        out[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return out


def predict(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """All rows and columns of ``docs`` plus ``lang_pred`` and ``score``.

    ``score`` is the chance of the language given the code lengths, all languages alike before. Null
    text, text without a letter, and any text if nothing was learned, is ``und`` with score 0; equal
    code lengths go to the smaller name.
    """
    held = docs.sparkSession.sparkContext.broadcast(trees)
    schema = docs.drop("lang_pred", "score").schema.add("lang_pred", "string").add("score", "double")

    def rows(batches):
        model = held.value
        for batch in steps(batches, "text", STEP):
            texts = batch.column("text")
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model is not None:
                ok = has_letter(texts)
                costs = model.costs(*utf8(texts))
                best = costs.argmin(1)
                chance = 1 / np.exp2(-np.minimum(costs - costs.min(1, keepdims=True), 1000)).sum(1)
                lang[ok], score[ok] = np.array(model.langs, object)[best[ok]], chance[ok]
            columns = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return docs.drop("lang_pred", "score").mapInArrow(lean(rows), schema)
