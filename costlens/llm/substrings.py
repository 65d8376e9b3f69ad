"""Exact removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a ``LENGTH``-byte string over it also starts earlier in the corpus.

1. *Anchors.*  Each ``LENGTH``-byte string picks one position, its first smallest ``GRAM``-byte hash.  The
   choice depends on the string alone, so equal strings pick the same place, and only one
   position in some forty bytes is picked.  A picked position stands for the
   neighbouring strings that pick it; together these cover its *region*.
2. *Regions.*  Picked positions with equal hash meet.  A region that starts earlier elsewhere in full
   goes at once.  Regions that differ around an equal anchor are compared byte for byte:
3. *Suffix sort.*  The text after and (reversed) before the anchors is sorted by mergesort; two suffixes are
   compared by the length of their common prefix, found by binary search over prefix
   polynomial hashes.  Neighbours' common prefixes give, for every string of a region, the class of equal strings, of
   which only the earliest stays.  All common prefixes are checked against
   the bytes; if a hash misled the sort, the batch is sorted by bytes.
4. *Hot anchors.*  Above ``HOT`` rows of one gram its regions are dealt out string by string, by the hashes of gram and
   string, so only equal strings meet, and of those each step of a task sends one.

Whole copies of a text are settled by a digest before any of this, and text is shuffled
once, by document, for all steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, BYTE_VALUES, mix, powers, steps, stored, tasks, utf8

LENGTH = 100
GRAM = 28
STEP = 2 << 20
#: Regions that are sorted together, at least (always whole groups).
SORTED = 20000
#: Rows of one gram that are sorted in one task, at most.
HOT = 2048
_SPAN = LENGTH - GRAM + 1  # positions a string chooses from
_PLACE = np.uint64((1 << 24) - 1)
_INVERSE = pow(BASE, -1, 1 << 64)


class PrefixHashes:
    """Polynomial hashes of all stretches of a byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data))[: len(data)], out=self.sums[1:])
        self.back = powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` values."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray):
    """Text, place, first and last string start, hash and region hash of each anchor."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    hashes = PrefixHashes(data)
    at = np.arange(n - GRAM + 1)
    grams = mix(hashes.of(at, at + GRAM))
    chosen = (_smallest((grams & ~_PLACE) | at.astype(np.uint64), _SPAN) & _PLACE).astype(np.int64)
    start = np.arange(len(chosen))
    doc = np.searchsorted(bounds, start, "right") - 1
    valid = start + LENGTH <= bounds[doc + 1]
    start, doc, chosen = start[valid], doc[valid], chosen[valid]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    place, begin, end, doc = chosen[first], start[first], start[last], doc[first]
    region = mix(hashes.of(begin, end + LENGTH) + mix((end - begin).astype(np.uint64) << np.uint64(8) | (place - begin).astype(np.uint64)))
    return doc, place - bounds[doc], begin - bounds[doc], end - bounds[doc], grams[place].view(np.int64), region.view(np.int64)


def _packed(at: np.ndarray, back: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Place of an anchor, bytes from the first string's start to it, and further string starts, in one number."""
    return at << 16 | back << 8 | more


def _unpacked(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spot >> 16, spot >> 8 & 255, spot & 255


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document with those that touch made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    # all regions of a document end in the order in which they start
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first) if len(first) else end


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gram, region, doc, spot`` of each anchor.

    Of equal regions within a step the first is handed on; the others are settled here, and go on as the
    spans they cover: end, no region, document, start.
    """
    names = ["gram", "region", "doc", "spot"]
    for batch in steps(batches, "text", STEP):
        data, bounds = utf8(batch.column("text"))
        ids = batch.column("doc_id").to_numpy()
        # a text too long for one step is taken in stretches that overlap by one string
        pieces = [(data, bounds, ids, 0)]
        if len(data) > 2 * STEP:
            pieces = [
                (part, np.array([0, len(part)]), ids[i : i + 1], a)
                for i in range(len(ids))
                for a in range(0, max(1, int(bounds[i + 1] - bounds[i]) - LENGTH + 1), STEP)
                for part in [data[bounds[i] + a : min(bounds[i + 1], bounds[i] + a + STEP + LENGTH - 1)]]
            ]
        for part, cuts, own, base in pieces:
            doc, place, begin, end, gram, region = anchors(part, cuts)
            doc, place, begin, end = own[doc], place + base, begin + base, end + base + LENGTH
            order = np.lexsort((place, doc, region, gram))
            doc, place, begin, end, gram, region = (x[order] for x in (doc, place, begin, end, gram, region))
            head = np.ones(len(doc), bool)
            head[1:] = (gram[1:] != gram[:-1]) | (region[1:] != region[:-1])
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = (doc != doc[lead]) | (place != place[lead])  # rows that repeat an id are not later
            gone, start, stop = _joined(doc[later], begin[later], end[later])
            keep = ~later
            spot = _packed(place, place - begin, end - LENGTH - begin)[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([gram[keep], stop]), pa.int64()),
                    pa.array(np.concatenate([region[keep], np.zeros(len(gone), np.int64)]), pa.int64(), mask=np.arange(keep.sum() + len(gone)) >= keep.sum()),
                    pa.array(np.concatenate([doc[keep], gone]), pa.int64()),
                    pa.array(np.concatenate([spot, start]), pa.int64()),
                ],
                names,
            )


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the regions that have to be compared, and the strings of hot regions.

    Of equal strings within a step the first is handed on: gram, document, start, string hash; the others are settled here, and go
    on as the spans they cover: no gram, document, start, end.
    """
    names = ["gram", "doc", "spot", "string", "bytes"]
    for batch in steps(batches, "text"):
        data, bounds = utf8(batch.column("text"))
        wanted = batch.column("wanted")
        n = wanted.value_lengths().to_numpy(zero_copy_only=False)
        flat = wanted.flatten()
        gram, spot, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("gram", "spot", "hot"))
        hot = hot.astype(bool)
        doc, first = np.repeat(batch.column("doc_id").to_numpy(), n), np.repeat(bounds[:-1], n)
        at, back, more = _unpacked(spot)
        begin = first + at - back
        end = np.minimum(begin + more + LENGTH, np.repeat(bounds[1:], n))
        raw = data.tobytes()
        cool = ~hot
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram[cool]), pa.array(doc[cool]), pa.array(spot[cool]), pa.nulls(int(cool.sum()), pa.int64()),
             pa.array([raw[a:b] for a, b in zip(begin[cool].tolist(), end[cool].tolist())], pa.binary())],
            names,
        )
        if not hot.any():
            continue
        each = more[hot] + 1
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        place = np.repeat(begin[hot], each) + step
        gram, doc, start = (np.repeat(x[hot], each) for x in (gram, doc, begin - first))
        start = start + step
        string = mix(PrefixHashes(data).of(place, place + LENGTH)).view(np.int64)
        order = np.lexsort((start, doc, string, gram))
        gram, doc, start, string = (x[order] for x in (gram, doc, start, string))
        later = _later(gram, string, doc, start, None)[0]
        keep, (gone, low, high) = ~later, _joined(doc[later], start[later], start[later] + LENGTH)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([gram[keep], np.zeros(len(gone), np.int64)]), pa.int64(), mask=np.arange(keep.sum() + len(gone)) >= keep.sum()),
             *(pa.array(np.concatenate(x)) for x in ([doc[keep], gone], [start[keep], low], [string[keep], high])),
             pa.nulls(int(keep.sum()) + len(gone), pa.binary())],
            names,
        )


def _later(gram, string, doc, start, before):
    """Which of the sorted strings are not the first of equal ones; ``before``: key and place of the first of the group that goes on."""
    head = np.ones(len(gram), bool)
    head[1:] = (gram[1:] != gram[:-1]) | (string[1:] != string[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    lead_doc, lead_start = doc[lead], start[lead]
    if before is not None and (gram[0], string[0]) == before[:2]:
        lead_doc[lead == 0], lead_start[lead == 0] = before[2:]
    # rows that repeat an id are not later
    return (doc != lead_doc) | (start != lead_start), (gram[-1], string[-1], lead_doc[-1], lead_start[-1])


def suffix_sort(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes within their groups; rows come group by group.

    Mergesort from single rows up; the runs of all groups are merged side by side.  A suffix finds its place in the other run by
    binary search, and each comparison finds the common prefix by binary search over prefix hashes.
    """
    hashes = PrefixHashes(data)

    def before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(length[a], length[b])
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = hashes.of(start[a], start[a] + middle) == hashes.of(start[b], start[b] + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        ended = low >= most
        place = np.minimum(low, most - 1).clip(0)
        by_byte = data[np.minimum(start[a] + place, len(data) - 1)] < data[np.minimum(start[b] + place, len(data) - 1)]
        return np.where(ended, (length[a] < length[b]) | ((length[a] == length[b]) & (a < b)), by_byte)

    n = len(start)
    order = np.arange(n)
    if not n:
        return order
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([head, [n]]))
    first, total = np.repeat(head, size), np.repeat(size, size)
    inside = np.arange(n) - first
    run = 1
    while run < size.max():
        mine = inside // (2 * run) * (2 * run)  # start of the pair of runs
        left = inside - mine < run
        other = np.where(left, mine + run, mine)
        other_end = np.minimum(np.where(left, mine + 2 * run, mine + run), total)
        some = np.flatnonzero(other < total)
        low, high = other[some].copy(), other_end[some].copy()
        origin = other[some]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            rows = some[open_]
            other_first = before(order[first[rows] + middle], order[rows])
            low[open_] = np.where(other_first, middle + 1, low[open_])
            high[open_] = np.where(other_first, high[open_], middle)
        target = np.arange(n)
        own = inside[some] - np.where(left[some], mine[some], mine[some] + run)
        target[some] = first[some] + mine[some] + own + (low - origin)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        run *= 2
    return order


def _classes(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order within groups, and the common prefix of each row with the row before it (-1 across groups)."""
    length = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum(length) - length
    order = suffix_sort(data, start, length, group)
    width = int(length.max(initial=0)) or 1
    column = np.arange(width)

    def neighbours(order):
        a, b = order[:-1], order[1:]
        common = np.full(len(order), -1, np.int64)
        sorted_ = True
        for c in range(0, len(a), 8192):
            x, y = a[c : c + 8192], b[c : c + 8192]
            most = np.minimum(length[x], length[y])
            differ = data[np.minimum(start[x][:, None] + column, len(data) - 1)] != data[np.minimum(start[y][:, None] + column, len(data) - 1)]
            differ |= column >= most[:, None]
            lcp = np.where(differ.any(1), differ.argmax(1), width)
            same = group[x] == group[y]
            at = np.minimum(lcp, most - 1).clip(0)
            ordered = np.where(
                lcp >= most, length[x] <= length[y],
                data[np.minimum(start[x] + at, len(data) - 1)] < data[np.minimum(start[y] + at, len(data) - 1)],
            )
            sorted_ &= bool((ordered | ~same).all())
            common[c + 1 : c + 1 + len(x)] = np.where(same, lcp, -1)
        return common, sorted_

    if not len(data):
        return order, np.full(len(order), -1, np.int64)
    common, sorted_ = neighbours(order)
    if not sorted_:  # two different stretches shared a hash
        order = np.array(sorted(range(len(texts)), key=lambda i: (group[i], texts[i])), np.int64)
        common, _ = neighbours(order)
    return order, common


def repeated_spans(group, doc, at, back, more, texts):
    """Document, start and end of the stretches of repeated strings; rows by group, document and place."""
    n = len(group)
    ahead, ahead_common = _classes([t[b:] for t, b in zip(texts, back.tolist())], group)
    behind, behind_common = _classes([t[:b][::-1] for t, b in zip(texts, back.tolist())], group)
    low = back - more  # a row has the strings that start back-more .. back bytes before the anchor
    seen = np.zeros((n, _SPAN + 1), bool)
    for t in range(int(low.min()), int(back.max()) + 1):
        rows = np.flatnonzero((low <= t) & (t <= back))
        if len(rows) < 2:
            continue
        one, two = np.empty(n, np.int64), np.empty(n, np.int64)
        one[ahead] = np.cumsum(ahead_common < LENGTH - t)
        two[behind] = np.cumsum(behind_common < t)
        key = one[rows] * (n + 1) + two[rows]
        _, earliest = np.unique(key, return_index=True)
        again = np.ones(len(rows), bool)
        again[earliest] = False
        seen[rows[again], t] = True
    edge = np.diff(np.pad(seen, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return doc[row], at[row] - (last - 1), at[row] - first + LENGTH


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, before = [], 0, None

    def work(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(x).to_numpy() for x in ("gram", "doc", "spot")]
        fresh = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        gram, doc, spot = (k[fresh] for k in keys)  # rows that repeat an id come once
        texts = table.column("bytes").filter(pa.array(fresh)).to_pylist()
        out = repeated_spans(gram, doc, *_unpacked(spot), texts)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc", "start", "end"])

    for mixed in batches:
        if not mixed.num_rows:
            continue
        strings = mixed.filter(pc.is_valid(mixed.column("string")))
        if strings.num_rows:
            known = strings.filter(pc.is_null(strings.column("gram")))
            gone = [known.column(c).to_numpy() for c in ("doc", "spot", "string")]
            strings = strings.filter(pc.is_valid(strings.column("gram")))
            if strings.num_rows:
                gram, string, doc, start = (strings.column(c).to_numpy() for c in ("gram", "string", "doc", "spot"))
                later, before = _later(gram, string, doc, start, before)
                gone = [np.concatenate(x) for x in zip(gone, (doc[later], start[later], start[later] + LENGTH))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _joined(*gone)], ["doc", "start", "end"])
        batch = mixed.filter(pc.is_null(mixed.column("string")))
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= SORTED:
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last group may go on
            if cut:
                yield work(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), len(gram) - cut
    if rows:
        yield work(pa.Table.from_batches(held))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        out = []
        columns = (batch.column(c).to_pylist() for c in ("copy", "spans"))
        data, bounds = utf8(batch.column("text"))
        for i, (copy, spans) in enumerate(zip(*columns)):
            raw = data[bounds[i] : bounds[i + 1]]
            if copy:
                merged = [(0, len(raw))] if len(raw) >= LENGTH else []
            else:
                merged = []
                for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1] = merged[-1][0], max(b, merged[-1][1])
                    else:
                        merged.append((a, b))
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(raw[at:a].tobytes())
                at = b
            digest.update(raw[at:].tobytes())
            out.append((len(raw), sum(b - a for a, b in merged), len(merged), digest.hexdigest()))
        n, removed, spans, sha = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs(doc_id, text)`` with an id.

    Null text counts as empty.  Rows without an id take no part; rows that repeat an id with the same
    text get the same result each.  Of several texts under one id the one with the smallest SHA-256 is the document; rows
    with another text lose nothing, and nothing is lost to them.  An empty table gives no rows.
    """
    parts = tasks(docs)
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2("text", 256)
    keyed = stored(docs.groupBy("doc_id").agg(F.min(digest).alias("own"), F.max(digest).alias("other")), "digests")
    originals = keyed.groupBy("own").agg(F.min("doc_id").alias("first")).select("first").distinct()
    several = keyed.where("own <> other").select(F.col("doc_id").alias("several_id"), "own")
    texts = docs.repartition(parts, "doc_id").join(several.hint("shuffle_hash"), F.col("doc_id") == F.col("several_id"), "left")
    texts = texts.select("doc_id", "text", F.when(F.col("own").isNotNull(), digest != F.col("own")).otherwise(False).alias("aside"))
    documents = texts.where("not aside").select("doc_id", "text")
    # an inner join on unique ids: a semi join would move below the exchange of the texts, which all steps share
    first = documents.join(originals.hint("shuffle_hash"), F.col("doc_id") == F.col("first")).select("doc_id", "text")
    found = first.mapInArrow(_anchor_rows, "gram long, region long, doc long, spot long")
    met = Window.partitionBy("gram")
    equal = Window.partitionBy("gram", "region").orderBy("doc", "spot")
    found = (
        found.withColumn("rows", F.count("*").over(met))
        .withColumn("low", F.min("region").over(met))
        .withColumn("high", F.max("region").over(met))
        .where("rows > 1 or region is null")
        .withColumn("nth", F.rank().over(equal))  # rows that repeat an id rank alike
        .where("region is null or nth > 1 or low <> high")
    )
    known = F.col("region").isNull()
    at, back, more = F.shiftright("spot", 16), F.shiftright("spot", 8).bitwiseAND(F.lit(255)), F.col("spot").bitwiseAND(F.lit(255))
    settled = found.where(known | (F.col("nth") > 1)).select(
        "doc",
        F.when(known, F.col("spot")).otherwise(at - back).alias("start"),
        F.when(known, F.col("gram")).otherwise(at - back + more + LENGTH).alias("end"),
    )
    wanted = found.where(~known & (F.col("nth") == 1)).groupBy("doc").agg(F.collect_set(F.struct("gram", "spot", (F.col("rows") > hot).alias("hot"))).alias("wanted"))
    regions = (
        documents.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("doc"))
        .select("doc_id", "text", "wanted")
        .mapInArrow(_context_rows, "gram long, doc long, spot long, string long, bytes binary")
        .repartition(parts, "gram", "string")
        .sortWithinPartitions("gram", "string", "doc", "spot")
    )
    compared = regions.mapInArrow(_sorted_rows, "doc long, start long, end long")
    spans = settled.unionByName(compared).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    copies = originals.select("first", F.lit(False).alias("copy"))
    return (
        texts.join(copies.hint("shuffle_hash"), F.col("doc_id") == F.col("first"), "left")
        .join(spans.hint("shuffle_hash"), F.col("doc_id") == F.col("doc"), "left")
        .select(
            "doc_id", "text", (~F.col("aside") & F.coalesce("copy", F.lit(True))).alias("copy"), F.when(~F.col("aside"), F.col("spans")).alias("spans")
        )
        .mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
