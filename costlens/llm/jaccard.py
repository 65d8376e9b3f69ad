"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles.  Equal sets are one class, so copies never meet in pairs.

1. *Routing.*  Two sets can only reach the similarity if they share one of their
   ``n - ceil(s n) + 1`` first shingles in an order common to all sets.  The order puts shingles first
   that no other set has, so a set that merely shares a passage has no common first shingle.
   Counts are needed for a sample of the shingles only, as long as it holds the first ones.  Sets that share a first shingle, directly or through others, form a
   candidate group; sets in different groups cannot be linked.  Only (shingle, set) pairs are
   shuffled.
2. *Search.*  Each set travels once to its group.  There DivideSkip finds the partners of a set: of its
   inverted lists the ``L`` longest are put aside, the short ones are merged, sets
   that occur at least ``T - L`` times are looked up in the long lists by binary search, and those that reach the
   overlap their sizes ask for are links.  A set found once is taken out of the lists, so a
   group of near copies costs one search for each member over ever fewer sets.
3. Groups above ``BLOCK`` sets are dealt out as pairs of blocks, so that no task
   holds a whole hot group; the links of all tasks give the classes.
4. Components need a spanning forest of the links only (``join``).  ``link_counts`` and ``pairs`` search each set against all others of
   its group, every pair in one task; counts are summed in the tasks, so only ``pairs`` has a row for each link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, mix, steps, stored, tasks, utf8, word_hashes, words
from .components import components

SIZE = 5
#: Similarity as a fraction.
SIMILARITY = (80, 100)
#: Share of all shingles that are counted.  A set with less than ``1 - (1 - s) / SAMPLED`` of its shingles in
#: others is no candidate; the result does not depend on it.
SAMPLED = 1 / 3
#: Sets of a group, and shingles in them, that one task holds on average (two blocks when a group is split).
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: DivideSkip's weight of a long list against a short one.
SKIP = 0.5

_ORDER = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and the bounds of each.

    A-Z count as a-z; a text of fewer words is one shingle, a text without words has none.
    """
    data, bounds = utf8(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, doc = words(data, bounds)
    value = word_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    here = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), here)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(here) - here, here)
    width = np.minimum(count, size)[owner]
    hashed = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = k < width
        hashed[inside] = mix(hashed[inside] * np.uint64(0x9E3779B97F4A7C15) + value[at[inside] + k])
    hashed = hashed.view(np.int64)
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    owner, hashed = owner[fresh], hashed[fresh]
    return hashed, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def set_keys(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each set; 0 for the empty one."""
    out = np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(hashed.view(np.uint64) ^ _ORDER), bounds[full]) + np.diff(bounds)[full].astype(np.uint64)).view(np.int64)
        out[full[out[full] == 0]] = 1
    return out


def needed(a, b, similarity=SIMILARITY):
    """Least overlap of sets of ``a`` and ``b`` members: ``d * o >= n * (a + b - o)``."""
    n, d = similarity
    return -(-n * (a + b) // (n + d))


def keyed(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_shingles, key`` for each row."""

    def rows(batches):
        for batch in steps(batches, "text"):
            hashed, bounds = shingles(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(set_keys(hashed, bounds))], ["doc_id", "n_shingles", "key"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(rows), "doc_id long, n_shingles long, key long")


def postings(docs: DataFrame, size: int = SIZE, similarity=SIMILARITY) -> DataFrame:
    """``shingle, key, room``: the sampled shingles of each set, and how many more these are than its first shingles.

    A shingle is sampled by its own hash, so all sets sample alike; a set with too few goes on
    in the order of the hashes until it has as many as it needs.
    """
    n_, d_ = similarity
    limit = np.uint64(int(SAMPLED * float(1 << 64)))

    def rows(batches):
        for part in steps(batches, "text"):
            hashed, bounds = shingles(part.column("text"), size)
            keys = set_keys(hashed, bounds)
            distinct = np.zeros(len(keys), bool)
            distinct[np.unique(keys, return_index=True)[1]] = True
            owner = np.repeat(np.arange(len(keys)), np.diff(bounds))
            keep = distinct[owner]
            owner, hashed = owner[keep], hashed[keep]
            rank = mix(hashed.view(np.uint64) ^ _ORDER)
            order = np.lexsort((rank, owner))
            owner, hashed, rank = owner[order], hashed[order], rank[order]
            count = np.bincount(owner, minlength=len(keys))
            first = count - -(-count * n_ // d_) + 1
            taken = np.maximum(np.bincount(owner[rank < limit], minlength=len(keys)), np.minimum(first, count))
            some = np.arange(len(owner)) - (np.cumsum(count) - count)[owner] < taken[owner]
            owner = owner[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed[some]), pa.array(keys[owner]), pa.array((taken - first)[owner].astype(np.int32))],
                ["shingle", "key", "room"],
            )

    return docs.select("text").mapInArrow(lean(rows), "shingle long, key long, room int")


def candidates(docs: DataFrame, size: int = SIZE, similarity=SIMILARITY) -> DataFrame:
    """``a, b``: sets that share a first shingle, each tied to the smallest such set.

    The common order: sampled shingles that one set alone has, then sampled shingles by how often they
    were counted, then all others by hash.  A set's own shingles come back only where others
    have them too; those it did not get back come first.
    """
    one = Window.partitionBy("shingle")
    shared = (
        postings(docs, size, similarity)
        .withColumns({"n": F.count("*").over(one), "low": F.min("key").over(one), "high": F.max("key").over(one)})
        .where("low < high")
    )
    first = (
        shared.groupBy("key")
        .agg(F.array_sort(F.collect_set(F.struct("n", "shingle"))).alias("own"), F.max("room").alias("room"))
        .where(F.size("own") > F.col("room"))
        .select("key", F.explode(F.slice("own", F.lit(1), F.size("own") - F.col("room"))).alias("one"))
        .select("key", F.col("one.shingle").alias("shingle"))
    )
    return (
        first.withColumn("low", F.min("key").over(one))
        .where("key <> low")
        .select(F.col("low").alias("a"), F.col("key").alias("b"))
        .distinct()
    )


class Lists:
    """Inverted lists of a block of sets, for DivideSkip searches."""

    def __init__(self, sets: list[np.ndarray], similarity=SIMILARITY):
        self.similarity = similarity
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, token = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")
        self.lists = owner[order]
        self.ends = np.cumsum(np.bincount(token, minlength=len(values)))
        self.begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.tokens = np.split(token, np.cumsum(self.sizes)[:-1]) if sets else []
        self.alive = np.ones(len(sets), bool)
        self.gone = 0

    def take_out(self, some: np.ndarray) -> None:
        """Sets that are no longer searched for; the lists shrink when half of them are gone."""
        self.alive[some] = False
        self.gone += len(some)
        if 2 * self.gone > self.alive.sum() + self.gone:
            keep = self.alive[self.lists]
            kept = np.concatenate([[0], np.cumsum(keep)])
            self.begins, self.ends = kept[self.begins], kept[self.ends]
            self.lists = self.lists[keep]
            self.gone = 0

    def partners(self, at: int) -> np.ndarray:
        """The remaining sets similar enough to set ``at``."""
        n, d = self.similarity
        size, tokens = int(self.sizes[at]), self.tokens[at]
        least = -(-n * size // d)  # T for the smallest partner that can reach it
        length = self.ends[tokens] - self.begins[tokens]
        tokens = tokens[np.argsort(length, kind="stable")]
        length = np.sort(length)
        long_ones = min(least - 1, int(least / (SKIP * np.log2(max(int(length[-1]), 2)) + 1)))
        cut = len(tokens) - long_ones
        short = tokens[:cut]
        begins, n_each = self.begins[short], length[:cut]
        merged = self.lists[np.repeat(begins - (np.cumsum(n_each) - n_each), n_each) + np.arange(n_each.sum())]
        seen = np.bincount(merged, minlength=len(self.sizes))  # the merge of the short lists
        found = np.flatnonzero((seen >= max(1, least - long_ones)) & self.alive)
        found = found[found != at]
        seen = seen[found]
        need = needed(size, self.sizes[found], self.similarity)
        for i, token in enumerate(tokens[cut:]):
            if not len(found):
                break
            run = self.lists[self.begins[token] : self.ends[token]]
            place = np.searchsorted(run, found)
            seen = seen + (run[np.minimum(place, len(run) - 1)] == found if len(run) else 0)
            keep = seen + (long_ones - i - 1) >= need
            found, seen, need = found[keep], seen[keep], need[keep]
        return found[seen >= need]


def linked(sets: list[np.ndarray], side: np.ndarray | None = None, similarity=SIMILARITY) -> Iterator[tuple[int, int]]:
    """Links that connect all sets of a block which links connect (a spanning forest of them)."""
    lists = Lists(sets, similarity)
    for root in range(len(sets)):
        if not lists.alive[root]:
            continue
        lists.take_out(np.array([root]))
        queue = [root]
        while queue:
            at = queue.pop()
            new = lists.partners(at)
            lists.take_out(new)
            for other in new.tolist():
                yield at, other
                queue.append(other)


def every_link(sets: list[np.ndarray], side: np.ndarray | None = None, similarity=SIMILARITY) -> Iterator[tuple[int, np.ndarray]]:
    """All links of a block, each once, as a set and its partners; with ``side`` only those between the two sides."""
    lists = Lists(sets, similarity)
    roots = np.arange(len(sets)) if side is None else np.flatnonzero(~side)
    if side is not None:
        lists.take_out(roots)
    for root in roots.tolist():
        if side is None:
            lists.take_out(np.array([root]))
        yield root, lists.partners(root)


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Group, documents, sets, sides and weights of each group with more than one set."""
    at, held = None, []
    for batch in batches:
        for group, doc, raw, side, weight in zip(*(batch.column(c).to_pylist() for c in ("group", "doc", "shingles", "side", "weight"))):
            if group != at:
                if len(held) > 1:
                    yield at, *map(list, zip(*held))
                at, held = group, []
            held.append((doc, np.frombuffer(raw, np.int64), side, weight))
    if len(held) > 1:
        yield at, *map(list, zip(*held))


def links(sets: DataFrame, similarity=SIMILARITY) -> DataFrame:
    """``a, b``: a spanning forest over ``sets(group, doc, shingles, side, weight)``, the rows of a group in one partition."""

    def rows(batches):
        for _, docs, members, _, _ in _blocks(batches):
            some = [(docs[a], docs[b]) for a, b in linked(members, similarity=similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], pa.int64()) for k in (0, 1)], ["a", "b"])

    return sets.mapInArrow(lean(rows), "a long, b long")


def all_links(sets: DataFrame, similarity=SIMILARITY, counted: bool = False) -> DataFrame:
    """``a, b`` for each link, or ``doc, linked``: the weights a block links each of its sets with."""

    def rows(batches):
        for group, docs, members, side, weight in _blocks(batches):
            docs, weight = np.array(docs, np.int64), np.array(weight, np.int64)
            first, second = group.rsplit("/", 2)[1:]
            found = every_link(members, None if first == second else np.array(side, bool), similarity)
            if not counted:
                for at, others in found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), docs[at])), pa.array(docs[others])], ["a", "b"])
                continue
            total = np.zeros(len(docs), np.int64)
            for at, others in found:
                total[at] += weight[others].sum()
                total[others] += weight[at]
            some = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(docs[some]), pa.array(total[some])], ["doc", "linked"])

    return sets.mapInArrow(lean(rows), "doc long, linked long" if counted else "a long, b long")


def _prepared(docs: DataFrame, size: int, similarity, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the key of their set, classes of equal sets, and the sets dealt out to their groups."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(keyed(docs, size), "keys")
    classes = rows.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"), F.count_distinct("doc_id").alias("weight")
    )

    groups = stored(components(stored(candidates(docs, size, similarity), "candidates")).join(classes, F.col("node") == F.col("key")).select("component", "doc", "n", "weight"), "groups")
    large = (
        groups.groupBy("component")
        .agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        .where("blocks > 1")
    )
    # block i of a large group goes to the pairs (i, j) and (j, i); other groups are one block
    mine = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.concat_ws("/", "component", F.least(F.col("mine"), other), F.greatest(F.col("mine"), other)).alias("group"),
            (F.col("mine") > other).alias("side"),
        ),
    )
    dealt = (
        groups.join(large, "component", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("mine", mine)
        .select("doc", "weight", F.explode(pair).alias("group"))
    )
    placed = dealt.groupBy("doc").agg(F.collect_list("group").alias("groups"), F.first("weight").alias("weight"))
    # the same plan at every size: the candidates grow with the documents
    chosen = docs.join(placed.hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).select("doc", "groups", "weight", "text")

    def sets(batches):
        for batch in steps(batches, "text"):
            hashed, bounds = shingles(batch.column("text"), size)
            raw, into = hashed.tobytes(), batch.column("groups").to_pylist()
            at = np.repeat(np.arange(len(into)), [len(g) for g in into])
            yield pa.RecordBatch.from_arrays(
                [pa.array([g["group"] for own in into for g in own], pa.string()), batch.column("doc").take(pa.array(at)),
                 pa.array([raw[8 * bounds[i] : 8 * bounds[i + 1]] for i in at], pa.binary()),
                 pa.array([g["side"] for own in into for g in own], pa.bool_()), batch.column("weight").take(pa.array(at))],
                ["group", "doc", "shingles", "side", "weight"],
            )

    grouped = (
        chosen.mapInArrow(lean(sets), "group string, doc long, shingles binary, side boolean, weight long")
        .repartition(tasks(docs), "group")
        .sortWithinPartitions("group", "doc")
    )
    return rows, classes, grouped


def join(docs: DataFrame, size: int = SIZE, similarity=SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)`` with an id.

    ``component_id`` is the smallest id that links reach.  Null text and text without words has
    no shingles and is linked with nothing; equal texts are linked, also rows that
    repeat an id.  Rows without an id take no part; an empty table gives no rows.
    """
    rows, classes, grouped = _prepared(docs, size, similarity, block)
    found = components(stored(links(grouped, similarity), "links"))
    # classes, then their components, back to the rows by key
    named = classes.join(found, F.col("doc") == F.col("node"), "left").select("key", F.coalesce("component", "doc").alias("component_id"))
    return rows.join(named, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def pairs(docs: DataFrame, size: int = SIZE, similarity=SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``a, b``, ``a < b``: each link between two different sets once, a set named by its smallest id.

    A group of near copies has a row for each two of them.
    """
    found = all_links(_prepared(docs, size, similarity, block)[2], similarity)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def link_counts(docs: DataFrame, size: int = SIZE, similarity=SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, class_id, n_links`` for each row of ``docs(doc_id, text)`` with an id.

    ``class_id`` is the smallest id with an equal set, ``n_links`` the number of other ids whose set is equal
    or similar enough: all of them, not the forest that ``join`` needs.
    Text without words is linked with nothing and its own class.
    """
    rows, classes, grouped = _prepared(docs, size, similarity, block)
    found = all_links(grouped, similarity, counted=True).groupBy("doc").agg(F.sum("linked").alias("linked"))
    named = classes.join(found, "doc", "left").select(
        "key", F.col("doc").alias("class_id"), (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    return rows.join(named, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
