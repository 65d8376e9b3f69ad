"""Mix sources to target weights by Pareto order sampling.

Each source gets a target number of words.  A document is expected
``target / source size`` times in the mix: the whole part of that is taken for certain,
the rest is an inclusion probability ``p``.  Documents are ranked by random odds over
inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and taken in this order while
they fit the words the source still lacks.

All steps are DataFrame operations.  The order inside a source, which may hold any share of
the rows, is found without sorting it in one task: the ranks fall into bins, bins are summed
where the rows lie, and only the bin in which the sum crosses the limit is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bins of a source's rank order.
BINS = 4096
#: A document comes at most this many times.
MOST = 3
#: Passes that fill what the last document in order left open.
FILLS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1), from the first 52 bits of an MD5: the same in every run and engine."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_weights(sources: DataFrame) -> DataFrame:
    """``source, source_size`` with ``weight`` 1, 2, 3, 1, ... by code point, null last.

    The rows are range-sorted; a row's number is its place in its partition plus the rows of the
    partitions before, so no task holds all sources.
    """
    ordered = stored(
        sources.orderBy(F.col("source").isNull(), F.col("source")).withColumn("at", F.monotonically_increasing_id()),
        "sources",
    )
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(part.alias("part"))
        .agg(F.count("*").alias("rows"))
        .withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    )
    number = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("part", part).join(offsets, "part").select("source", "source_size", (number % 3 + 1).alias("weight"))


def water_fill(sources: DataFrame) -> DataFrame:
    """Add ``target``: shares of the whole by weight, none above ``MOST`` times its source.

    What the stopped sources leave goes to the others by weight until none is above; every
    round is one aggregate over the sources.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    cap = MOST * F.col("source_size")
    share, stopped = (total or 0) / (weights or 1), -1
    while True:
        above = cap < F.lit(share) * F.col("weight")
        count, held, rest = sources.agg(
            F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if count == stopped or not rest:
            return sources.withColumn("target", F.least(cap.cast("double"), F.lit(share) * F.col("weight")))
        share, stopped = (total - (held or 0)) / rest, count


def _fill(rows: DataFrame, lacking: DataFrame, last: bool) -> DataFrame:
    """Mark (``hit``) the documents that the next words of their source go to, in rank order.

    rows: ``source, row, size, rank``; lacking: ``source, lack``.  Documents larger than what
    lacks are passed over.  With ``last`` the one that crosses the limit is taken if that ends nearer to it.
    """
    fits = rows.join(lacking, F.col("source").eqNullSafe(F.col("for_source")))
    if not last:
        fits = fits.where(F.col("size") <= F.col("lack"))
    fits = fits.withColumn("bin", F.floor(F.col("rank") * BINS))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        fits.groupBy("source", "bin")
        .agg(F.sum("size").alias("words"), F.first("lack").alias("lack"))
        .withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .where("before < lack")
        .select(F.col("source").alias("b_source"), F.col("bin").alias("b_bin"), "words", "before")
    )
    binned = fits.join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
    whole = F.col("before") + F.col("words") <= F.col("lack")
    inside = Window.partitionBy("source", "bin").orderBy("rank", "row").rowsBetween(Window.unboundedPreceding, 0)
    crossing = binned.where(~whole).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    ok = F.col("upto") <= F.col("lack")
    if last:
        ok = ok | (F.col("upto") - F.col("lack") < F.col("lack") - (F.col("upto") - F.col("size")))
    columns = ["row", "source", "size"]
    return binned.where(whole).select(*columns).unionByName(crossing.where(ok).select(*columns))


def pareto_mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, row, size, source, source_size, target, copies, taken`` for each row of ``docs(doc_id, text, source)``.

    Null text has size 0; null ``source`` is a source of its own; rows of one ``doc_id`` are drawn
    one by one (``row`` numbers equal rows); an empty table gives no rows.  Documents without words are never
    taken.  A source ends within half a document of its target, the document that
    crosses it last.
    """
    text = F.col("text")
    base = docs.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64("doc_id", "text", "source").alias("content"))
    same = Window.partitionBy("doc_id", "content").orderBy("size")
    base = base.withColumn("nth", F.row_number().over(same))
    base = stored(
        base.select(
            "doc_id", "source", "size",
            F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "content", "nth").alias("row"),
            F.when(F.col("nth") == 1, uniform(seed, F.col("doc_id")))
            .otherwise(uniform(seed, F.col("doc_id"), F.col("nth"))).alias("u"),
        ),
        "mix",
    )
    targets = stored(
        water_fill(source_weights(base.groupBy("source").agg(F.sum("size").alias("source_size")))), "targets"
    ).withColumnRenamed("source", "for_source")
    rows = base.join(targets, F.col("source").eqNullSafe(F.col("for_source"))).drop("for_source", "weight")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    p = F.col("p")
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    ranked = (
        rows.withColumn("sure", F.floor(ratio))
        .withColumn("p", ratio - F.floor(ratio))
        .where((p > 0) & (F.col("size") > 0))
        .select("source", "row", "size", (odds / (1 + odds)).alias("rank"))
    )
    lacking = targets.select(
        "for_source", (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("lack")
    ).where("lack > 0")
    taken = None
    for fill in range(FILLS):
        hits = stored(_fill(ranked, lacking, fill == FILLS - 1), "hits")
        got = hits.groupBy("source").agg(F.sum("size").alias("got"))
        lacking = (
            lacking.join(got, F.col("for_source").eqNullSafe(F.col("source")), "left")
            .select("for_source", (F.col("lack") - F.coalesce(F.col("got"), F.lit(0))).alias("lack"))
            .where("lack > 0")
        )
        ranked = ranked.join(hits.select("row"), "row", "left_anti")
        taken = hits if taken is None else taken.unionByName(hits)
    chosen = taken.select("row", F.lit(1).alias("hit"))
    copies = F.floor(ratio) + F.coalesce(F.col("hit"), F.lit(0))
    return (
        rows.join(chosen, "row", "left")
        .withColumn("copies", copies.cast("int"))
        .select("doc_id", "row", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )
