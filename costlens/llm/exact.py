"""Exact deduplication by progressive refinement: length, then a hash of the first characters, then a full hash.

Each level looks only at rows whose group at the level before holds at least two.  Which groups
those are travels as a bitmap of bounded size, so a text is never moved: the first scan writes
length and prefix hash (some 12 bytes a row), the second hashes the whole text of the rows still open.
Two groups that share a bit only cost a hash more; the full hash decides.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.session import drop_table, scratch_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that the second level hashes.
PREFIX = 256
#: Bits for each repeated group, and bounds of the bitmap (8 MB at most; beyond, more rows are hashed).
SPREAD, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 26
#: A group with more than this share of all rows is hot; there are at most ``1 / HOT`` of them.
HOT = 1 / 1000


def normal(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _marks(groups: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """A bitmap with the bit of each group set, in rows of 4 KB: ``bucket, bits``, and its size in bits."""
    size = LEAST_BITS
    wanted = min(MOST_BITS, SPREAD * groups.count())
    while size < wanted:
        size *= 2
    slot = _slot(keys, size)
    marks = groups.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    return marks, size


def _slot(keys: list[str], size: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(size)) + 1


def _with_open(rows: DataFrame, keys: list[str], marks: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``open``: whether the bit of the row's group is set."""
    slot = _slot(keys, size)
    at = F.bitmap_bit_position(slot)
    byte = F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))
    set_ = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    met = rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(marks), "bucket", "left")
    return met.withColumn("open", F.coalesce(set_, F.lit(False))).drop("bucket", "bits")


def dedup(docs: DataFrame, *, digests: bool = False) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row of ``docs(doc_id, text)``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts the row
    with the largest id stays, of rows that repeat that id exactly one; a null id is below all others.
    ``text_sha256`` is null where length or prefix already told a text apart, unless ``digests``.
    """
    spark = docs.sparkSession
    paths: list[str] = []

    def stored(frame: DataFrame, label: str) -> DataFrame:
        paths.append(scratch_table(spark, label))
        frame.write.parquet(paths[-1])
        return spark.read.schema(frame.schema).parquet(paths[-1])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumns({"length": F.octet_length("text"), "prefix": F.xxhash64(normal(F.substring("text", 1, PREFIX)))})

    # level 1: lengths that several rows have
    narrow = stored(keyed.select("length", "prefix"), "lengths")
    lengths = stored(narrow.groupBy("length").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "level1")
    # level 2: of these, prefixes that several rows have
    still = _with_open(narrow, ["length"], *_marks(lengths, ["length"])).where("open")
    prefixes = stored(still.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "level2")
    # level 3: whole texts of these
    last = _with_open(keyed, ["length", "prefix"], *_marks(prefixes, ["length", "prefix"]))
    whole = F.sha2(normal(F.col("text")).cast("binary"), 256)
    last = last.select(
        "doc_id", "open", (whole if digests else F.when(F.col("open"), whole)).alias("text_sha256"), F.monotonically_increasing_id().alias("row")
    )
    early, paths = paths, []
    rows = stored(last, "level3")
    for path in early:
        drop_table(spark, path)

    opened = rows.where("open")
    groups = stored(
        opened.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")).where("group_size > 1"),
        "groups",
    )
    # hot groups meet their rows where these lie, so that no task gets all rows of one text
    least = int(rows.count() * HOT)
    hot = F.broadcast(groups.where(F.col("group_size") > least))
    cool = groups.where(F.col("group_size") <= least)
    met = (
        opened.join(hot, "text_sha256")
        .unionByName(opened.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(cool, "text_sha256", "left"), allowMissingColumns=True)
        .unionByName(rows.where("not open"), allowMissingColumns=True)
    )
    alone = F.col("group_size").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, True).otherwise(F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
    )
